"""Document fingerprints by context-triggered piecewise hashing, and how alike two of them are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwright.llm.common import small_batches, text_or_empty

#: Least block size, longest signature, bytes that the rolling hash remembers, characters that two signatures must
#: have in a row, signatures per fingerprint, and the signature's alphabet.
LEAST, LONGEST, WINDOW, RUN, SCALES = 3, 64, 7, 7, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_BYTES = np.random.default_rng(1_846).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at every byte: it forgets what lies further back, so edits stay local.

    Each step shifts by five bits, so after seven steps a byte has left the 32 bits; three doublings add up the steps.
    """
    h = _BYTES[data]
    for span in (1, 2, 4):
        h[span:] = h[span:] ^ (h[:-span] << np.uint32(5 * span)) if len(h) > span else h[span:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    h ^= h >> np.uint32(13)
    return h


def fingerprint(text: str) -> str:
    """``block size:signature:...``, four signatures at this block size and at two, four and eight times it.

    A rolling hash of the text's UTF-8 bytes marks chunk borders; each chunk is hashed whole and shown as one
    character. The block size is the least one at which the signature has at most 64 characters, so every byte counts
    and equal texts have equal fingerprints. An empty text has empty signatures.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return f"{LEAST}" + ":" * SCALES
    h = rolling(data)
    # A byte ends a chunk at block size LEAST * 2**k if the hash is one less than a multiple of it; its largest k
    # follows from the lowest zero bit. The last byte ends the last chunk anyway.
    at = np.flatnonzero(h[:-1] % np.uint32(LEAST) == LEAST - 1)
    q = h[at] // np.uint32(LEAST)
    level = np.frexp((~q & (q + np.uint32(1))).astype(np.float64))[1] - 1
    per = np.cumsum(np.bincount(level, minlength=33)[::-1])[::-1]
    k = int(np.argmax(per < LONGEST))
    sums = np.cumsum(h, dtype=np.uint64)

    def signature(least: int) -> str:
        end = np.append(at[level >= least], len(data) - 1)
        chunk = np.diff(sums[end], prepend=np.uint64(0)) + np.diff(end, prepend=-1).astype(np.uint64)
        chunk = chunk * np.uint64(0x9E3779B97F4A7C15)
        return ALPHABET[((chunk ^ (chunk >> np.uint64(29))) >> np.uint64(7) & np.uint64(63)).astype(np.int64)].tobytes().decode()

    return ":".join([str(LEAST << k), *(signature(k + i) for i in range(SCALES))])


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in signatures])
    out = np.zeros((len(signatures), max(1, int(size.max(initial=0)))), dtype=np.uint8)
    for k, s in enumerate(signatures):
        out[k, : len(s)] = np.frombuffer(s.encode(), dtype=np.uint8)
    return out, size


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of many pairs of short strings at once, a row of all tables at a time."""
    (a, n), (b, m) = _codes(left), _codes(right)
    place = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(place, (len(a), len(place))).astype(np.int32).copy()
    last = row.copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - place, axis=1) + place
        last[n == i + 1] = row[n == i + 1]
    return last[np.arange(len(a)), m]


def alike(left: str, right: str) -> float:
    """Likeness of two fingerprints, 0 to 1: see ``likeness``."""
    return float(likeness([left], [right])[0])


def _shares_run(a: str, b: str, n: int) -> bool:
    if n == 0 or len(a) < n or len(b) < n:
        return False
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in runs for i in range(len(b) - n + 1))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1.

    Only signatures of equal block size are compared. For each it is one less the edit distance as a share of the
    longer signature, or 0 if no run of seven characters is shared (of the whole shorter one, if both are the finest of
    their fingerprints and it is shorter); the best of the comparisons counts. Equal fingerprints have likeness 1,
    fingerprints without a common block size 0.
    """
    out = np.zeros(len(left))
    who, one, two = [], [], []
    for k, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[k] = 1.0
            continue
        (bx, *xs), (by, *ys) = x.split(":"), y.split(":")
        shift = int(by).bit_length() - int(bx).bit_length()
        for i in range(max(0, shift), min(SCALES, SCALES + shift)):
            a, b = xs[i], ys[i - shift]
            if _shares_run(a, b, RUN if i or shift else min(RUN, len(a), len(b))):
                who.append(k)
                one.append(a)
                two.append(b)
    if who:
        longest = np.maximum([len(a) for a in one], [len(b) for b in two])
        np.maximum.at(out, np.array(who), 1 - edit_distances(one, two) / longest)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint``, one row per input row, from whole texts.

    Null texts count as empty; null and repeated ids are kept as they are; further columns are ignored; a table without
    rows gives none.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": [len(t) for t in texts], "fingerprint": [fingerprint(t) for t in texts]})

    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInPandas(of, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, make: Callable[[list[str], list[str]], dict[str, list]], schema: str, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 4) -> DataFrame:
    """``doc_id`` and what ``make(texts, next texts)`` gives, where the next text is that of the following document in
    order of id (after the last: the first), the null id last, rows of equal id in order of text.

    Texts are shuffled once: ids are cut into ranges, each range also gets the first row of the range after it, and
    is walked in order. Only the ranges' first ids go to the driver, ``per_partition`` for each shuffle partition.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    spark = base.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition
    cuts = base.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("c")).first()["c"] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # Range k holds the ids from bounds[k-1] on and below bounds[k]; the null id has the last range to itself.
        known = ids.notna().to_numpy()
        found = np.full(len(ids), len(bounds) + 1)
        found[known] = np.searchsorted(bounds, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(found.astype(np.int32))

    ranged = base.withColumn("part", range_of("doc_id"))
    firsts = {r["part"]: r["first"] for r in ranged.groupBy("part").agg(F.min("doc_id").alias("first")).collect()}
    there = sorted(firsts)
    before = {p: there[i - 1] for i, p in enumerate(there)}
    heads = spark.createDataFrame([(p, firsts[p], before[p]) for p in there], "part int, first long, before int")
    leads = ranged.join(F.broadcast(heads), "part").where(F.col("doc_id").eqNullSafe(F.col("first")))
    one = Window.partitionBy("part").orderBy("text")
    leads = leads.withColumn("k", F.row_number().over(one)).where("k = 1").select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("guest"))
    rows = ranged.select("doc_id", "text", "part", F.lit(False).alias("guest")).unionByName(leads)
    dealt = rows.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_last(), "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            own, ids_, nexts = [], [], []
            for row in zip(batch["part"], batch["guest"], batch["doc_id"], batch["text"]):
                if held is not None and held[0] == row[0]:
                    ids_.append(held[2])
                    own.append(held[3])
                    nexts.append(row[3])
                held = row
            if own:
                yield pd.DataFrame({"doc_id": pd.array(ids_, dtype="Int64"), **make(own, nexts)})

    return dealt.mapInPandas(walk, f"doc_id long, {schema}")

