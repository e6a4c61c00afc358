"""Near-duplicates by HyperMinHash: banded compressed registers, corrected estimates, links confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwright.llm.common import small_batches, text_or_empty
from partwright.llm.tokens import Store
from partwright.operators.graph import connected
from partwright.session import cut_lineage

#: Registers and registers per band. Two sets with Jaccard 0.8 miss all 40 bands with probability 1e-7.
REGISTERS, BAND = 200, 5
MANTISSA = 10
SETS_PER_TILE = 1024
#: Pairs of one search that are estimated at once.
PAIRS = 32768
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_hashes() -> Store:
    return Store(xxhash.xxh64_intdigest)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles; fewer words are one shingle, no words none.

    Words are what ASCII white space separates, A-Z lower-cased.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(words))
    kept = _word_hashes()
    h = np.fromiter((kept[w] for w in words), dtype=np.uint64, count=len(words))
    found = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        found = _mixed(found * _A + h[k : len(words) - width + 1 + k])
    return np.unique(found)


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    rng = np.random.default_rng(20_011)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed registers of a set: for the least hash of each bucket its leading-zero count and mantissa bits.

    A bucket without a hash borrows the register of another one, in a fixed order of its own, so that bands of small
    sets are as selective as others.
    """
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    used, first = np.unique(bucket.astype(np.int64), return_index=True)
    rest = _mixed(hashes)  # order within a bucket must not follow the bucket's own bits
    least = np.minimum.reduceat(rest, first)
    bits, exponent = np.frexp(least.astype(np.float64) + 1.0)
    packed = (np.minimum(64 - np.minimum(exponent, 64), 62).astype(np.uint16) << np.uint16(MANTISSA)) | ((bits * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    there = np.zeros(REGISTERS, dtype=bool)
    out[used], there[used] = packed, True
    if len(used) < REGISTERS:
        empty = np.flatnonzero(~there)
        order = _probes()[empty]
        out[empty] = out[order[np.arange(len(empty)), there[order].argmax(axis=1)]]
    return out


@lru_cache(maxsize=1)
def accident() -> float:
    """Chance that registers of different least hashes agree: the least hash of many is spread exponentially, and two
    agree if they fall into one cell (an octave's share of ``2**MANTISSA``)."""
    total = 0.0
    for octave in range(-40, 8):
        edges = np.exp2(octave) * (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA))
        total += float(np.square(np.exp(-edges[:-1]) - np.exp(-edges[1:])).sum())
    return total


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row and band of compressed registers."""
    per = REGISTERS // BAND
    parts = regs.reshape(len(regs), per, BAND).astype(np.uint64)
    h = np.broadcast_to(np.arange(per, dtype=np.uint64), (len(regs), per))
    for k in range(BAND):
        h = _mixed(h * _A + parts[:, :, k])
    return h.view(np.int64)


def _registers_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(len(column), REGISTERS)


def _slack(n: np.ndarray, sigmas: float = 5.0) -> np.ndarray:
    """How far below the threshold an estimate may lie: five standard deviations for sets of ``n``."""
    return sigmas * np.sqrt(0.16 / np.minimum(n, REGISTERS))


def linked_in_buckets(few: pd.DataFrame, many: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``src, dst``: links between ``few`` and ``many`` of one bucket and different components, for any number of buckets.

    ``many`` has all rows of a bucket (or of its tile), ``few`` those outside its largest component ``main``, so a pair
    outside ``main`` is looked at from its smaller id only. A pair is looked at in the first of its common buckets;
    likely partners are confirmed best first, until one of a component is. ``PAIRS`` are estimated at once.
    """
    out = []
    if len(few) and len(many):
        many = many.sort_values("bucket", kind="stable")
        by_chance = accident()
        few_regs, many_regs = _registers_of(few["regs"]), _registers_of(many["regs"])
        few_bands, many_bands = band_hashes(few_regs), band_hashes(many_regs)
        bucket, ids, main, component = (few[c].to_numpy() for c in ("bucket", "doc_id", "main", "component"))
        other_bucket, other_ids, other_component = (many[c].to_numpy() for c in ("bucket", "doc_id", "component"))
        sets, other_sets = few["s"].to_numpy(), many["s"].to_numpy()
        size, other_size = (np.array([len(s) // 8 for s in of]) for of in (sets, other_sets))
        before = np.arange(few_bands.shape[1]) < (few_bands == bucket[:, None]).argmax(axis=1)[:, None]
        low, high = (np.searchsorted(other_bucket, bucket, side) for side in ("left", "right"))
        upto = np.concatenate([[0], np.cumsum(high - low)])
        begin = 0
        while begin < len(few):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(begin, end), (high - low)[begin:end])
            j = np.arange(upto[begin], upto[end]) - upto[i] + low[i]
            begin = end
            fit = (component[i] != other_component[j]) & ((other_component[j] == main[i]) | (ids[i] < other_ids[j]))
            fit &= 100 * np.minimum(size[i], other_size[j]) >= percent * np.maximum(size[i], other_size[j])
            i, j = i[fit], j[fit]
            fit = ~((many_bands[j] == few_bands[i]) & before[i]).any(axis=1)
            i, j = i[fit], j[fit]
            estimate = ((many_regs[j] == few_regs[i]).mean(axis=1) - by_chance) / (1 - by_chance)
            hopeful = estimate >= percent / 100 - _slack(np.minimum(size[i], other_size[j]))
            i, j, estimate = i[hopeful], j[hopeful], estimate[hopeful]
            met = set()
            for k in np.lexsort((-estimate, i)):
                one, two = i[k], j[k]
                if (one, other_component[two]) not in met:
                    a, b = np.frombuffer(sets[one], dtype=np.uint64), np.frombuffer(other_sets[two], dtype=np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        met.add((one, other_component[two]))
                        out.append((ids[one], other_ids[two]))
    return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; a component is what links
    connect, named by its smallest id; that document is kept.

    1. Equal sets form a class; only its smallest id goes on, so that copies are never paired.
    2. Registers are cut into bands. In each bucket of equal bands every member is paired with the smallest id alone;
       pairs whose sizes or corrected estimate rule a link out are dropped, the others are confirmed on full sets.
    3. Buckets that still hold several components are searched in tiles of bounded size: members outside the bucket's
       largest component meet all members of others, each pair in the first bucket they share, by sizes, estimate and
       full sets; one link per member and component is enough. Small buckets share a call.
    So a bucket is never expanded into all its pairs, and no link between bucket mates of different components is lost.

    Sets are compared by 64-bit hashes of shingles. Empty sets (null or empty texts) link with nothing. Rows that
    repeat an id are one node: the links of each count for all. Rows with a null id are in no component: their
    component is null and they are kept. Tables without rows give none; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text, width)
                key = xxhash.xxh128_digest(s.tobytes())
                rows.append((len(s), key, registers(s).tobytes() if len(s) else b""))
            out = pd.DataFrame(rows, columns=["n", "key", "regs"])
            out.insert(0, "doc_id", batch["doc_id"].values)
            yield out

    sketched = cut_lineage(base.mapInPandas(sketch, "doc_id long, n long, key binary, regs binary"))
    live = sketched.where("n > 0 and doc_id is not null")
    classes = live.groupBy("key").agg(F.min(F.struct("doc_id", "n", "regs")).alias("r")).select("key", "r.*")

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                h = band_hashes(_registers_of(batch["regs"]))
                yield pd.DataFrame({"bucket": h.ravel(), "doc_id": np.repeat(batch["doc_id"].to_numpy(), h.shape[1])})

    banded = cut_lineage(classes.select("doc_id", "regs").mapInPandas(bands, "bucket long, doc_id long").distinct())
    # Aggregates are tables of their own here and below: a join right on an aggregation can't be split at a hot key.
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("doc_id").alias("center")).where("members > 1")
    members = cut_lineage(banded.join(cut_lineage(shared.select("bucket", "center")), "bucket"))
    wanted = members.select("doc_id").distinct()

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "s": [shingle_set(t, width).tobytes() for t in batch["text"]]}, columns=["doc_id", "s"])

    sets = cut_lineage(base.join(wanted, "doc_id").dropDuplicates(["doc_id", "text"]).mapInPandas(full, "doc_id long, s binary").dropDuplicates())

    # Stars: each member with its bucket's smallest id.
    stars = members.where("doc_id <> center").select("center", F.col("doc_id").alias("other")).distinct()
    sized = classes.select("doc_id", "n", "regs")
    one = sized.select(F.col("doc_id").alias("center"), F.col("n").alias("n1"), F.col("regs").alias("r1"))
    two = sized.select(F.col("doc_id").alias("other"), F.col("n").alias("n2"), F.col("regs").alias("r2"))
    pairs = stars.join(two, "other").join(one, "center").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_chance = accident()
        for batch in batches:
            if len(batch):
                a, b = _registers_of(batch["r1"]), _registers_of(batch["r2"])
                estimate = ((a == b).mean(axis=1) - by_chance) / (1 - by_chance)
                floor = percent / 100 - _slack(np.minimum(batch["n1"], batch["n2"]).to_numpy())
                yield batch.loc[estimate >= floor, ["center", "other"]]

    hopeful = pairs.mapInPandas(likely, "center long, other long").distinct()

    def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["s1"], batch["s2"]):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[np.array(keep, dtype=bool), ["src", "dst"]]

    met = hopeful.join(sets.select(F.col("doc_id").alias("other"), F.col("s").alias("s2")), "other")
    met = met.join(sets.select(F.col("doc_id").alias("center"), F.col("s").alias("s1")), "center")
    links = cut_lineage(met.select(F.col("center").alias("src"), F.col("other").alias("dst"), "s1", "s2").mapInPandas(confirmed, "src long, dst long").distinct())
    found = cut_lineage(connected(links))

    # What buckets with several components still hide.
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = cut_lineage(placed)
    per = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = per.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    mixed = cut_lineage(mixed)
    tiles = placed.join(mixed, "bucket").withColumn("tiles", F.ceil(F.col("members") / SETS_PER_TILE).cast("int"))
    tiles = tiles.join(sets, "doc_id").join(classes.select("doc_id", "regs"), "doc_id").select("bucket", "tiles", "main", "doc_id", "component", "s", "regs")
    tiles = cut_lineage(tiles)
    # Buckets of one tile are mostly a few rows: many of them go through one call together, about a tile's rows in each.
    small = mixed.where(F.col("members") <= SETS_PER_TILE).agg(F.sum("members").alias("n")).first()["n"] or 0
    alone = F.col("tiles") > 1
    pack = F.when(alone, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(max(1, math.ceil(small / SETS_PER_TILE)))))
    tiles = tiles.select(alone.alias("alone"), pack.alias("pack"), *tiles.columns)
    own_tile = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    row = ["bucket", "doc_id", "component", "s", "regs"]
    right = tiles.select("alone", "pack", own_tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("part"), *row)
    right = right.toDF(*right.columns)
    left = tiles.where("component <> main").select("alone", "pack", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), own_tile.alias("part"), "main", *row)

    def search(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        return linked_in_buckets(few, many, percent)

    packed = ["alone", "pack", "tile", "part"]
    more = left.groupBy(*packed).cogroup(right.groupBy(*packed)).applyInPandas(search, "src long, dst long")
    joined = more.distinct()
    over = joined.join(found.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src", "left").join(found.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst", "left")
    over = connected(over.select(F.coalesce("c1", "src").alias("src"), F.coalesce("c2", "dst").alias("dst")))
    # A class's rows follow their representative; a representative its component; a component the one it was merged into.
    reps = classes.select("key", F.col("doc_id").alias("rep"))
    first = F.coalesce("component", "rep")
    reps = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", first.alias("c"))
    reps = reps.join(over.select(F.col("node").alias("c"), F.col("component").alias("m")), "c", "left").select("key", F.coalesce("m", "c").alias("component_id"))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 and doc_id is not null"), F.col("key")).alias("key"))
    out = out.join(cut_lineage(reps), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
