"""What each of several filters removes under every order of applying them, from counts per failure mask."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.llm.common import WORD, hash128, text_or_empty
from partwright.session import cut_lineage

#: More filters would make more than 40 320 orders a part.
MOST_FILTERS = 8
TOTALS = ["removed", "good_lost", "toxic_lost"]


def removal_intervals(k: int) -> Iterator[tuple[int, int, int, int]]:
    """``mask, step, begin, end`` for every mask of failed filters (bit i: filter i).

    Orders of the ``k`` filters are numbered lexicographically: the Lehmer digits of an order are its filters' places
    among those not applied yet, and a prefix of ``step`` filters fixes an interval of ``(k - step)!`` numbers. A
    document is removed at ``step`` by the orders whose prefix passes ``step - 1`` filters and then fails one.
    Touching intervals of one step are one.
    """

    def walk(low: int, rest: tuple[int, ...], step: int, mask: int) -> Iterator[tuple[int, int, int]]:
        width = factorial(len(rest) - 1) if rest else 0
        for digit, f in enumerate(rest):
            begin = low + digit * width
            if mask >> f & 1:
                yield step, begin, begin + width
            else:
                yield from walk(begin, rest[:digit] + rest[digit + 1 :], step + 1, mask)

    for mask in range(1, 1 << k):
        last: tuple[int, int, int] | None = None
        for step, begin, end in sorted(walk(0, tuple(range(k)), 1, mask)):
            if last is not None and last[0] == step and last[2] == begin:
                last = (step, last[1], end)
                continue
            if last is not None:
                yield mask, *last
            last = (step, begin, end)
        if last is not None:
            yield mask, *last


def interval_ends(spark: SparkSession, k: int) -> DataFrame:
    """``mask, step, rank, sign``: a removal begins (+1) or ends (-1) at the order of that number."""
    rows = [(m, s, at, sign) for m, s, begin, end in removal_intervals(k) for at, sign in ((begin, 1), (end, -1)) if at < factorial(k)]
    columns = dict(zip(("mask", "step", "rank", "sign"), zip(*rows))) if rows else {c: [] for c in ("mask", "step", "rank", "sign")}
    return spark.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in columns.items()}))


def contract_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text: few words, few different words, many capitals, odd characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, chars = F.size(words), F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": capitals * 100 > chars * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(
    docs: DataFrame, filters: dict[str, Column], repeated: bool, part: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, part, mask``: one row per document, bit i of ``mask`` set where it fails the i-th of ``filters``, and the
    next bit, if ``repeated``, where its text is identical to that of a document with a smaller id.

    Texts are read once; numbers and a 128-bit hash of each text are written. The smallest id per hash is found with
    partial sums, so copies of any number are one row per task; a document fails if no such row has its id and hash.
    """
    bits = [F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(filters.values())]
    read = docs.select(
        F.col(id_col).alias("doc_id"), part.alias("part"), sum(bits[1:], bits[0]) if bits else F.lit(0), hash128(text_or_empty(text_col)).alias("h"),
    ).toDF("doc_id", "part", "mask", "h")
    if not repeated:
        return read.select("doc_id", "part", "mask")
    seen = cut_lineage(read.select("doc_id", "part", "mask", "h.a", "h.b"))
    first = seen.where("doc_id is not null").groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.min("doc_id").alias("_first"))
    on = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("doc_id") == F.col("_first"))
    later = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return seen.join(first, on, "left").select("doc_id", "part", (F.col("mask") + later.cast("int") * (1 << len(bits))).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, removed, good_lost, toxic_lost``: documents, those labelled good, those labelled toxic.

    Labels that repeat an id are one: good (toxic) if one of them says so.
    """
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_d")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    # Null ids have no label and are dealt out by their number within the task.
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    met = masks.withColumn("_salt", salt).join(label.withColumn("_zero", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_d")) & (F.col("_salt") == F.col("_zero")), "left")
    return met.groupBy("part", "mask").agg(
        F.count("*").alias("removed"), F.sum(F.coalesce("_good", F.lit(0))).alias("good_lost"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic_lost")
    )


def order_totals(counts: DataFrame, names: list[str]) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every part
    and order of the filters ``names``, from counts per part and mask.

    Counts are added where the intervals of their mask begin and taken off where they end (a difference array per part
    and step over the numbers of the orders); running sums over the numbers give the totals of all orders at once.
    A step of an order removes what fails its filter and was not removed before, so all else follows from these.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    if any(len(n) != 1 for n in names):
        raise ValueError("filters are named by one letter each")
    counts = cut_lineage(counts)
    ends = F.broadcast(interval_ends(counts.sparkSession, k))  # of fixed size: the filters alone determine it
    change = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in TOTALS])

    has = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("removed"))), F.lit(0))
    parts = counts.groupBy("part").agg(
        F.sum("removed").alias("total"), F.array(*[of(has(i)) for i in range(k)]).alias("fails"), F.array(*[of(F.col("mask") == 1 << i) for i in range(k)]).alias("alone")
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    grid = parts.select("*", F.posexplode(orders).alias("rank", "filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = F.position(F.substring("filter_order", F.col("step"), F.lit(1)), F.lit("".join(names)))
    grid = grid.select("part", "step", "rank", "filter_order", "total", F.element_at("fails", place).alias("fails"), F.element_at("alone", place).alias("unique_fails"))
    met = grid.join(change, ["part", "step", "rank"], "left")

    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = met.select("part", "step", "rank", "filter_order", "total", "fails", "unique_fails", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in TOTALS])
    within = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    kept = summed.withColumn("kept", F.col("total") - F.sum("removed").over(within))
    by_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return kept.withColumn("shapley", F.sum("removed").over(by_filter)).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeated: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The rows of ``order_totals`` for ``filters`` (name: failure condition on the columns of ``docs``; those of
    ``contract_filters`` if none are given) followed by the filter ``repeated`` for identical texts.

    Null texts are empty, null parts are the empty part; a condition that is null is passed. A null id is neither
    smaller nor larger than others, so such a row is never a repetition and makes none; rows that repeat id and text
    are documents of their own, none of them smaller. Whole texts of any length are read. Tables without rows give no
    parts and no rows; further columns are ignored.
    """
    filters = contract_filters(text_or_empty(text_col)) if filters is None else filters
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    masks = failure_masks(docs, filters, repeated is not None, part, id_col, text_col)
    return order_totals(mask_counts(masks, labels), [*filters, *([repeated] if repeated is not None else [])])
