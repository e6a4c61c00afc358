"""Best-fit packing of pieces into sequences of a fixed capacity, in bulk-synchronous rounds."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwright.llm.common import running_sums


def plan_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of every length go: rows of ``(length, first_rank, n, per_sequence, sequence, offset)``.

    Items of one length are alike, and so are gaps of one size: a sweep over all of them is a sweep over lengths and
    gap sizes with their counts, at most ``capacity`` of each however many items there are. Rounds go from the longest
    length down. In each, items look up their successor, the smallest gap that holds them; items that want the same
    gaps are settled by rank, the first ranks filling the tightest gaps; the gaps are updated; what is left opens new
    sequences. The outcome is that of best-fit decreasing, item by item.
    """
    out = []
    sizes: list[int] = []  # gap sizes in order
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of (first sequence, number of sequences)

    def add(size: int, first: int, n: int) -> None:
        if size > 0 and n > 0:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, n))

    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        at = bisect_left(sizes, length)
        changed = []
        while left and at < len(sizes):
            size = sizes[at]
            per = size // length
            runs, keep = gaps[size], []
            while runs and left:
                first, n = runs.pop()
                full = min(n, left // per)
                if full:
                    out.append((length, rank, full * per, per, first, capacity - size))
                    changed.append((size - per * length, first, full))
                    left, rank, first, n = left - full * per, rank + full * per, first + full, n - full
                if n and 0 < left < per:
                    out.append((length, rank, left, left, first, capacity - size))
                    changed.append((size - left * length, first, 1))
                    rank, left, first, n = rank + left, 0, first + 1, n - 1
                if n:
                    keep.append((first, n))
            gaps[size] = runs + keep
            if gaps[size]:
                at += 1
            else:
                del gaps[size], sizes[at]
        per = capacity // length
        full, rest = divmod(left, per)
        if full:
            out.append((length, rank, full * per, per, made, 0))
            changed.append((capacity - per * length, made, full))
            made, rank = made + full, rank + full * per
        if rest:
            out.append((length, rank, rest, rest, made, 0))
            changed.append((capacity - rest * length, made, 1))
            made += 1
        for c in changed:
            add(*c)
    return out


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", order: tuple[str, ...] = ("piece",), length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id, offset``: every row gets a place, sequences are gapless from 0.

    Rows are range-sorted by length and ranked within it (a length of any frequency is ranked over many partitions);
    only the number of rows of each length, at most ``capacity`` numbers, goes to the driver, which sweeps them in
    rounds (``plan_rounds``); the rows then find their interval of the plan, whose size ``capacity`` bounds.

    Lengths are from 1 to ``capacity``; others raise. Ties and repeated rows are placed like any other rows. Null ids
    are allowed. A table without rows gives none. Reads ``pieces`` once, so pass a stored table if it is costly.
    """
    spark = pieces.sparkSession
    bad = F.raise_error(F.concat(F.lit(f"a piece must have 1 to {capacity} tokens, not "), F.coalesce(F.col(length_col).cast("string"), F.lit("null"))))
    rows = pieces.withColumn("_len", F.when(F.col(length_col).between(1, capacity), F.col(length_col).cast("int")).otherwise(bad)).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(rows, ["_len"], [F.col(id_col), *map(F.col, order)], {"_rank": "_one"})
    counts = {r["_len"]: r["n"] for r in ranked.groupBy("_len").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_rounds(counts, capacity), "_l int, _first long, _n long, _per long, _seq long, _off long")
    met = ranked.join(F.broadcast(plan), (F.col("_len") == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")))
    place = F.col("_rank") - F.col("_first")
    return met.select(
        *pieces.columns, (F.col("_seq") + F.floor(place / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_off") + place % F.col("_per") * F.col("_len")).cast("long").alias("offset"),
    )
