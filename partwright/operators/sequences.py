"""Ordered computations inside groups of any size.

A window over a group puts the group into one task. Here every group is cut into buckets of its order column: windows
run per (group, bucket) and the few per-bucket totals carry the state across bucket borders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.session import cut_lineage

BUCKET_ROWS = 65536


def bucket(position: str, size: int = BUCKET_ROWS) -> Column:
    return F.floor((F.col(position) - 1) / size)


Values = Callable[[str], Column]


def scan(
    df: DataFrame, keys: list[str], coarse: list[Column], order: list[str], position: str = "position", row: list[str] | None = None,
    sums: dict[str, Callable[[Values, Values], Column]] | None = None, fine: bool = False,
) -> DataFrame:
    """One pass over ``df`` in ``order`` within ``keys``: adds the 1-based place ``position``, the columns ``row`` of the row
    before as ``prev_<column>`` (null for a first row), and for every item of ``sums`` the running total of what it
    makes of the values of a row and of the row before it (``row`` columns; null counts as nothing).

    ``coarse`` is monotone in ``order`` and cuts big groups into buckets; the table is shuffled by group and bucket. A
    bucket has a summary (its rows, first and last row, its totals without the first row); summaries are few, and in
    their order each learns the last row and the totals before its bucket, which is all its rows need. Without ``sums``
    summaries come from partial sums, so the table itself is shuffled once; with them it is ordered for them as well.

    ``fine`` says that ``coarse`` cuts small groups as well, into buckets of hardly a row each. Groups are counted first
    then, and only those of more than ``BUCKET_ROWS`` rows are cut and have summaries; the others lie in one bucket each.
    """
    sums, row = sums or {}, row or []
    coarse = coarse or [F.lit(0)]
    cuts = [f"_c{i}" for i in range(len(coarse))]
    if fine:
        large = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_ROWS).select(*keys, F.lit(True).alias("_large")))
        df_cut = df.join(large, keys, "left").withColumn("_large", F.coalesce("_large", F.lit(False)))
        cut = df_cut.select(*df.columns, "_large", *[F.when(F.col("_large"), c).alias(n) for c, n in zip(coarse, cuts)])
    else:
        cut = df.select("*", F.lit(True).alias("_large"), *[c.alias(n) for c, n in zip(coarse, cuts)])
    w = Window.partitionBy(*keys, *cuts).orderBy(*order)
    values = F.struct(*row) if row else F.struct(F.lit(1).alias("_"))
    of = lambda struct: lambda name: F.col(struct)[name]
    # The first row of a large group's bucket follows the bucket before; all others follow a row at hand or none.
    at_hand = ~F.col("_large") | (F.col("_local") > 1)

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.select("*", F.row_number().over(w).alias("_local"), F.lag(values).over(w).alias("_prev"), values.alias("_row"))
        return found.select("*", *[F.when(at_hand, add(of("_row"), of("_prev"))).alias(f"_v_{n}") for n, add in sums.items()])

    local = placed(cut)
    summary = (placed(cut.where("_large")) if fine else local).groupBy(*keys, *cuts).agg(
        F.count("*").alias("_n"), F.min_by("_row", F.struct(*order)).alias("_first"), F.max_by("_row", F.struct(*order)).alias("_last"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    )
    over = Window.partitionBy(*keys).orderBy(*cuts)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    summary = summary.select("*", F.lag("_last").over(over).alias("_carry"), none(F.sum("_n").over(earlier)).alias("_before"))
    summary = summary.select("*", *[add(of("_first"), of("_carry")).alias(f"_a_{n}") for n, add in sums.items()])
    start = [(none(F.sum(none(F.col(f"_a_{n}")) + none(F.col(f"_t_{n}"))).over(earlier)) + none(F.col(f"_a_{n}"))).alias(f"_s_{n}") for n in sums]
    summary = summary.select(*keys, *cuts, "_carry", "_before", *start)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = local.select("*", *[none(F.sum(f"_v_{n}").over(upto)).alias(f"_r_{n}") for n in sums])
    if fine:
        # Null-safe: null is a value like others in an order.
        known = cut_lineage(summary).withColumnsRenamed({c: f"_of_{c}" for c in [*keys, *cuts]})
        out = local.join(known, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, *cuts]]), "left")
        out = out.withColumns({c: none(F.col(c)) for c in ["_before", *[f"_s_{n}" for n in sums]]})
    else:
        out = local.join(summary, [*keys, *cuts])
    before = F.coalesce("_prev", "_carry")
    return out.select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(position), *[before[c].alias(f"prev_{c}") for c in row],
        *[(F.col(f"_s_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums],
    )


def dense_position(df: DataFrame, keys: list[str], coarse: list[Column], order: list[str], name: str = "position") -> DataFrame:
    """1-based rank inside ``keys`` by ``order``; ``coarse`` is monotone in ``order`` and cuts big groups."""
    return scan(df, keys, coarse, order, name, fine=bool(coarse))


def with_previous(df: DataFrame, keys: list[str], position: str, values: list[str], size: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``prev_<value>`` columns: the row before in the group by the dense ``position``."""
    return scan(df, keys, [bucket(position, size)], [position], "_at", values).drop("_at")


def running_sum(df: DataFrame, keys: list[str], position: str, value: Column, name: str, size: int = BUCKET_ROWS) -> DataFrame:
    """Adds the running total of ``value`` in order of ``position`` within ``keys``."""
    valued = df.withColumn("_value", value)
    return scan(valued, keys, [bucket(position, size)], [position], "_at", ["_value"], {name: lambda now, _: now("_value")}).drop("_at", "_value", "prev__value")


def carry_forward(df: DataFrame, keys: list[str], order: str, slot: Column, value: str, name: str) -> DataFrame:
    """Last non-null ``value`` up to each row by ``order``; ``slot`` is monotone in ``order`` and cuts big groups."""
    cut = df.withColumn("_s", slot)
    w = Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    lasts = cut.groupBy(*keys, "_s").agg(F.max_by(value, known).alias("_l"))
    over = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # A group of one slot, as most are, has nothing to hand on.
    carried = lasts.withColumn("_carry", F.last("_l", ignorenulls=True).over(over)).drop("_l").where("_carry is not null")
    out = cut.withColumn("_own", F.last(value, ignorenulls=True).over(w)).join(carried, [*keys, "_s"], "left")
    return out.withColumn(name, F.coalesce("_own", "_carry")).drop("_s", "_own", "_carry")
