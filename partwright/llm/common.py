"""Helpers shared by the corpus operators: reading tables, batch bounds, sums over a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.session import cut_lineage

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: ASCII white space as the contracts spell it: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most ``rows`` rows at once to Python workers, so that a run of very long texts stays in memory."""
    now = int(spark.conf.get(ARROW_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is (``lower`` would change other alphabets)."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def hash128(*cols: Column | str) -> Column:
    """Two 64-bit hashes as one struct: at 10^12 keys one hash alone would meet collisions."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7), *cols).alias("b"))


def running_sums(df: DataFrame, group: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``values`` item (new name: column), the sum over the rows of the group that come before.

    Rows are range-sorted by group and order, so a group of any size is spread over as many partitions as its rows
    need. The sorted table is written once to the shared folder; each partition's totals (one small row per group
    and partition) are summed over the partitions before it and added to the sum within the partition. Rows with
    equal group and order stay in one partition, in no fixed order among themselves.
    """
    keys = [F.col(c).asc_nulls_last() for c in group]
    at = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    by = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))]
    ranged = cut_lineage(at.repartitionByRange(*keys, *by).withColumn("_part", F.spark_partition_id()))
    part = ranged.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values],
    )
    on = F.col("_part") == F.col("_p")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    within = Window.partitionBy(*group, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(part, on).select(
        *df.columns, *[(F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in values.items()]
    )
    return summed
