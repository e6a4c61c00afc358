"""Loading, listing and checking of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.functions import text as tx
from partwright.sources import reference
from partwright.sources.joins import lookup

# ---- fixed values ---------------------------------------------------------------------------
PREVIEW_ROWS = 200
# ---------------------------------------------------------------------------------------------


def build_reference(spark: SparkSession, folder: str, with_seed: bool = True) -> list[str]:
    """Write all reference tables as Parquet, replacing what is there; without seed they stay empty."""
    for name in reference.TABLES:
        reference.load(spark, name, with_seed).write.mode("overwrite").parquet(f"{folder}/{name}")
    return list(reference.TABLES)


def open_tables(spark: SparkSession, folder: str, names: list[str], suffix: str = "") -> dict[str, DataFrame]:
    """Read tables and register them as temporary views."""
    out = {}
    for name in names:
        out[name] = spark.read.parquet(f"{folder}/{name}{suffix}")
        out[name].createOrReplaceTempView(name)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Name and row count of every table; Parquet answers the counts from footers."""
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def preview(tables: dict[str, DataFrame], name: str, order: list[str], rows: int = PREVIEW_ROWS) -> DataFrame | None:
    """First rows by key as text with nulls empty, the total count and a truncation flag; unknown names give nothing."""
    if name not in tables:
        return None
    df = tables[name]
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    head = df.orderBy(*order).limit(rows).select(*texts)
    return head.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_rows") > rows)  # one row


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str, label: str) -> DataFrame:
    """Child keys without a parent, as one row. Keys are counted before the join, so a hot key is one row."""
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_column).alias("k")).distinct()
    lost = keys.join(known, "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(label).alias("rule"), "violations")


def outside_domain(df: DataFrame, column: str, allowed: list, label: str) -> DataFrame:
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(label).alias("rule"), "violations")


def duplicates(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Number of keys that occur more than once."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(label).alias("rule"), "violations")


def broken_predicate(df: DataFrame, holds: Column, label: str) -> DataFrame:
    bad = df.where(~F.coalesce(holds, F.lit(False)))
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(label).alias("rule"), "violations")


def resolve_codes(staging: DataFrame, code: str, classifier: DataFrame, classifier_code: str = "code", id_name: str = "id") -> DataFrame:
    """Replace a natural code by the id of the classifier row; unknown codes give null."""
    keys = classifier.select(F.col(classifier_code).alias(code), F.col("id").alias(id_name))
    return lookup(staging, keys, code)


def resolve_edges(staging: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolve both ends of clause edges by (designation, clause number); a lost end is reported, not dropped.

    ``staging`` has edge_id, src_designation, src_clause, dst_designation, dst_clause.
    """
    out = staging
    for end in ("src", "dst"):
        side = nodes.select(
            F.col("designation").alias(f"{end}_designation"), F.col("clause_number").alias(f"{end}_clause"), F.col("id").alias(f"{end}_id")
        )
        out = lookup(out, side, [f"{end}_designation", f"{end}_clause"])
    lost = F.when(F.col("src_id").isNull() & F.col("dst_id").isNull(), "both").when(F.col("src_id").isNull(), "src").when(
        F.col("dst_id").isNull(), "dst"
    )
    return out.select("edge_id", "src_id", "dst_id", lost.alias("unresolved"))


def read_step_files(spark: SparkSession, path: str) -> DataFrame:
    """STEP files as ``file_id, text``: UTF-8 where valid, Windows-1251 otherwise, escapes decoded."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file_id"), tx.decode_step_escapes(tx.decode_step_bytes(F.col("content"))).alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
