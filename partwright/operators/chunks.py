"""Ordered texts of a group as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_in_order(df: DataFrame, keys: list[str], position: str, text: str, separator: str) -> DataFrame:
    """Join ``text`` in order of ``position``: one row per group. The list of one group is one value by definition."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).cast("string").alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda r: r["t"]), separator)
    return df.groupBy(*keys).agg(joined.alias(text), F.count(F.lit(1)).alias("items"))
