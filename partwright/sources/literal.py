"""Small fixed tables written as SQL ``VALUES``.

A ``VALUES`` table becomes a LocalRelation: Catalyst knows its exact size, folds constants through
it and plans a broadcast without starting a Python worker. The same text runs in any ANSI engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SPARK_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "varchar": T.StringType(),
    "boolean": T.BooleanType(),
}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}e0"
    text = str(value)
    if "'" in text or "\\" in text:
        raise ValueError(f"quote or backslash in a fixed value: {text!r}")
    return f"'{text}'"


@dataclass(frozen=True)
class FixedTable:
    """Name, typed columns and rows of one reference table."""

    name: str
    columns: tuple[tuple[str, str], ...]
    rows: tuple[tuple, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _SPARK_TYPES[t]) for n, t in self.columns])

    def select_sql(self, spark_types: bool = False) -> str:
        names = ", ".join(n for n, _ in self.columns)
        casts = ", ".join(
            f"CAST({n} AS {'STRING' if spark_types and t == 'varchar' else t}) AS {n}" for n, t in self.columns
        )
        rows = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in self.rows)
        return f"SELECT {casts} FROM (VALUES {rows}) AS v({names})"

    def load(self, spark: SparkSession, with_seed: bool = True) -> DataFrame:
        if not with_seed or not self.rows:
            return spark.createDataFrame([], self.schema)
        return spark.sql(self.select_sql(spark_types=True))


def table(name: str, columns: str, *rows: tuple) -> FixedTable:
    """``columns`` is written as ``"id bigint, code varchar"``."""
    typed = tuple(tuple(part.split()) for part in columns.split(","))
    for row in rows:
        if len(row) != len(typed):
            raise ValueError(f"{name}: {row!r} does not have {len(typed)} values")
    return FixedTable(name, typed, rows)
