"""A registered query: the Spark form and, where SQL can say it, the SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from partwright.sources.reference import TABLES as REFERENCE_TABLES

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, QueryFn] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def register(fn: QueryFn) -> QueryFn:
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = with_facts(sql)
            return fn

        return register


FACT_SQL: dict[str, str] = {}


def _named(sql: str, name: str) -> bool:
    return re.search(rf"\b{re.escape(name)}\b", sql) is not None


def _body(name: str) -> str:
    return FACT_SQL.get(name) or REFERENCE_TABLES[name].select_sql()


def with_facts(sql: str) -> str:
    """Prefix the WITH items (facts and reference tables) the statement mentions, in dependency order."""
    order: list[str] = []
    open_names: set[str] = set()

    def need(text: str) -> None:
        for name in [*FACT_SQL, *REFERENCE_TABLES]:
            if name in order or name in open_names or not _named(text, name):
                continue
            open_names.add(name)
            if name in FACT_SQL:
                need(FACT_SQL[name])
            open_names.discard(name)
            order.append(name)

    need(sql)
    stripped = sql.strip()
    items = ", ".join(f"{name} AS ({_body(name)})" for name in order)
    if not items:
        return stripped
    for head in ("WITH RECURSIVE ", "WITH "):
        if stripped.upper().startswith(head):
            return f"{head}{items}, {stripped[len(head):]}"
    return f"WITH {items} {stripped}"


REGISTRY = Registry()
