"""Registered queries: operators bound to the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries", "match_queries", "route_queries", "print_queries", "review_queries", "geometry_queries", "catalog_queries",
    "document_queries", "search_queries", "stream_queries", "region_queries",
)


def all_queries():
    from partwright.bindings.spec import REGISTRY

    for module in MODULES:
        importlib.import_module(f"partwright.bindings.{module}")
    return REGISTRY
