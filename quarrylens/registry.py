"""Queries by operator: a Spark function and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Adapter views in DuckDB SQL, in an order in which each uses earlier ones only.
VIEWS: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The SQL with the adapter views that it needs, directly or not, in front."""
    needed: set[str] = set()
    text = sql
    for name in reversed(VIEWS):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + VIEWS[name]
    views = ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed)
    if not views:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views} {sql}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; views named in its SQL are added in front."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add
