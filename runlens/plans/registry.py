"""Registry of named queries (Spark) and their oracle SQL (DuckDB).

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.
Results that carry arrays or maps are rendered to text with a stated order
so the two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
SECTION: dict[str, str] = {}


def register(name: str, sql: str | None = None, section: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        SECTION[name] = section
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from . import (queries_graph, queries_joins,  # noqa: F401
                   queries_eval, queries_payload, queries_reports, queries_state, queries_streaming, queries_udf,
                   queries_windows)
