"""The registry: name -> query, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import agent_queries, pricing_queries, reader_queries, reconcile_queries, report_queries, scalar_queries, sequence_queries, source_queries  # noqa: F401

    return QUERIES, SQL
