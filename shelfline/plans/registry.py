"""Registered queries by name, each with the SQL that checks it where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def _load() -> None:
    from . import allocation_queries, document_queries, entry_queries, file_queries, fill_queries, flow_queries, forecast_queries, learning_queries, load_queries, panel_queries, planning_queries, report_queries, sales_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
