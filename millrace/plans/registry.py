"""Registry of queries: each is a function of ``Tables``, with the SQL that answers the same question where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import duck_with
from ..sources.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` may name the fixtures."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, folder, f=f: f(Tables(spark, folder))) for n, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: duck_with(s) for n, s in _SQL.items()}
