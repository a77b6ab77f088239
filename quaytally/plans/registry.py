"""Registration of queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaytally.sources.canonical import DOCUMENTS_SQL, ITEMS_SQL, MOVEMENTS_SQL, plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL that may use items, docs and movements."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLES[key] = f"WITH RECURSIVE {ITEMS_SQL.strip()}, {DOCUMENTS_SQL.strip()}, {MOVEMENTS_SQL.strip()}\n{sql.strip()}"
        return f

    return register
