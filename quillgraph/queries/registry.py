"""Registry of the queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def text(name: str, graph: Callable[[SparkSession, str], object], source: str, sql: str | None = None, **params: object) -> None:
    """A query text of the pattern language over a graph."""
    query(name, sql)(lambda spark, sf_dir: graph(spark, sf_dir).query(source, **params))
