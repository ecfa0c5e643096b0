"""Joins of every kind, distinct on columns, and tables of given rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], kind: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on pairs of columns (left, right). Null matches nothing, unless null_safe: then null matches null. cross takes no notice of `on`."""
    if kind == "cross":
        return left.crossJoin(right)
    same = lambda a, b: left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
    return left.join(right, reduce(lambda x, y: x & y, [same(a, b) for a, b in on]), KINDS[kind])


def distinct_on(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The first row, by the order, of each set of values of the columns."""
    w = Window.partitionBy(*columns).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def node_list(g: PropertyGraph, ids: list[int]) -> DataFrame:
    """The nodes of given ids, of any label."""
    return g.node_scan(None).where(F.col("id").isin(*ids))


def single_row(g: PropertyGraph, **values: object) -> DataFrame:
    """One row of constants."""
    return g.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def empty(df: DataFrame) -> DataFrame:
    """No row, with the columns of df."""
    return df.limit(0)
