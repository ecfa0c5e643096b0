"""EXPLAIN and PROFILE as tables."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame


def explained(df: DataFrame) -> DataFrame:
    """(line, plan): the physical plan as text. Nothing is run."""
    spark = df.sparkSession
    text = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return spark.createDataFrame(list(enumerate(text.rstrip().split("\n"))), "line long, plan string")


def profiled(df: DataFrame) -> DataFrame:
    """(step, depth, operator, rows, ms): the query is run, its rows are thrown away. rows is null where an operator doesn't count; ms is that of the whole run in
    the first line."""
    spark, began = df.sparkSession, time.perf_counter()
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollectIterator() if df.isStreaming else execution.toRdd().count()
    ms = int((time.perf_counter() - began) * 1000)
    rows: list[tuple] = []

    def walk(node: Any, depth: int) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return walk(node.plan(), depth)
        counted = node.metrics().get("numOutputRows")
        rows.append((len(rows), depth, node.nodeName(), counted.get().value() if counted.isDefined() else None, ms if not rows else None))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)
        return None

    walk(execution.executedPlan(), 0)
    return spark.createDataFrame(rows, "step long, depth long, operator string, rows long, ms long")
