"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node that can be reached.

    Each round takes the smallest label among neighbours and then the label of that label, so paths shorten by
    half or better; every round is written to the shared folder. Nothing is gathered on the driver but the count of changes.
    Loops and repeated edges change nothing; without edges the result is empty.
    """
    both = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges"
    )
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node")
    labels = written(labels, "cc-labels")
    while True:
        nearest = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(nearest, F.col("node") == F.col("a")).select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("was")
        )
        hop = labels.select(F.col("node").alias("label"), F.col("component").alias("beyond"))
        step = written(
            lower.join(hop, F.col("component") == F.col("label")).select(
                "node", F.least("component", "beyond").alias("component"), "was"
            ),
            "cc-labels",
        )
        discard(labels)
        if step.where("component <> was").isEmpty():
            discard(both)
            return step.select("node", "component")
        labels = step.select("node", "component")
