"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "quillgraph", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave master unset: spark-submit gives it."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
