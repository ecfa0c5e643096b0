"""Scores that decay with time, from event tables (node, ts in seconds, amount)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400.0


def decayed(amount: Column, age: Column, half_life: float | Column) -> Column:
    return amount * F.pow(F.lit(2.0), -age / half_life)


def energy(events: DataFrame, now: float, half_life: float = DAY, most: float = 10.0, bucket: float = DAY) -> DataFrame:
    """(node, energy): each event adds its amount to what is left of the energy, which never exceeds `most`; decayed to now.

    Each step is x -> min(most, d x + a), and a chain of such steps is one again: with w = 2^(-age / half_life) the result is the least of the sum of all a w, and, for each event, of
    most w and the sum of the a w after it. So a node's events are folded by time bucket, each in a task of its own, and only the buckets of a node meet.
    """
    w = decayed(F.lit(1.0), F.lit(now) - F.col("ts"), half_life)
    rows = events.select("node", F.col("ts").cast("double").alias("ts"), F.col("amount").cast("double").alias("amount")).select(
        "node", "ts", "amount", F.floor(F.col("ts") / bucket).alias("bucket"), w.alias("w")
    )
    within = Window.partitionBy("node", "bucket").orderBy("ts", "amount").rowsBetween(Window.unboundedPreceding, 0)
    folded = rows.withColumn("so_far", F.sum(F.col("amount") * F.col("w")).over(within)).groupBy("node", "bucket").agg(
        F.sum(F.col("amount") * F.col("w")).alias("gain"), F.min(most * F.col("w") - F.col("so_far")).alias("cut")
    )
    before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("cut", F.col("cut") - F.coalesce(F.sum("gain").over(before), F.lit(0.0)))
    return placed.groupBy("node").agg(F.sum("gain").alias("total"), F.min("cut").alias("cut")).select(
        "node", (F.col("total") + F.least(F.lit(0.0), F.col("cut"))).alias("energy")
    )


def scar(events: DataFrame, now: float, half_life: float = 30 * DAY, most: float | None = None, heals: DataFrame | None = None) -> DataFrame:
    """(node, intensity): what is left of all marks, a plain sum that is added up before the shuffle; with `most` no node has more than that.

    heals (node, ts): marks of a node up to its last healing no longer count.
    """
    if heals is not None:
        last = heals.groupBy("node").agg(F.max("ts").alias("healed"))
        events = events.join(last, "node", "left").where("healed IS NULL OR ts > healed")
    total = F.sum(decayed(F.col("amount").cast("double"), now - F.col("ts"), half_life))
    return events.groupBy("node").agg((F.least(F.lit(most), total) if most is not None else total).alias("intensity"))


def energy_score(e: Column, reference: float = 1.0) -> Column:
    return 1 - F.exp(-e / reference)


def half_life_by_degree(half_life: float, degree: Column, alpha: float) -> Column:
    """Well-connected nodes fade more slowly."""
    return half_life * (1 + alpha * F.ln(1 + degree))


def mutation_score(count: Column, reference: float = 100.0) -> Column:
    return F.least(F.lit(1.0), F.ln(1 + count) / F.ln(F.lit(1 + reference)))


def retention(days: Column, stability: Column) -> Column:
    """Share remembered after days: 1 / (1 + days / (9 stability))."""
    return F.when(stability <= 0, F.lit(0.0)).otherwise(1 / (1 + days / (9 * stability)))


def next_review_days(stability: Column, wanted: float) -> Column:
    """Days until the share remembered falls to `wanted`."""
    if wanted >= 1:
        return F.lit(0.0)
    return 9 * stability * (1 / wanted - 1) if wanted > 0 else F.lit(float("inf"))
