"""Change logs: what happened to an entity, between epochs, and how a graph stood at an epoch.

A log has the columns entity (long), epoch (long), kind ('create', 'update', 'delete') and after, the state after the change (null after a delete).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(log: DataFrame, entity: int) -> DataFrame:
    return log.where(F.col("entity") == entity).orderBy("epoch")


def changes_since(log: DataFrame, epoch: int) -> DataFrame:
    return log.where(F.col("epoch") >= epoch)


def changes_between(log: DataFrame, first: int, last: int) -> DataFrame:
    """Changes of the epochs first to last, both included."""
    return log.where(F.col("epoch").between(first, last))


def versions(log: DataFrame) -> DataFrame:
    """The log with valid_from and valid_to: a version holds from its epoch until the entity's next one (null: until now)."""
    w = Window.partitionBy("entity").orderBy("epoch")
    return log.withColumn("valid_from", F.col("epoch")).withColumn("valid_to", F.lead("epoch").over(w))


def as_of(versions_: DataFrame, epoch: int) -> DataFrame:
    """Versions that held at an epoch; what was deleted by then is gone."""
    return versions_.where((F.col("valid_from") <= epoch) & (F.col("valid_to").isNull() | (F.col("valid_to") > epoch)) & (F.col("kind") != "delete"))


def state_at(log: DataFrame, epoch: int) -> DataFrame:
    """(entity, epoch, after): the last change of each entity up to an epoch, unless it is a delete. Aggregated before the shuffle, without a window."""
    last = log.where(F.col("epoch") <= epoch).groupBy("entity").agg(F.max(F.struct("epoch", "kind", "after")).alias("l"))
    return last.where("l.kind <> 'delete'").select("entity", "l.epoch", "l.after")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Log rows (entity, kind, after) that lead from one state (entity, after) to another."""
    old, new = before.select("entity", F.col("after").alias("_old"), F.lit(True).alias("_had")), after.select("entity", F.col("after").alias("_new"), F.lit(True).alias("_has"))
    both = old.join(new, "entity", "full")
    kind = F.when(F.col("_had").isNull(), "create").when(F.col("_has").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return both.select("entity", kind.alias("kind"), F.col("_new").alias("after")).where("kind IS NOT NULL")
