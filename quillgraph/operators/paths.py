"""Walks and shortest paths as joins, one for each hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _allowed(mode: str) -> Column | None:
    """Whether the next hop (id, dst) may follow a walk (start, nodes, edges)."""
    if mode == "TRAIL":
        return ~F.array_contains("edges", F.col("id"))
    if mode == "ACYCLIC":
        return ~F.array_contains("nodes", F.col("dst"))
    if mode == "SIMPLE":
        return (F.col("dst") == F.col("start")) | ~F.array_contains("nodes", F.col("dst"))
    return None


def walks(starts: DataFrame, column: str, hops: DataFrame, low: int, high: int, mode: str = "WALK") -> DataFrame:
    """(start, node, length, nodes, edges) of all walks of low to high hops from the starts; hops: (src, dst, id).

    The frontier of a depth is one join of the depth before with the edge table; the rows of the wanted depths are stacked. With
    SIMPLE a walk that is back at its start goes no further.
    """
    long_list = "array<bigint>"
    frontier = starts.select(
        F.col(column).alias("start"), F.col(column).alias("node"), F.lit(0).cast("long").alias("length"),
        F.array(F.col(column)).cast(long_list).alias("nodes"), F.array().cast(long_list).alias("edges"),
    )
    found = [frontier] if low == 0 else []
    test = _allowed(mode)
    for depth in range(1, high + 1):
        on = frontier.where((F.col("length") == 0) | (F.col("node") != F.col("start"))) if mode == "SIMPLE" else frontier
        step = on.join(hops, F.col("node") == F.col("src"))
        if test is not None:
            step = step.where(test)
        frontier = step.select(
            "start", F.col("dst").alias("node"), F.lit(depth).cast("long").alias("length"),
            F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("id")).alias("edges"),
        )
        if depth >= max(low, 1):
            found.append(frontier)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def shortest_lengths(pairs: DataFrame, hops: DataFrame, most: int | None = None, count_paths: bool = False) -> DataFrame:
    """(start, goal, length, paths) for those pairs (start, goal) that a path connects; paths: number of shortest ones.

    A breadth-first frontier for all starts at once: each node of a start is kept at its first depth, and numbers of paths are added up over
    predecessors. A start ends when its goals are reached or nothing new is.
    """
    from .iterate import Rounds

    rounds = Rounds(pairs.sparkSession)
    pairs = rounds.keep(pairs.distinct())
    steps = hops.groupBy("src", "dst").agg(F.count("*").alias("ways"))
    seen = rounds.keep(pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("paths")))
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        reached = (
            frontier.join(steps, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node"))
            .agg(F.sum(F.col("paths") * F.col("ways")).cast("long").alias("paths"))
        )
        new = reached.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = rounds.keep(new.select("start", "node", F.lit(depth).cast("long").alias("length"), "paths"))
        if frontier.isEmpty():
            break
        seen = rounds.keep(seen.unionByName(frontier))
        open_ = pairs.join(seen.select("start", F.col("node").alias("goal")), ["start", "goal"], "left_anti")
        frontier = frontier.join(open_.select("start").distinct(), "start", "left_semi")
        if open_.isEmpty():
            break
    return pairs.join(seen.withColumnRenamed("node", "goal"), ["start", "goal"])
