"""Graph algorithms as rounds of joins and aggregations.

Unless it says otherwise an algorithm takes directed edges (src, dst), counts parallel edges, and gives every edge weight 1. Tables of
rounds are checkpointed every round. Nothing but single counts comes to the driver, except where an algorithm is marked as
sequential: those gather the edges and check first that there are at most SEQUENTIAL_EDGES.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, stacked
from .iterate import Rounds

SEQUENTIAL_EDGES = 2_000_000


def vertices(g: PropertyGraph) -> DataFrame:
    return stacked([df.select("id") for df in g.nodes.values()]).distinct()


def arcs(g: PropertyGraph, weight: str | None = None, types: list[str] | None = None) -> DataFrame:
    e = g.edge_scan(types)
    return e.select("src", "dst", (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"))


def _local_edges(g: PropertyGraph, weight: str | None = None) -> list[tuple[int, int, float]]:
    e = arcs(g, weight)
    if e.limit(SEQUENTIAL_EDGES + 1).count() > SEQUENTIAL_EDGES:
        raise ValueError(f"this algorithm is sequential and takes at most {SEQUENTIAL_EDGES} edges")
    return [tuple(r) for r in e.orderBy("src", "dst").collect()]


def degree_centrality(g: PropertyGraph, normalized: bool = False) -> DataFrame:
    e = arcs(g)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    in_ = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    v = vertices(g)
    d = v.join(out, "id", "left").join(in_, "id", "left").select(
        F.col("id").alias("node_id"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree")
    ).withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))
    if not normalized:
        return d
    n = v.agg((F.count("*") - 1).alias("n"))
    scale = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0)).alias(c)
    return d.crossJoin(F.broadcast(n)).select("node_id", *[scale(c) for c in ("in_degree", "out_degree", "total_degree")])


def pagerank(g: PropertyGraph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, seeds: DataFrame | None = None) -> DataFrame:
    """(node_id, score). Mass of nodes without out-edges is spread evenly (to the seeds, if there are any). Stops at the largest change below tolerance."""
    r = Rounds(g.spark)
    v = vertices(g)
    out = arcs(g).groupBy("src", "dst").agg(F.count("*").alias("k"))
    degree = arcs(g).groupBy("src").agg(F.count("*").alias("d"))
    steps = r.keep(out.join(degree, "src").select("src", "dst", (F.col("k") / F.col("d")).alias("share")))
    # Even without seeds every node has a share of the jumps; with seeds only they have.
    n = v.count()
    if seeds is None:
        jump = v.withColumn("jump", F.lit(1.0 / max(n, 1)))
    else:
        own = seeds.select("id").distinct().join(v, "id", "left_semi")
        jump = v.join(own.withColumn("jump", F.lit(1.0 / max(own.count(), 1))), "id", "left").fillna(0.0, ["jump"])
    base = r.keep(
        v.join(jump, "id").join(degree.withColumnRenamed("src", "id"), "id", "left")
        .select("id", (F.lit(1.0 / n) if seeds is None else F.col("jump")).alias("start"), "jump", F.col("d").isNull().alias("dangling"))
    ) if n else v.select("id", F.lit(0.0).alias("start"), F.lit(0.0).alias("jump"), F.lit(True).alias("dangling"))
    rank = base.select("id", F.col("start").alias("score"), "jump", "dangling")
    for _ in range(max_iterations if n else 0):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        got = rank.join(steps, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = rank.withColumnRenamed("score", "was").join(got, "id", "left").crossJoin(F.broadcast(lost)).select(
            "id",
            ((1 - damping) * F.col("jump") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("jump"))).alias("score"),
            "jump", "dangling", "was",
        )
        new = r.keep(new)
        change = new.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        rank = new.drop("was")
        if change < tolerance:
            break
    return rank.select(F.col("id").alias("node_id"), "score")


def hits(g: PropertyGraph, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node_id, hub, authority): authorities from the hubs before, hubs from the new authorities, both of length 1."""
    r = Rounds(g.spark)
    v, e = r.keep(vertices(g)), r.keep(arcs(g).groupBy("src", "dst").agg(F.count("*").alias("k")))
    n = v.count()
    score = v.select("id", F.lit(1 / max(n, 1) ** 0.5).alias("hub"), F.lit(1 / max(n, 1) ** 0.5).alias("authority"))

    def unit(df: DataFrame, c: str) -> DataFrame:
        total = df.agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias("len"))
        return df.crossJoin(F.broadcast(total)).withColumn(c, F.coalesce(F.try_divide(F.col(c), F.col("len")), F.lit(0.0))).drop("len")

    for _ in range(max_iterations if n else 0):
        a = score.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("hub") * F.col("k")).alias("authority"))
        a = r.keep(unit(v.join(a, "id", "left").fillna(0.0), "authority"))
        h = a.join(e, F.col("id") == F.col("dst")).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("authority") * F.col("k")).alias("hub"))
        h = unit(v.join(h, "id", "left").fillna(0.0), "hub")
        was = score.select("id", F.col("hub").alias("h0"), F.col("authority").alias("a0"))
        new = r.keep(h.join(a, "id").join(was, "id").select("id", "hub", "authority", F.greatest(F.abs(F.col("hub") - F.col("h0")), F.abs(F.col("authority") - F.col("a0"))).alias("change")))
        change = new.agg(F.max("change")).first()[0]
        score = new.select("id", "hub", "authority")
        if change < tolerance:
            break
    return score.withColumnRenamed("id", "node_id")


def connected_components(g: PropertyGraph) -> DataFrame:
    """(node_id, component_id): weak components, each with its smallest node."""
    r = Rounds(g.spark)
    e = g.simple_edges()
    both = r.keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = r.keep(vertices(g).select("id", F.col("id").alias("c")))
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("c").alias("m"))
        low = label.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        jump = label.select(F.col("id").alias("l"), F.col("c").alias("beyond"))
        new = r.keep(low.join(jump, F.col("c") == F.col("l")).select("id", F.least("c", "beyond").alias("c"), "was"))
        if new.where("c <> was").isEmpty():
            return new.select(F.col("id").alias("node_id"), F.col("c").alias("component_id"))
        label = new.select("id", "c")


def strongly_connected_components(g: PropertyGraph) -> DataFrame:
    """(node_id, component_id): strong components by their smallest node.

    Forward colouring: each node takes the smallest node that reaches it; in each colour what reaches the root backwards is a component,
    which is taken out; the rest is coloured again.
    """
    r = Rounds(g.spark)
    left = r.keep(vertices(g))
    e = r.keep(arcs(g).select("src", "dst").where("src <> dst").distinct())
    done = None
    while not left.isEmpty():
        colour = _spread_min(r, left.select("id", F.col("id").alias("c")), e)
        same = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(
            colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst"
        ).where("cs = cd").select("src", "dst")
        # Backwards from each root, within its colour.
        reached = _reach(r, colour.where("id = c").select("id"), same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = r.keep(colour.join(reached, "id", "left_semi").select(F.col("id").alias("node_id"), F.col("c").alias("component_id")))
        done = found if done is None else r.keep(done.unionByName(found))
        left = r.keep(left.join(found.select(F.col("node_id").alias("id")), "id", "left_anti"))
        for end in ("src", "dst"):
            e = e.join(found.select(F.col("node_id").alias(end)), end, "left_anti").select("src", "dst")
        e = r.keep(e)
    return done if done is not None else left.select(F.col("id").alias("node_id"), F.col("id").alias("component_id"))


def _spread_min(r: Rounds, label: DataFrame, e: DataFrame) -> DataFrame:
    while True:
        near = label.join(e, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("c").alias("m"))
        new = r.keep(label.join(near, F.col("id") == F.col("dst"), "left").select("id", F.least("c", "m").alias("c"), F.col("c").alias("was")))
        if new.where("c <> was").isEmpty():
            return new.select("id", "c")
        label = new.select("id", "c")


def _reach(r: Rounds, start: DataFrame, e: DataFrame) -> DataFrame:
    seen = frontier = r.keep(start)
    while True:
        new = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = r.keep(new)
        if frontier.isEmpty():
            return seen
        seen = r.keep(seen.unionByName(frontier))


def bfs(g: PropertyGraph, start: int) -> DataFrame:
    """(node_id, depth) of all that out-edges reach from start."""
    r = Rounds(g.spark)
    e = r.keep(arcs(g).select("src", "dst").distinct())
    seen = frontier = r.keep(vertices(g).where(F.col("id") == start).select("id", F.lit(0).cast("long").alias("depth")))
    depth = 0
    while True:
        depth += 1
        new = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = r.keep(new.select("id", F.lit(depth).cast("long").alias("depth")))
        if frontier.isEmpty():
            return seen.withColumnRenamed("id", "node_id")
        seen = r.keep(seen.unionByName(frontier))


def dfs(g: PropertyGraph, start: int) -> DataFrame:
    """(node_id, position): preorder, neighbours by id. Sequential."""
    near = defaultdict(list)
    for a, b, _ in _local_edges(g):
        near[a].append(b)
    order, seen, stack = [], set(), [start]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            order.append(x)
            stack += sorted(set(near[x]), reverse=True)
    return g.spark.createDataFrame([(x, i) for i, x in enumerate(order)], "node_id long, position long")


def sssp(g: PropertyGraph, source: int, weight: str | None = None, rounds: int | None = None) -> DataFrame:
    """(node_id, distance) over out-edges: relaxed until nothing improves, or for the given number of rounds."""
    r = Rounds(g.spark)
    e = r.keep(arcs(g, weight).groupBy("src", "dst").agg(F.min("w").alias("w")))
    dist = r.keep(vertices(g).where(F.col("id") == source).select("id", F.lit(0.0).alias("d"), F.lit(True).alias("new")))
    done = 0
    while rounds is None or done < rounds:
        done += 1
        step = dist.where("new").join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"))
        best = step.groupBy("id").agg(F.min("d").alias("b"))
        dist = r.keep(
            dist.join(best, "id", "full").select("id", F.least("d", "b").alias("d"), (F.coalesce(F.col("b") < F.col("d"), F.col("b").isNotNull() & F.col("d").isNull())).alias("new"))
        )
        if dist.where("new").isEmpty():
            break
    return dist.select(F.col("id").alias("node_id"), F.col("d").alias("distance"))


def dijkstra(g: PropertyGraph, source: int, target: int | None = None, weight: str | None = None) -> DataFrame:
    if not arcs(g, weight).where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    d = sssp(g, source, weight)
    return d if target is None else d.where(F.col("node_id") == target)


def bellman_ford(g: PropertyGraph, source: int, weight: str | None = None) -> DataFrame:
    """(node_id, distance, has_negative_cycle)."""
    n = vertices(g).count()
    d = sssp(g, source, weight, rounds=max(n - 1, 1))
    e = arcs(g, weight)
    better = e.join(d.select(F.col("node_id").alias("src"), F.col("distance").alias("ds")), "src").join(
        d.select(F.col("node_id").alias("dst"), F.col("distance").alias("dd")), "dst"
    ).where("ds + w < dd - 1e-12")
    return d.withColumn("has_negative_cycle", F.lit(not better.isEmpty()))


def floyd_warshall(g: PropertyGraph, weight: str | None = None) -> DataFrame:
    """(source, target, distance) of all connected pairs, by squaring: after k rounds all paths of up to 2^k edges."""
    r = Rounds(g.spark)
    own = vertices(g).select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0.0).alias("d"))
    d = r.keep(arcs(g, weight).select(F.col("src").alias("s"), F.col("dst").alias("t"), F.col("w").alias("d")).unionByName(own).groupBy("s", "t").agg(F.min("d").alias("d")))
    while True:
        right = d.select(F.col("s").alias("m"), F.col("t").alias("t2"), F.col("d").alias("d2"))
        longer = d.join(right, F.col("t") == F.col("m")).groupBy(F.col("s"), F.col("t2").alias("t")).agg(F.min(F.col("d") + F.col("d2")).alias("n"))
        new = r.keep(longer.join(d, ["s", "t"], "left").select("s", "t", F.least("d", "n").alias("d"), F.coalesce(F.col("n") < F.col("d") - 1e-12, F.lit(True)).alias("new")))
        d = new.select("s", "t", "d")
        if new.where("new").isEmpty():
            return d.select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("d").alias("distance"))


def _all_pairs(g: PropertyGraph, r: Rounds) -> list[DataFrame]:
    """Breadth-first levels from every node: (s, id, depth, paths)."""
    e = r.keep(arcs(g).select("src", "dst").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("k")))
    seen = frontier = r.keep(vertices(g).select(F.col("id").alias("s"), "id", F.lit(0).cast("long").alias("depth"), F.lit(1.0).alias("paths")))
    levels = [frontier]
    while True:
        step = frontier.join(e, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth")).agg(F.sum(F.col("paths") * F.col("k")).alias("paths"))
        frontier = r.keep(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", "depth", "paths"))
        if frontier.isEmpty():
            return [*levels, e]
        levels.append(frontier)
        seen = r.keep(seen.unionByName(frontier))


def closeness_centrality(g: PropertyGraph, wf_improved: bool = False) -> DataFrame:
    """(node_id, closeness): reachable nodes over the sum of their distances; improved: times reachable / (n - 1)."""
    r = Rounds(g.spark)
    *levels, _ = _all_pairs(g, r)
    far = stacked(levels).where("depth > 0").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("k"), F.sum("depth").alias("sum"))
    n = vertices(g).count()
    value = F.col("k") / F.col("sum") * (F.col("k") / (n - 1) if wf_improved else F.lit(1.0))
    return vertices(g).join(far, "id", "left").select(F.col("id").alias("node_id"), F.coalesce(value, F.lit(0.0)).alias("closeness"))


def betweenness_centrality(g: PropertyGraph, normalized: bool = True) -> DataFrame:
    """(node_id, score): Brandes from all nodes at once, level by level; normalized by 2 / ((n - 1)(n - 2))."""
    r = Rounds(g.spark)
    *levels, e = _all_pairs(g, r)
    n = vertices(g).count()
    gained, below = [], None
    for level in reversed(levels[1:]):
        depth = level
        if below is not None:
            up = level.join(e, F.col("id") == F.col("src")).select("s", "id", "paths", "dst", "k").join(
                below.select("s", F.col("id").alias("dst"), F.col("paths").alias("p2"), F.col("delta").alias("d2")), ["s", "dst"]
            )
            delta = up.groupBy("s", "id").agg(F.sum(F.col("k") * F.col("paths") / F.col("p2") * (1 + F.col("d2"))).alias("delta"))
            depth = level.join(delta, ["s", "id"], "left").fillna(0.0, ["delta"])
        else:
            depth = level.withColumn("delta", F.lit(0.0))
        below = r.keep(depth.select("s", "id", "paths", "delta"))
        gained.append(below.select("id", "delta"))
    score = stacked(gained).groupBy("id").agg(F.sum("delta").alias("b")) if gained else vertices(g).select("id", F.lit(0.0).alias("b"))
    scale = 2 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    return vertices(g).join(score, "id", "left").select(F.col("id").alias("node_id"), (F.coalesce("b", F.lit(0.0)) * scale).alias("score"))


def triangles(g: PropertyGraph) -> DataFrame:
    """(a, b, c) with each triangle once: edges point from the end with fewer neighbours, so hubs make few pairs."""
    e = g.simple_edges()
    degree = stacked([e.select(F.col("a").alias("v")), e.select(F.col("b").alias("v"))]).groupBy("v").agg(F.count("*").alias("d"))
    d = lambda end: degree.select(F.col("v").alias(end), F.col("d").alias("d" + end))
    with_d = e.join(d("a"), "a").join(d("b"), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    turned = with_d.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    two = turned.select("u", F.col("v").alias("x")).join(turned.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = e.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return two.join(closed, ["x", "y"]).select(F.least("u", "x").alias("a"), F.greatest(F.least("u", "y"), F.least(F.greatest("u", "x"), "y")).alias("b"), F.greatest("u", "y").alias("c"))


def triangle_count(g: PropertyGraph) -> DataFrame:
    return triangles(g).agg(F.count("*").alias("triangles"))


def clustering_coefficient(g: PropertyGraph) -> DataFrame:
    """(node_id, coefficient, triangles); 0 with fewer than two neighbours."""
    t = triangles(g)
    per = stacked([t.select(F.col(c).alias("id")) for c in "abc"]).groupBy("id").agg(F.count("*").alias("t"))
    e = g.simple_edges()
    degree = stacked([e.select(F.col("a").alias("id")), e.select(F.col("b").alias("id"))]).groupBy("id").agg(F.count("*").alias("d"))
    c = F.coalesce(F.try_divide(2 * F.col("t"), F.col("d") * (F.col("d") - 1)), F.lit(0.0))
    return vertices(g).join(degree, "id", "left").join(per, "id", "left").select(F.col("id").alias("node_id"), c.alias("coefficient"), F.coalesce("t", F.lit(0)).alias("triangles"))


def global_clustering(g: PropertyGraph) -> DataFrame:
    return clustering_coefficient(g).agg(F.avg("coefficient").alias("coefficient"))


def label_propagation(g: PropertyGraph, max_iterations: int = 100) -> DataFrame:
    """(node_id, community_id): synchronous rounds; most frequent label of the undirected neighbours, smallest on ties. A
    community's id is its smallest node. Differs from the sequential form, in which nodes see labels of the same round."""
    r = Rounds(g.spark)
    e = arcs(g).select("src", "dst")
    both = r.keep(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("k")))
    label = r.keep(vertices(g).select("id", F.col("id").alias("c")))
    for _ in range(max_iterations):
        votes = both.join(label, F.col("dst") == F.col("id")).groupBy("src", "c").agg(F.sum("k").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("c")).alias("least"))).alias("b")).select("src", (-F.col("b.least")).alias("m"))
        new = r.keep(label.join(best, F.col("id") == F.col("src"), "left").select("id", F.coalesce("m", "c").alias("c"), F.col("c").alias("was")))
        label = new.select("id", "c")
        if new.where("c <> was").isEmpty():
            break
    name = label.groupBy("c").agg(F.min("id").alias("community_id"))
    return label.join(name, "c").select(F.col("id").alias("node_id"), "community_id")


#: So many ids, 8 bytes each, are broadcast to the edges at once.
PEELED_IDS = 1_000_000


def kcore(g: PropertyGraph, k: int | None = None) -> DataFrame:
    """(node_id, core_number), or with k (node_id, in_k_core), on the simple undirected graph: nodes with fewer neighbours are peeled off, level by level.

    Edges are written once and not shuffled again: those who go are broadcast to them, PEELED_IDS of a level about at most, the rest of the level in further rounds.
    A round rewrites the numbers of neighbours of those who stay; edges are rewritten without those who went when these are too many to be broadcast again.
    """
    r = Rounds(g.spark)
    e = r.store(g.simple_edges())
    ends = stacked([e.select(F.col("a").alias("id")), e.select(F.col("b").alias("id"))])
    left = r.store(ends.groupBy("id").agg(F.count("*").alias("d")))
    level, peeled, since, n_since, turn = (0 if k is None else k - 1), [], [], 0, 0
    while True:
        least, n = left.agg(F.min("d"), F.count_if(F.col("d") <= level)).first()
        if not n and (least is None or k is not None):
            break
        if not n:
            level, n = least, left.where(F.col("d") == least).count()
        parts = -(-n // PEELED_IDS)
        turn += 1  # another slice each round, as one may hold no id
        goes = (F.col("d") <= level) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)) == 0)
        gone = r.store(left.where(goes).select("id", F.lit(level).cast("long").alias("core")))
        n = n if parts == 1 else gone.count()
        if since and n_since + n > PEELED_IDS:
            ids = F.broadcast(stacked(since).select("id"))
            fewer = r.store(e.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").join(ids.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
            r.drop(e)
            e, since, n_since = fewer, [], 0
        since, n_since = [*since, gone], n_since + n
        peeled.append(gone)
        side = lambda x: F.broadcast(gone.select(F.col("id").alias(x), F.lit(True).alias("goes_" + x)))  # noqa: B023, E731
        marked = e.join(side("a"), "a", "left").join(side("b"), "b", "left")
        lost = (
            marked.where(F.col("goes_a").isNull() != F.col("goes_b").isNull())
            .groupBy(F.when(F.col("goes_a").isNull(), F.col("a")).otherwise(F.col("b")).alias("id")).agg(F.count("*").alias("less"))
        )
        fewer = r.store(left.where(~goes).join(lost, "id", "left").select("id", (F.col("d") - F.coalesce("less", F.lit(0))).alias("d")))
        r.drop(left)
        left = fewer
    r.drop(e)
    v = vertices(g)
    if k is not None:
        return v.join(left.select("id", F.lit(True).alias("in")), "id", "left").select(F.col("id").alias("node_id"), (F.coalesce("in", F.lit(False)) | F.lit(k <= 0)).alias("in_k_core"))
    r.drop(left)
    if not peeled:
        return v.select(F.col("id").alias("node_id"), F.lit(0).cast("long").alias("core_number"))
    core = stacked(peeled)
    return v.join(core, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("core", F.lit(0)).cast("long").alias("core_number"))


def topological_sort(g: PropertyGraph) -> DataFrame:
    """(node_id, level, position): nodes without predecessors first, level by level, ids within; empty if there is a cycle."""
    r = Rounds(g.spark)
    left, e = r.keep(vertices(g)), r.keep(arcs(g).select("src", "dst").distinct())
    done, level = None, 0
    while not left.isEmpty():
        free = r.keep(left.join(e.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(level).cast("long").alias("level")))
        if free.isEmpty():
            return g.spark.createDataFrame([], "node_id long, level long, position long")
        done = free if done is None else r.keep(done.unionByName(free))
        left = r.keep(left.join(free, "id", "left_anti"))
        e = r.keep(e.join(free.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"))
        level += 1
    w = Window.orderBy("level", "id")
    return done.select(F.col("id").alias("node_id"), "level", (F.row_number().over(w) - 1).cast("long").alias("position"))


def minimum_spanning_forest(g: PropertyGraph, weight: str | None = None) -> DataFrame:
    """(source, target, weight) by Boruvka: each round every component takes its lightest edge to another one; ties by the ends."""
    r = Rounds(g.spark)
    e = arcs(g, weight).where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("w"))
    e = r.keep(e)
    label = r.keep(vertices(g).select("id", F.col("id").alias("c")))
    tree = r.keep(e.limit(0))
    while True:
        side = lambda x: label.select(F.col("id").alias(x), F.col("c").alias("c" + x))
        across = e.join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
        key = F.struct("w", "a", "b")
        best = across.select(F.col("ca").alias("c"), key.alias("e")).unionByName(across.select(F.col("cb").alias("c"), key.alias("e"))).groupBy("c").agg(F.min("e").alias("e"))
        chosen = r.keep(best.select("e.a", "e.b", "e.w").distinct())
        if chosen.isEmpty():
            return tree.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("w").alias("weight"))
        tree = r.keep(tree.unionByName(chosen))
        part = PropertyGraph(g.spark, {"V": label.select("id", F.array(F.lit("V")).alias("labels"))}, {"E": tree.select(F.lit(0).alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("E").alias("type"))})
        label = connected_components(part).select(F.col("node_id").alias("id"), F.col("component_id").alias("c"))


def khop(g: PropertyGraph, center: int, k: int, rel_types: list[str] | None = None, max_neighbors_per_hop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes within k undirected hops (id, depth) over edges of these types and the edges between them. max_neighbors_per_hop: so many neighbours of a node, those with the
    smallest ids, are followed; 0: all."""
    both = arcs(g, types=rel_types).select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if max_neighbors_per_hop:
        w = Window.partitionBy("src").orderBy("dst")
        both = both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_neighbors_per_hop).drop("_n")
    seen = frontier = vertices(g).where(F.col("id") == center).select("id", F.lit(0).cast("long").alias("depth"))
    for depth in range(1, k + 1):
        new = frontier.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = new.select("id", F.lit(depth).cast("long").alias("depth"))
        seen = seen.unionByName(frontier)
    e = g.edge_scan(rel_types)
    inside = e.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_semi")
    return seen, inside


def neighbour_similarity(g: PropertyGraph, metric: str = "jaccard", node: int | None = None) -> DataFrame:
    """(node1, node2, score) of nodes that share a neighbour; with node only its pairs. metric: jaccard, overlap, cosine, adamic_adar, resource_allocation."""
    e = g.simple_edges()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    via = both.join(degree.select(F.col("a").alias("b"), F.col("d").alias("dv")), "b")
    left = via if node is None else via.where(F.col("a") == node)
    right = both.select(F.col("a").alias("a2"), "b")
    pairs = left.join(right, "b").where("a < a2" if node is None else "a <> a2")
    weight = {"adamic_adar": F.when(F.col("dv") > 1, 1 / F.ln("dv")).otherwise(0.0), "resource_allocation": 1 / F.col("dv")}.get(metric, F.lit(1.0))
    s = pairs.groupBy("a", "a2").agg(F.sum(weight).alias("s")).join(degree.withColumnRenamed("d", "d1"), "a").join(degree.select(F.col("a").alias("a2"), F.col("d").alias("d2")), "a2")
    score = {
        "jaccard": F.col("s") / (F.col("d1") + F.col("d2") - F.col("s")), "overlap": F.col("s") / F.least("d1", "d2"),
        "cosine": F.col("s") / F.sqrt(F.col("d1") * F.col("d2")), "adamic_adar": F.col("s"), "resource_allocation": F.col("s"),
    }[metric]
    return s.select(F.col("a").alias("node1"), F.col("a2").alias("node2"), score.alias("score"))


def similarity_topk(g: PropertyGraph, node: int, k: int = 10, metric: str = "jaccard") -> DataFrame:
    return neighbour_similarity(g, metric, node).orderBy(F.col("score").desc(), "node2").limit(k)


def articulation_and_bridges(g: PropertyGraph) -> tuple[list[int], list[tuple[int, int]]]:
    """Cut nodes and bridges of the undirected graph by depth-first low points. Sequential."""
    near = defaultdict(list)
    for i, (a, b, _) in enumerate(_local_edges(g)):
        if a != b:
            near[a].append((b, i))
            near[b].append((a, i))
    low, order, cut, bridges = {}, {}, set(), []
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, None, iter(near[root]))], 0
        while stack:
            x, by, rest = stack[-1]
            for y, i in rest:
                if i == by:
                    continue
                if y in order:
                    low[x] = min(low[x], order[y])
                    continue
                order[y] = low[y] = len(order)
                stack.append((y, i, iter(near[y])))
                break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[x])
                    if low[x] > order[up]:
                        bridges.append((min(up, x), max(up, x)))
                    if up == root:
                        children += 1
                    elif low[x] >= order[up]:
                        cut.add(up)
        if children > 1:
            cut.add(root)
    return sorted(cut), sorted(bridges)


def articulation_points(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame([(x,) for x in articulation_and_bridges(g)[0]], "node_id long")


def bridges(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame(articulation_and_bridges(g)[1], "source long, target long")


def max_flow(g: PropertyGraph, source: int, sink: int, capacity: str | None = None, cost: str | None = None) -> DataFrame:
    """(max_flow, total_cost): shortest augmenting paths, cheapest ones if a cost is given. Parallel edges of one cost add up, those of other costs are edges of their own. Sequential."""
    e = g.edge_scan()
    cap = F.coalesce(F.col(capacity).cast("double"), F.lit(1.0)) if capacity else F.lit(1.0)
    price = F.coalesce(F.col(cost).cast("double"), F.lit(0.0)) if cost else F.lit(0.0)
    rows = e.groupBy("src", "dst", price.alias("price")).agg(F.sum(cap).alias("cap")).select("src", "dst", "cap", "price").limit(SEQUENTIAL_EDGES + 1).collect()
    if len(rows) > SEQUENTIAL_EDGES:
        raise ValueError(f"this algorithm is sequential and takes at most {SEQUENTIAL_EDGES} edges")
    to, room, fee, out = [], [], [], defaultdict(list)
    for a, b, c, p in sorted(tuple(r) for r in rows):
        for x, y, r, f in ((a, b, c, p), (b, a, 0.0, -p)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            fee.append(f)
    flow = total = 0.0
    while source != sink:
        best, by, queue = {source: 0.0}, {}, [source]
        for x in queue:  # label-correcting; without costs the first label stands, which is breadth-first
            for i in out[x]:
                d = best[x] + fee[i]
                if room[i] > 1e-12 and (to[i] not in best or d < best[to[i]] - 1e-12):
                    best[to[i]], by[to[i]] = d, i
                    queue.append(to[i])
        if sink not in by:
            break
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        add = min(room[i] for i in path)
        for i in path:
            room[i] -= add
            room[i ^ 1] += add
            total += add * fee[i]
        flow += add
    return g.spark.createDataFrame([(flow, total)], "max_flow double, total_cost double")


def louvain(g: PropertyGraph, resolution: float = 1.0, sweeps: int = 100) -> DataFrame:
    """(node_id, community_id): one level of local moving for modularity, nodes in order of id, ties to the smaller community. Sequential.

    Only nodes with edges are gathered; each other node is its own community.
    """
    near, total = defaultdict(lambda: defaultdict(float)), 0.0
    for a, b, _ in _local_edges(g):
        near[a][b] += 1.0
        near[b][a] += 1.0
        total += 1.0
    home = _local_moves(near, total, resolution, sweeps) if total else {}
    least: dict[int, int] = {}
    for x in sorted(near):
        least.setdefault(home[x], x)
    found = g.spark.createDataFrame([(x, least[home[x]]) for x in sorted(near)], "id long, community_id long")
    return vertices(g).join(found, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("community_id", "id").alias("community_id"))


def contracted(g: PropertyGraph, groups: DataFrame) -> DataFrame:
    """(src, dst, n) between groups (id, group): edges of members, added up; loops inside a group are left out."""
    side = lambda x: groups.select(F.col("id").alias(x), F.col("group").alias("g" + x))
    e = arcs(g).join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    e = e.select(F.coalesce("gsrc", "src").alias("src"), F.coalesce("gdst", "dst").alias("dst"))
    return e.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def heat_diffusion(g: PropertyGraph, values: DataFrame, iterations: int = 4, alpha: float = 0.4) -> DataFrame:
    """(node_id, value): value' = alpha * value + (1 - alpha) * mean over undirected neighbours, from values (id, value)."""
    r = Rounds(g.spark)
    e = g.simple_edges()
    both = r.keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    v = r.keep(vertices(g).join(values, "id", "left").fillna(0.0, ["value"]))
    for _ in range(iterations):
        mean = both.join(v, F.col("b") == F.col("id")).groupBy("a").agg(F.avg("value").alias("m"))
        v = r.keep(v.join(mean, F.col("id") == F.col("a"), "left").select("id", (alpha * F.col("value") + (1 - alpha) * F.coalesce("m", "value")).alias("value")))
    return v.withColumnRenamed("id", "node_id")


def astar(g: PropertyGraph, source: int, target: int, weight: str | None = None, heuristic: DataFrame | None = None) -> DataFrame:
    """(node_id, distance) of target, if it can be reached. heuristic (id, estimate): a lower bound of the way from a node to the target.

    Rounds of relaxation as in sssp, but what can't beat the best way to the target found so far (distance + estimate) isn't followed.
    """
    r = Rounds(g.spark)
    e = r.keep(arcs(g, weight).groupBy("src", "dst").agg(F.min("w").alias("w")))
    rest = heuristic.select("id", F.col("estimate").cast("double").alias("h")) if heuristic is not None else None
    dist = r.keep(vertices(g).where(F.col("id") == source).select("id", F.lit(0.0).alias("d"), F.lit(True).alias("new")))
    while True:
        best = dist.where(F.col("id") == target).agg(F.min("d")).first()[0]
        front = dist.where("new")
        if best is not None:
            front = front.where(F.col("d") < best) if rest is None else front.join(rest, "id", "left").where(F.col("d") + F.coalesce("h", F.lit(0.0)) < best).select("id", "d")
        step = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("b")).groupBy("id").agg(F.min("b").alias("b"))
        dist = r.keep(dist.join(step, "id", "full").select("id", F.least("d", "b").alias("d"), F.coalesce(F.col("b") < F.col("d"), F.col("b").isNotNull() & F.col("d").isNull()).alias("new")))
        if dist.where("new").isEmpty():
            return dist.where(F.col("id") == target).select(F.col("id").alias("node_id"), F.col("d").alias("distance"))


def leiden(g: PropertyGraph, resolution: float = 1.0, levels: int = 20) -> DataFrame:
    """(node_id, community_id): Louvain levels, each community of which is first split into its connected parts; ends when a level moves nothing. A community's id is its
    smallest node. So no community is disconnected. The moves of a level are made one after the other. Sequential."""
    near: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    total = 0.0
    for a, b, _ in _local_edges(g):
        near[a][b] += 1.0
        near[b][a] += 1.0
        total += 1.0
    members = {x: [x] for x in near}
    graph = {x: dict(ys) for x, ys in near.items()}
    for _ in range(levels if total else 0):
        home = _local_moves(graph, total, resolution)
        parts = _connected_parts(graph, home)
        if len(set(parts.values())) == len(graph):
            break
        groups: dict[int, list[int]] = defaultdict(list)
        merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for x in graph:
            groups[parts[x]] += members[x]
            for y, w in graph[x].items():
                merged[parts[x]][parts[y]] += w
        members, graph = dict(groups), {x: dict(ys) for x, ys in merged.items()}
    found = [(x, min(own)) for own in members.values() for x in own]
    placed = g.spark.createDataFrame(found, "id long, community_id long")
    return vertices(g).join(placed, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("community_id", "id").alias("community_id"))


def _local_moves(graph: dict[int, dict[int, float]], total: float, resolution: float, sweeps: int = 100) -> dict[int, int]:
    degree = {x: sum(ys.values()) for x, ys in graph.items()}
    home, weight = {x: x for x in graph}, dict(degree)
    for _ in range(sweeps):
        moved = False
        for x in sorted(graph):
            links: dict[int, float] = defaultdict(float)
            for y, w in graph[x].items():
                if y != x:
                    links[home[y]] += w
            weight[home[x]] -= degree[x]
            gain = {c: links[c] - resolution * degree[x] * weight[c] / (2 * total) for c in {home[x], *links}}
            best = max(gain, key=lambda c: (round(gain[c], 12), c == home[x], -c))  # noqa: B023
            weight[best] += degree[x]
            moved |= best != home[x]
            home[x] = best
        if not moved:
            break
    return home


def _connected_parts(graph: dict[int, dict[int, float]], home: dict[int, int]) -> dict[int, int]:
    part: dict[int, int] = {}
    for root in sorted(graph):
        if root in part:
            continue
        stack = [root]
        part[root] = root
        while stack:
            x = stack.pop()
            for y in graph[x]:
                if y not in part and home[y] == home[root]:
                    part[y] = root
                    stack.append(y)
    return part


def stable_communities(new: DataFrame, old: DataFrame, min_overlap: float = 0.3) -> DataFrame:
    """(node_id, community_id): a new community takes the id of the old one it shares most with, if the Jaccard similarity is at least min_overlap; an old id goes to the best new
    community only. Others keep their new id, raised above all old ones."""
    a = new.select("node_id", F.col("community_id").alias("n"))
    b = old.select("node_id", F.col("community_id").alias("o"))
    both = a.join(b, "node_id").groupBy("n", "o").agg(F.count("*").alias("k"))
    size = lambda df, c: df.groupBy(c).agg(F.count("*").alias("size_" + c))
    like = both.join(size(a, "n"), "n").join(size(b, "o"), "o").withColumn("j", F.col("k") / (F.col("size_n") + F.col("size_o") - F.col("k"))).where(F.col("j") >= min_overlap)
    for_new = like.groupBy("n").agg(F.max(F.struct("j", (-F.col("o")).alias("least"))).alias("m")).select("n", (-F.col("m.least")).alias("o"), F.col("m.j").alias("j"))
    taken = for_new.groupBy("o").agg(F.max(F.struct("j", (-F.col("n")).alias("least"))).alias("m")).select("o", (-F.col("m.least")).alias("n"))
    shift = b.agg((F.coalesce(F.max("o"), F.lit(-1)) + 1).alias("shift"))
    return a.join(taken, "n", "left").crossJoin(F.broadcast(shift)).select("node_id", F.coalesce("o", F.col("n") + F.col("shift")).alias("community_id"))


def spectral_embedding(g: PropertyGraph, dimensions: int = 2) -> DataFrame:
    """(node_id, embedding): the eigenvectors of the normalized Laplacian with the smallest eigenvalues but the first, each with a positive first entry that isn't 0. Sequential: the matrix is dense,
    so at most 5,000 nodes with edges."""
    import numpy as np

    edges = {(min(a, b), max(a, b)) for a, b, _ in _local_edges(g) if a != b}
    nodes = sorted({x for e in edges for x in e})
    if len(nodes) > 5000:
        raise ValueError("spectral_embedding takes at most 5000 nodes with edges")
    place = {x: i for i, x in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        w[place[a], place[b]] = w[place[b], place[a]] = 1.0
    scale = 1 / np.sqrt(w.sum(1)) if len(nodes) else np.zeros(0)
    _, vectors = np.linalg.eigh(np.eye(len(nodes)) - scale[:, None] * w * scale[None, :])
    own = vectors[:, 1 : 1 + dimensions]
    for j in range(own.shape[1]):
        lead = own[np.flatnonzero(np.abs(own[:, j]) > 1e-9)[0], j]
        own[:, j] *= np.sign(lead)
    rows = [(x, [float(v) for v in own[i]]) for x, i in place.items()]
    found = g.spark.createDataFrame(rows, "id long, embedding array<double>")
    return vertices(g).join(found, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("embedding", F.array(*[F.lit(0.0)] * dimensions)).alias("embedding"))


def hilbert_code(x: Column, y: Column, levels: int = 8) -> Column:
    """Place of a cell (x, y) on the Hilbert curve over a grid of 2^levels times 2^levels."""
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    def step(a: Column, side: Column) -> Column:
        rx = F.when(a.x.bitwiseAND(side) > 0, 1).otherwise(0)
        ry = F.when(a.y.bitwiseAND(side) > 0, 1).otherwise(0)
        inner_x, inner_y = a.x.bitwiseAND(side - 1), a.y.bitwiseAND(side - 1)
        # the quadrant is turned, so that the curve goes on where it left
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - inner_x).otherwise(inner_x), F.when(flip, side - 1 - inner_y).otherwise(inner_y)
        return F.struct(
            (a.d + side.cast("long") * side * (3 * rx).bitwiseXOR(ry)).cast("long").alias("d"),
            F.when(ry == 0, fy).otherwise(fx).cast("int").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("int").alias("y"),
        )

    return F.aggregate(F.array(*[F.lit(1 << n) for n in reversed(range(levels))]), start, step).getField("d")


def hilbert_features(g: PropertyGraph, levels: int = 8) -> DataFrame:
    """(node_id, degree_code, rank_code): in and out degree, and degree and clustering, each scaled to the grid by the largest value and read along a Hilbert curve, so that nodes of like
    structure have near codes."""
    r = Rounds(g.spark)
    d, c = degree_centrality(g), clustering_coefficient(g)
    base = r.keep(d.join(c, "node_id").select("node_id", F.log1p("in_degree").alias("i"), F.log1p("out_degree").alias("o"), F.log1p("total_degree").alias("t"), F.col("coefficient").alias("c")))
    top = base.agg(*[F.max(x).alias("top_" + x) for x in "iotc"])
    cell = lambda x: F.when(F.col("top_" + x) > 0, F.floor(F.col(x) / F.col("top_" + x) * ((1 << levels) - 1))).otherwise(0).cast("int")
    cells = r.keep(base.crossJoin(F.broadcast(top)).select("node_id", *[cell(x).alias(x) for x in "iotc"]))
    return cells.select("node_id", hilbert_code(F.col("i"), F.col("o"), levels).alias("degree_code"), hilbert_code(F.col("t"), F.col("c"), levels).alias("rank_code"))


def personalized_pagerank(g: PropertyGraph, seeds: DataFrame, damping: float = 0.85, max_iterations: int = 50, tolerance: float = 1e-8, least: float = 1e-6, budget: int = 50) -> DataFrame:
    """(node_id, score) of the `budget` nodes that walks from the seeds (id) reach most, from `least` on."""
    found = pagerank(g, damping, max_iterations, tolerance, seeds)
    return found.where(F.col("score") >= least).orderBy(F.col("score").desc(), "node_id").limit(budget)
