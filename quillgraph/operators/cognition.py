"""Scores and memories over graphs: synapses, co-change, risk, activation, stagnation, horizons, engrams and what is derived from them.

Tables have plain columns: node and community ids are long, times are seconds, weights double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from .algorithms import connected_components
from .iterate import Rounds
from .scoring import DAY, decayed, energy_score, mutation_score, retention

#: The weights of the spaced-repetition scheduler, w0 to w18.
FSRS = (0.4072, 1.1829, 3.1262, 15.4722, 7.2102, 0.5316, 1.0651, 0.0046, 1.5400, 0.1192, 1.0100, 1.9395, 0.1100, 0.2900, 2.2700, 0.0460, 0.2000, 1.1000, 0.0600)


def pairs_of(batches: DataFrame, most: int | None = 100) -> DataFrame:
    """(batch, ts, a, b) with a < b for the distinct nodes of each batch (batch, node, ts). Batches of more than `most` nodes say nothing about pairs and are left out; as
    that bounds a batch, no group is larger than most * most / 2 pairs."""
    once = batches.groupBy("batch", "node").agg(F.max("ts").alias("ts"))
    if most is not None:
        small = once.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("batch")
        once = once.join(small, "batch", "left_semi")
    a = once.select("batch", F.col("node").alias("a"), "ts")
    b = once.select("batch", F.col("node").alias("b"), F.col("ts").alias("tb"))
    return a.join(b, "batch").where("a < b").select("batch", F.greatest("ts", "tb").alias("ts"), "a", "b")


def synapses(batches: DataFrame, now: float, half_life: float = 7 * DAY, amount: float = 0.2, first: float = 0.1, most: float = 10.0, total: float = 100.0, prune: float = 0.01) -> DataFrame:
    """(a, b, weight): pairs of nodes that were active together. The first time gives first + amount, each further one amount, all fading; no pair has more than `most`, no node
    more than `total` over all its pairs (they are scaled down in proportion, by the stricter of the two ends), and what is below `prune` is left out. The ceilings hold for the weights now."""
    pairs = pairs_of(batches)
    order = Window.partitionBy("a", "b")
    boosts = pairs.withColumn("_first", F.min("ts").over(order)).groupBy("a", "b").agg(
        F.sum(decayed(F.lit(amount), now - F.col("ts"), half_life)).alias("w"), F.max(decayed(F.lit(first), now - F.col("_first"), half_life)).alias("w0")
    )
    raw = boosts.select("a", "b", F.least(F.lit(most), F.col("w") + F.col("w0")).alias("weight"))
    ends = raw.select(F.col("a").alias("node"), "weight").unionByName(raw.select(F.col("b").alias("node"), "weight"))
    scale = ends.groupBy("node").agg(F.least(F.lit(1.0), total / F.sum("weight")).alias("scale")).where("scale < 1")
    side = lambda x: scale.select(F.col("node").alias(x), F.col("scale").alias("s" + x))
    scaled = raw.join(side("a"), "a", "left").join(side("b"), "b", "left")
    weight = F.col("weight") * F.least(F.coalesce("sa", F.lit(1.0)), F.coalesce("sb", F.lit(1.0)))
    return scaled.select("a", "b", weight.alias("weight")).where(F.col("weight") >= prune)


def synapse_score(weight: Column, reference: float = 1.0) -> Column:
    return F.tanh(weight / reference)


def co_change(batches: DataFrame, now: float, half_life: float = 30 * DAY, window: float | None = None) -> DataFrame:
    """(a, b, n, strength): how often two nodes changed in one batch, the count fading from the last time on; window: only changes of the last so many seconds."""
    rows = batches if window is None else batches.where(F.col("ts") >= now - window)
    return pairs_of(rows).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select(
        "a", "b", "n", decayed(F.col("n").cast("double"), now - F.col("last"), half_life).alias("strength")
    )


def fabric_risk(metrics: DataFrame, weights: tuple[float, ...] = (0.25, 0.25, 0.20, 0.15, 0.15)) -> DataFrame:
    """(node, risk) from (node, pagerank, mutations, annotation, betweenness, scar): weighted sum of pagerank, mutation frequency, lack of annotation, betweenness and scar; all
    but the annotation by their largest value; between 0 and 1. Missing metrics are 0."""
    names = ("pagerank", "mutations", "betweenness", "scar")
    filled = metrics.fillna(0.0, [*names, "annotation"])
    top = filled.agg(*[F.max(n).alias("top_" + n) for n in names])
    part = lambda n: F.when(F.col("top_" + n) > 0, F.col(n) / F.col("top_" + n)).otherwise(0.0)
    a, b, c, d, e = weights
    risk = a * part("pagerank") + b * part("mutations") + c * (1 - F.col("annotation")) + d * part("betweenness") + e * part("scar")
    return filled.crossJoin(F.broadcast(top)).select("node", F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk)).alias("risk"))


def risk_zones(g: PropertyGraph, risk: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(zone, node, risk): connected groups of nodes above the threshold; a zone's id is its smallest node."""
    hot = risk.where(F.col("risk") >= threshold)
    e = g.simple_edges().join(hot.select(F.col("node").alias("a")), "a", "left_semi").join(hot.select(F.col("node").alias("b")), "b", "left_semi")
    part = PropertyGraph(g.spark, {"V": hot.select(F.col("node").alias("id"), F.array(F.lit("V")).alias("labels"))}, {"E": e.select(F.lit(0).alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("E").alias("type"))})
    return connected_components(part).join(hot, F.col("node_id") == F.col("node")).select(F.col("component_id").alias("zone"), "node", "risk")


def spreading_activation(links: DataFrame, sources: DataFrame, hops: int = 3, decay: float = 0.5, least: float = 0.01, threshold: float = 0.0) -> DataFrame:
    """(node, activation) from sources (node, energy) over directed links (src, dst, weight).

    Hop by hop: what arrives over one link is energy * weight * decay and is dropped below `least`; what arrives at a node in one hop is added up and goes on from there. (Order doesn't matter
    that way; a queue that lets only the first arrival of a hop go on gives less.)
    """
    r = Rounds(links.sparkSession)
    front = sources.groupBy("node").agg(F.sum(F.col("energy").cast("double")).alias("e"))
    parts = [front]
    for _ in range(hops):
        sent = front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("e") * F.col("weight") * decay).alias("e")).where(F.col("e") >= least)
        front = r.keep(sent.groupBy("node").agg(F.sum("e").alias("e")))
        parts.append(front)
    out = reduce(lambda a, b: a.unionByName(b), parts).groupBy("node").agg(F.sum("e").alias("activation"))
    return out.where(F.col("activation") >= threshold) if threshold > 0 else out


def stagnation(members: DataFrame, now: float, reference: float = 1.0) -> DataFrame:
    """(community, stagnation) from (community, node, energy, last_change, synapse_activity): 0.4 of lost energy, 0.35 of the age of the last change (full at 30 days), 0.25 of lacking
    activity."""
    by = members.groupBy("community").agg(F.avg("energy").alias("e"), F.max("last_change").alias("last"), F.avg("synapse_activity").alias("act"))
    age = F.least(F.lit(1.0), F.greatest(F.lit(0.0), now - F.col("last")) / (30 * DAY))
    score = 0.4 * (1 - energy_score(F.coalesce("e", F.lit(0.0)), reference)) + 0.35 * F.coalesce(age, F.lit(1.0)) + 0.25 * (1 - F.tanh(F.coalesce("act", F.lit(0.0))))
    return by.select("community", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("stagnation"))


def stagnation_trend(scores: DataFrame, window: int = 5, tolerance: float = 0.05) -> DataFrame:
    """(community, trend) from (community, ts, stagnation): the last of `window` scores against the first of them."""
    w = Window.partitionBy("community").orderBy(F.col("ts").desc())
    last = scores.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= window)
    by = last.groupBy("community").agg(F.max_by("stagnation", "ts").alias("new"), F.min_by("stagnation", "ts").alias("old"))
    diff = F.col("new") - F.col("old")
    return by.select("community", F.when(diff > tolerance, "stagnating").when(diff < -tolerance, "recovering").otherwise("stable").alias("trend"))


def memory_horizon(nodes: DataFrame) -> DataFrame:
    """(node, horizon, next) from (node, horizon, energy, age, in_horizon), ages in seconds: where a node goes by its energy and its time."""
    e, age, stay = F.col("energy"), F.col("age"), F.col("in_horizon")
    to = (
        F.when((F.col("horizon") == "operational") & (e >= 2) & (age >= 3600), "consolidated")
        .when((F.col("horizon") == "operational") & (e < 0.1) & (age > 7 * DAY), "archived")
        .when((F.col("horizon") == "consolidated") & (e < 0.1) & (stay > 7 * DAY), "archived")
        .when((F.col("horizon") == "archived") & (e >= 2), "operational")
        .otherwise(F.col("horizon"))
    )
    return nodes.select("node", "horizon", to.alias("next"))


def consolidation(nodes: DataFrame, low: float = 0.3, keep_rank: float = 0.1, least: int = 2) -> DataFrame:
    """(community, node) from (node, community, energy, pagerank): nodes of little energy that are merged, community by community, unless their rank protects them."""
    weak = nodes.where((F.col("energy") < low) & (F.coalesce("pagerank", F.lit(0.0)) <= keep_rank))
    large = weak.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("community")
    return weak.join(large, "community", "left_semi").select("community", "node")


def cognitive_search(candidates: DataFrame, energy: DataFrame, topology: DataFrame, links: DataFrame, weights: tuple[float, ...] = (0.3, 0.3, 0.3, 0.1), reference: float = 1.0, synapse_reference: float = 1.0) -> DataFrame:
    """(node, score, similarity, energy, topology, synapse): candidates (node, similarity), and what their synapses (a, b, weight) lead to, ranked by four signals.

    A candidate's energy (node, energy) counts as 1 - exp(-e / reference), its topology (node, rank) by the largest rank of all candidates; a neighbour gets the similarity of the best
    candidate it is linked with times tanh(weight / synapse_reference). The weights are scaled to a sum of 1.
    """
    a, b, c, d = (w / sum(weights) for w in weights)
    sim = candidates.select("node", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity"))).alias("similarity"))
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    linked = sim.join(both, F.col("node") == F.col("x")).groupBy(F.col("y").alias("node")).agg(F.max(F.col("similarity") * synapse_score(F.col("weight"), synapse_reference)).alias("synapse"))
    every = sim.join(linked, "node", "full").fillna(0.0, ["similarity", "synapse"])
    found = every.join(energy, "node", "left").join(topology, "node", "left")
    top = found.agg(F.max("rank").alias("top"))
    signals = found.crossJoin(F.broadcast(top)).select(
        "node", "similarity", F.coalesce(energy_score(F.col("energy"), reference), F.lit(0.0)).alias("energy"),
        F.coalesce(F.when(F.col("top") > 0, F.col("rank") / F.col("top")), F.lit(0.0)).alias("topology"), "synapse",
    )
    score = a * F.col("similarity") + b * F.col("energy") + c * F.col("topology") + d * F.col("synapse")
    return signals.select("node", F.least(F.lit(1.0), score).alias("score"), "similarity", "energy", "topology", "synapse")


def cognitive_boost(ranked: DataFrame, boost: DataFrame, weight: float = 1.0, multiply: bool = False) -> DataFrame:
    """(node, score): ranked (node, score) with boost (node, boost) added, or multiplied by 1 + boost; nodes without one stay as they are."""
    by = F.coalesce("boost", F.lit(0.0)) * weight
    return ranked.join(boost, "node", "left").select("node", (F.col("score") * (1 + by) if multiply else F.col("score") + by).alias("score"))


def distilled(links: DataFrame, energies: DataFrame, min_weight: float = 0.5, min_energy: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The strong synapses and energies, to be written and merged elsewhere."""
    return links.where(F.col("weight") >= min_weight), energies.where(F.col("energy") >= min_energy)


def injected(links: DataFrame, artifact: DataFrame) -> DataFrame:
    """Synapses with those of an artifact taken in: the larger weight counts."""
    return links.unionByName(artifact).groupBy("a", "b").agg(F.max("weight").alias("weight"))


# -- episodes and engrams
def episodes_by(episodes: DataFrame, tag: str | None = None, node: int | None = None) -> DataFrame:
    """Episodes (episode, ts, tags array, nodes array) with a tag and a node, latest first."""
    out = episodes
    out = out.where(F.array_contains("tags", tag)) if tag is not None else out
    out = out.where(F.array_contains("nodes", node)) if node is not None else out
    return out.orderBy(F.col("ts").desc(), "episode")


def fingerprint(g: PropertyGraph) -> DataFrame:
    """(id, fingerprint): a node's labels, degrees by edge type and direction, and those of its neighbours added up: equal for nodes in equal surroundings."""
    e = g.edge_scan([])
    ends = e.select(F.col("src").alias("id"), F.concat(F.lit(">"), F.col("type")).alias("k"), F.col("dst").alias("o")).unionByName(e.select(F.col("dst").alias("id"), F.concat(F.lit("<"), F.col("type")).alias("k"), F.col("src").alias("o")))
    own = ends.groupBy("id", "k").agg(F.count("*").alias("n")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("d"))
    nodes = g.node_scan(None).select("id", F.sort_array("labels").alias("labels")).join(own, "id", "left").select("id", F.xxhash64("labels", F.to_json("d")).alias("h"))
    near = ends.select("id", "k", F.col("o").alias("_o")).join(nodes.select(F.col("id").alias("_o"), F.col("h").alias("ho")), "_o").groupBy("id").agg(F.sum(F.xxhash64("k", "ho").cast("decimal(38,0)")).alias("s"))
    return nodes.join(near, "id", "left").select("id", F.xxhash64("h", F.coalesce(F.col("s").cast("string"), F.lit(""))).alias("fingerprint"))


def engram_formation(episodes: DataFrame, min_episodes: int = 3, min_overlap: float = 0.5) -> DataFrame:
    """(engram, node, share) from (episode, node): nodes that often stand in the same episodes. Pairs with min_episodes common ones are links, their components candidates; one is kept
    if the mean over all its pairs of common episodes / the lesser of the two counts reaches min_overlap. share: of all episodes, how many have the node."""
    rows = episodes.select(F.col("episode").alias("batch"), "node", F.lit(0.0).alias("ts"))
    once = rows.select("batch", "node").distinct()
    counts = once.groupBy("node").agg(F.count("*").alias("n"))
    both = pairs_of(rows, most=None).groupBy("a", "b").agg(F.count("*").alias("co"))
    r = Rounds(episodes.sparkSession)
    both = r.keep(both)
    strong = both.where(F.col("co") >= min_episodes)
    nodes = strong.select(F.col("a").alias("id")).unionByName(strong.select(F.col("b").alias("id"))).distinct()
    part = PropertyGraph(
        episodes.sparkSession, {"V": nodes.select("id", F.array(F.lit("V")).alias("labels"))},
        {"E": strong.select(F.lit(0).alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("E").alias("type"))},
    )
    comp = connected_components(part).select(F.col("node_id").alias("node"), F.col("component_id").alias("engram"))
    size = comp.groupBy("engram").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    side = lambda x: comp.select(F.col("node").alias(x), F.col("engram").alias("e" + x))
    n = lambda x: counts.select(F.col("node").alias(x), F.col("n").alias("n" + x))
    inside = both.join(side("a"), "a").join(side("b"), "b").where("ea = eb").join(n("a"), "a").join(n("b"), "b")
    total = inside.groupBy(F.col("ea").alias("engram")).agg(F.sum(F.col("co") / F.least("na", "nb")).alias("overlap"))
    good = size.join(total, "engram").where(F.col("overlap") / F.col("pairs") >= min_overlap).select("engram")
    every = once.select("batch").distinct().agg(F.count("*").alias("episodes"))
    return comp.join(good, "engram", "left_semi").join(counts, "node").crossJoin(F.broadcast(every)).select("engram", "node", (F.col("n") / F.col("episodes")).alias("share"))


def hopfield(patterns: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(id, weight) of the k patterns (id, pattern array, beta) that a softmax over beta * (pattern . query) weighs most. The maximum is taken off before the exponential; patterns of another length take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("pattern", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    logits = patterns.where(F.size("pattern") == len(query)).select("id", (F.col("beta") * dot).alias("x"))
    top = logits.agg(F.max("x").alias("top"))
    raised = logits.crossJoin(F.broadcast(top)).select("id", F.exp(F.col("x") - F.col("top")).alias("e"))
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("e").alias("total")))).select("id", (F.col("e") / F.col("total")).alias("weight")).orderBy(F.col("weight").desc(), "id").limit(k)


def recall(engrams: DataFrame, cues: DataFrame, attention: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(engram, score): the share of an engram's nodes (engram, node) that the cues (node) name, and, with attention (engram, weight) of a softmax over n engrams, the larger of
    that and min(1, weight * n)."""
    direct = engrams.select("engram", "node").distinct().join(cues.select("node").distinct().withColumn("_hit", F.lit(1)), "node", "left")
    score = direct.groupBy("engram").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("score"))
    if attention is not None:
        n = attention.agg(F.count("*").alias("n"))
        soft = attention.crossJoin(F.broadcast(n)).select("engram", F.least(F.lit(1.0), F.col("weight") * F.col("n")).alias("soft"))
        score = score.join(soft, "engram", "full").select("engram", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("soft", F.lit(0.0))).alias("score"))
    return score.where("score > 0").orderBy(F.col("score").desc(), "engram").limit(k)


def fsrs_review(reviews: DataFrame, w: tuple[float, ...] = FSRS) -> DataFrame:
    """(card, stability, difficulty, reps, lapses) after the reviews (card, ts in days, rating 1 to 4) of each card, in order of time.

    A fold over one card's reviews, which are few: what a person does. The first review, and the first after a lapse, sets stability and difficulty anew.
    """
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"), F.lit(None).cast("double").alias("ts"))
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    def step(a: Column, r: Column) -> Column:
        again = r.rating == 1
        first = F.when(again, w[0]).when(r.rating == 2, w[1]).when(r.rating == 3, w[2]).otherwise(w[3])
        left = retention(r.ts - a.ts, a.s)
        lapse = F.greatest(F.lit(0.01), w[11] * F.pow(a.d, F.lit(-w[12])) * (F.pow(a.s + 1, F.lit(w[13])) - 1))
        grade = F.when(r.rating == 2, w[14]).when(r.rating == 4, w[15]).otherwise(1.0)
        grown = a.s * (1 + F.exp(F.lit(w[8])) * (11 - a.d) * F.pow(a.s, F.lit(-w[9])) * (F.exp(w[10] * (1 - left)) - 1) * grade)
        fresh = a.reps == 0
        return F.struct(
            F.when(fresh, first).when(again, lapse).otherwise(F.greatest(a.s, grown)).alias("s"),
            F.when(fresh, clamp(w[4] - w[5] * (r.rating - 3))).otherwise(clamp(a.d + w[6] * (r.rating - 3))).alias("d"),
            F.when(fresh, 1).when(again, 0).otherwise(a.reps + 1).alias("reps"),
            F.when(again, a.lapses + 1).otherwise(a.lapses).alias("lapses"),
            r.ts.alias("ts"),
        )

    ordered = F.sort_array(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), F.col("rating").cast("int").alias("rating"))))
    return reviews.groupBy("card").agg(F.aggregate(ordered, zero, step).alias("a")).select(
        "card", F.col("a.s").alias("stability"), F.col("a.d").alias("difficulty"), F.col("a.reps").cast("long").alias("reps"), F.col("a.lapses").cast("long").alias("lapses")
    )


def homeostasis(weights: DataFrame, target: float = 1.0) -> DataFrame:
    """(node, id, weight): a node's weights scaled so that they add up to target."""
    total = weights.groupBy("node").agg(F.sum("weight").alias("_t"))
    return weights.join(total, "node").select("node", "id", F.when(F.col("_t") > 0, F.col("weight") * target / F.col("_t")).otherwise(F.col("weight")).alias("weight"))


# -- immune detectors, pheromones, marks
def detections(detectors: DataFrame, shapes: DataFrame) -> DataFrame:
    """(detector, node, distance): shapes (node, vector) within the radius of detectors (detector, vector, radius), which are a stated, small set: they go to the shapes."""
    d = detectors.select("detector", F.col("vector").alias("_v"), "radius")
    distance = F.sqrt(F.aggregate(F.zip_with("vector", "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, x: s + x))
    return shapes.join(d, F.size("vector") == F.size("_v")).select("detector", "node", distance.alias("distance"), "radius").where("distance <= radius").drop("radius")


def pheromones(trails: DataFrame, cycle: int, factor: float = 0.95, least: float = 0.01) -> DataFrame:
    """(src, dst, strength) after the evaporation of all cycles since each deposit (src, dst, cycle, amount); trails that fell below `least` are gone."""
    left = F.sum(F.col("amount") * F.pow(F.lit(factor), F.lit(cycle) - F.col("cycle")))
    return trails.where(F.col("cycle") <= cycle).groupBy("src", "dst").agg(left.alias("strength")).where(F.col("strength") >= least)


def marks_in(marks: DataFrame, context: str) -> DataFrame:
    """(node, mark, weight) of the marks (node, mark, contexts array, weight) that hold in a context; marks without contexts hold everywhere."""
    return marks.where(F.array_contains("contexts", context) | (F.size("contexts") == 0)).groupBy("node", "mark").agg(F.sum("weight").alias("weight"))


def persona_weights(weights: DataFrame, persona: str, usual: str = "default") -> DataFrame:
    """(signal, weight) of a persona from (persona, signal, weight); what it doesn't say is as usual."""
    own = weights.where(F.col("persona") == persona).select("signal", F.col("weight").alias("own"))
    base = weights.where(F.col("persona") == usual).select("signal", F.col("weight").alias("base"))
    return base.join(own, "signal", "full").select("signal", F.coalesce("own", "base").alias("weight"))


def mutation_frequency(events: DataFrame, reference: float = 100.0) -> DataFrame:
    """(node, score) from events (node, ...): the number of changes on a logarithmic scale."""
    return events.groupBy("node").agg(F.count("*").alias("n")).select("node", mutation_score(F.col("n"), reference).alias("score"))


# -- retrieval for generation
def rag_ranked(nodes: DataFrame, k: int = 50) -> DataFrame:
    """(rank, node, composite, tokens) of the k best of (node, score, richness, label, tokens): 0.6 of the score, 0.25 of the richness, both by their largest value, and 0.15, less
    30 % for a node whose label was taken before.

    With one label a node, the first of each label keeps its value and all others lose; the greedy choice is that order. So it is a window and a sort, without a loop on the driver.
    """
    top = nodes.agg(F.greatest(F.max("score"), F.lit(1e-9)).alias("ts"), F.greatest(F.max("richness"), F.lit(1)).alias("tr"))
    base = 0.6 * F.col("score") / F.col("ts") + 0.25 * F.col("richness") / F.col("tr") + 0.15
    rated = nodes.crossJoin(F.broadcast(top)).withColumn("base", base)
    lead = Window.partitionBy("label").orderBy(F.col("base").desc(), "node")
    value = F.when((F.row_number().over(lead) == 1) | F.col("label").isNull(), F.col("base")).otherwise(0.7 * F.col("base"))
    best = rated.withColumn("composite", value).orderBy(F.col("composite").desc(), "node").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("composite").desc(), "node"))).select("rank", "node", "composite", "tokens")


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The ranked nodes (rank, node, tokens) until the first that doesn't fit the budget of tokens; always the first one."""
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("total", F.sum("tokens").over(so_far)).where((F.col("total") <= budget) | (F.col("rank") == 1))
