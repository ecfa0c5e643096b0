"""Algorithms, scores and retrieval against plain Python on small graphs."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import algorithms as A
from quillgraph.operators import cognition as C
from quillgraph.operators import history as H
from quillgraph.operators import relational as R
from quillgraph.operators import scoring, search

from .graphs import plain, rows

EDGES = [(1, 2, 3), (2, 3, 1), (3, 1, 2), (3, 4, 5), (4, 5, 1), (5, 6, 2), (6, 4, 1), (6, 7, 4), (7, 8, 1), (9, 10, 2), (2, 1, 1)]
NODES = list(range(1, 12))


@pytest.fixture(scope="module")
def g(spark):
    return plain(spark, EDGES, NODES)


def neighbours(edges):
    near = {x: set() for x in NODES}
    for a, b, *_ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def test_components_and_cores(g):
    near, comp = neighbours(EDGES), {}
    for x in NODES:
        if x not in comp:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in comp:
                    comp[y] = x
                    todo += near[y]
    assert dict(rows(A.connected_components(g))) == comp
    core, left, k = dict.fromkeys(NODES, 0), {x: set(ys) for x, ys in near.items()}, 0
    while left:
        k += 1
        while weak := [x for x, ys in left.items() if len(ys) < k]:
            for x in weak:
                core[x] = k - 1
                del left[x]
            left = {x: ys - set(weak) for x, ys in left.items()}
    assert dict(rows(A.kcore(g))) == core


def test_cut_nodes_bridges_and_forest(g):
    def parts(nodes, edges):
        seen, n = set(), 0
        for x in nodes:
            if x not in seen:
                n += 1
                todo = [x]
                while todo:
                    y = todo.pop()
                    if y not in seen:
                        seen.add(y)
                        todo += [b if a == y else a for a, b in edges if y in (a, b)]
        return n

    pairs = [(a, b) for a, b, *_ in EDGES]
    simple = {(min(p), max(p)) for p in pairs}
    double = {p for p in simple if sum((min(q), max(q)) == p for q in pairs) > 1}
    whole = parts(NODES, simple)
    assert set(rows(A.bridges(g))) == {p for p in simple - double if parts(NODES, simple - {p}) > whole}
    cut = {x for x in NODES if parts([y for y in NODES if y != x], {p for p in simple if x not in p}) > whole - (not neighbours(EDGES)[x])}
    assert {r.node_id for r in A.articulation_points(g).collect()} == cut
    cheapest = {p: min(w for a, b, w in EDGES if (min(a, b), max(a, b)) == p) for p in simple}
    tree, total = set(), 0
    for p in sorted(simple, key=lambda p: (cheapest[p], p)):
        if parts(NODES, tree | {p}) < parts(NODES, tree):
            tree.add(p)
            total += cheapest[p]
    assert sum(r.weight for r in A.minimum_spanning_forest(g, "w").collect()) == total


def test_ranks(g):
    n, out = len(NODES), {x: [b for a, b, *_ in EDGES if a == x] for x in NODES}
    r = dict.fromkeys(NODES, 1 / n)
    for _ in range(6):
        lost = sum(r[x] for x in NODES if not out[x])
        r = {x: 0.15 / n + 0.85 * (sum(r[y] * out[y].count(x) / len(out[y]) for y in NODES if out[y]) + lost / n) for x in NODES}
    got = dict(rows(A.pagerank(g, max_iterations=6, tolerance=0.0)))
    assert got == pytest.approx(r, abs=1e-6)
    seeds = g.nodes["N"].where("id IN (1, 9)").select("id")
    p = {x: 0.5 * (x in (1, 9)) for x in NODES}
    for _ in range(4):
        lost = sum(p[x] for x in NODES if not out[x])
        p = {x: 0.15 * 0.5 * (x in (1, 9)) + 0.85 * (sum(p[y] * out[y].count(x) / len(out[y]) for y in NODES if out[y]) + lost * 0.5 * (x in (1, 9))) for x in NODES}
    got = dict(rows(A.personalized_pagerank(g, seeds, max_iterations=4)))
    assert got == pytest.approx({x: v for x, v in p.items() if v >= 1e-6}, abs=1e-6)
    matrix = np.zeros((n, n))
    for a, b, *_ in EDGES:
        matrix[a - 1, b - 1] += 1
    hub = np.full(n, n**-0.5)
    for _ in range(4):
        auth = matrix.T @ hub
        auth /= np.linalg.norm(auth)
        hub = matrix @ auth
        hub /= np.linalg.norm(hub)
    got = {r.node_id: (r.hub, r.authority) for r in A.hits(g, tolerance=0.0, max_iterations=4).collect()}
    assert [got[x][0] for x in NODES] == pytest.approx(hub.tolist(), abs=1e-5)


def test_betweenness_and_orders(g):
    out = {x: [b for a, b, *_ in EDGES if a == x] for x in NODES}
    paths = {}
    for s in NODES:
        level, seen = [(s,)], {s: 0}
        while level:
            for p in level:
                paths.setdefault((s, p[-1]), []).append(p)
            new = [(*p, y) for p in level for y in out[p[-1]] if y not in seen]
            for p in new:
                seen[p[-1]] = 1
            level = new
    score = dict.fromkeys(NODES, 0.0)
    for (s, t), ps in paths.items():
        for v in NODES:
            if s != t and v not in (s, t):
                score[v] += sum(v in p for p in ps) / len(ps)
    n = len(NODES)
    got = dict(rows(A.betweenness_centrality(g)))
    assert got == pytest.approx({v: x * 2 / ((n - 1) * (n - 2)) for v, x in score.items()})
    order, stack, seen = [], [1], set()
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            order.append(x)
            stack += sorted(set(out[x]), reverse=True)
    assert [x for x, _ in sorted(rows(A.dfs(g, 1)), key=lambda r: r[1])] == order
    assert A.topological_sort(g).isEmpty()  # it has a cycle


def test_flows(spark):
    twin = plain(spark, [(1, 2, 1, 1), (1, 2, 1, 9)])
    assert rows(A.max_flow(twin, 1, 2, "w", "cost")) == [(2.0, 10.0)]
    net = plain(spark, [(1, 2, 3, 1), (1, 3, 2, 1), (2, 3, 5, 1), (2, 4, 2, 4), (3, 4, 3, 1)])
    assert rows(A.max_flow(net, 1, 4, "w")) == [(5.0, 0.0)]


def test_communities(spark):
    cliques = [(a, b) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10), (14, 20)]
    g = plain(spark, cliques)
    want = {x: x // 10 * 10 for x in [*range(5), *range(10, 15), *range(20, 25)]}
    for found in (A.leiden(g), A.louvain(g), A.label_propagation(g)):
        assert {r.node_id: r.community_id for r in found.collect()} == want
    old = spark.createDataFrame([(x, 7 if x < 10 else 8) for x in want], "node_id long, community_id long")
    got = {r.node_id: r.community_id for r in A.stable_communities(A.leiden(g), old).collect()}
    assert {got[x] for x in range(5)} == {7} and {got[x] for x in range(10, 15)} == {8} and {got[x] for x in range(20, 25)} == {29}
    v = {r.node_id: r.embedding for r in A.spectral_embedding(g, 2).collect()}
    assert np.sign(v[0][0]) != np.sign(v[24][0])
    cells = spark.range(256).select((F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y"))
    at = {r.d: (r.x, r.y) for r in cells.select("x", "y", A.hilbert_code(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(at) == list(range(256)) and all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(255))


def test_energy_is_the_capped_fold(spark):
    r = random.Random(4)
    events = [(n, r.random() * 9 * 86400, r.choice([0.5, 2.0, 6.0])) for n in range(4) for _ in range(r.randrange(1, 60))]
    now, half = 10 * 86400.0, 43_200.0
    want = {}
    for n in range(4):
        value, last = 0.0, 0.0
        for _, ts, amount in sorted(e for e in events if e[0] == n):
            value, last = min(5.0, value * 2 ** (-(ts - last) / half) + amount), ts
        want[n] = value * 2 ** (-(now - last) / half)
    df = spark.createDataFrame(events, "node long, ts double, amount double")
    assert dict(rows(scoring.energy(df, now, half, 5.0))) == pytest.approx(want)


def test_engrams_reviews_and_zones(spark, g):
    sets = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 4], 4: [5, 6], 5: [5, 6], 6: [7]}
    df = spark.createDataFrame([(e, n) for e, ns in sets.items() for n in ns], "episode long, node long")
    got = {(r.engram, r.node): r.share for r in C.engram_formation(df, 2, 0.6).collect()}
    assert got == pytest.approx({(1, 1): 3 / 6, (1, 2): 3 / 6, (1, 3): 2 / 6, (5, 5): 2 / 6, (5, 6): 2 / 6})
    w = C.FSRS
    s, d = w[2], 1.0
    kept = 1 / (1 + 3 / (9 * s))
    s = max(s, s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp(w[10] * (1 - kept)) - 1) * w[15]))
    d = min(1.0, d + w[6])
    s = max(0.01, w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1))
    reviews = spark.createDataFrame([(1, 0.0, 3), (1, 3.0, 4), (1, 9.0, 1)], "card long, ts double, rating int")
    (r,) = C.fsrs_review(reviews).collect()
    assert (r.stability, r.difficulty, r.reps, r.lapses) == pytest.approx((s, max(0.0, d - 2 * w[6]), 0, 1))
    risk = spark.createDataFrame([(x, 0.9 if x in (1, 2, 5, 9) else 0.1) for x in NODES], "node long, risk double")
    assert {(z, n) for z, n, _ in rows(C.risk_zones(g, risk))} == {(1, 1), (1, 2), (5, 5), (9, 9)}


def test_ranking_for_generation(spark):
    data = [(1, 1.0, 10, "a", 40), (2, 0.9, 10, "a", 40), (3, 0.5, 5, "b", 30), (4, 0.4, 1, "c", 50)]
    df = spark.createDataFrame(data, "node long, score double, richness long, label string, tokens long")
    base = {n: 0.6 * s + 0.25 * k / 10 + 0.15 for n, s, k, _, _ in data}
    base[2] *= 0.7
    ranked = C.rag_ranked(df)
    assert [r.node for r in ranked.orderBy("rank").collect()] == sorted(base, key=lambda n: -base[n])
    assert [r.node for r in C.within_budget(ranked, 75).orderBy("rank").collect()] == [1]
    assert [r.node for r in C.within_budget(ranked, 10).collect()] == [1]


def test_retrieval(spark):
    r = random.Random(5)
    vectors = {i: [r.gauss(0, 1) for _ in range(8)] for i in range(60)}
    df = spark.createDataFrame([(i, v, f"w{i % 3} common {'rare' if i % 20 == 0 else ''}") for i, v in vectors.items()], "id long, v array<double>, text string")
    q = [1.0] * 8
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    near = sorted(vectors, key=lambda i: cos(vectors[i], q))[:20]
    taken = []
    while len(taken) < 5:
        best = max((i for i in near if i not in taken), key=lambda i: 0.6 * (1 - cos(vectors[i], q)) - 0.4 * max([1 - cos(vectors[i], vectors[j]) for j in taken], default=0.0))
        taken.append(best)
    assert [x.id for x in search.mmr(df, "v", q, 5, 20, 0.6).orderBy("rank").collect()] == taken
    coded, ranges = search.scalar_quantized(df, "v")
    for x in search.scalar_restored(coded, ranges).collect():
        assert max(abs(a - b) for a, b in zip(x.v, x.restored, strict=True)) < 0.02
    assert {x.id for x in search.knn_binary(df, "v", q, 5, 60).collect()} == set(near[:5])
    fused = rows(search.weighted_fusion([spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, score double"), spark.createDataFrame([(2, 5.0)], "id long, score double")], [0.7, 0.3]))
    assert dict(fused) == pytest.approx({1: 0.7, 2: 0.3})
    assert {x.id for x in search.hybrid(df, "text", "v", "rare", q, 10).collect()} & {0, 20, 40} == {0, 20, 40}
    assert search.bm25(df, "text", "the of").isEmpty()


def test_history_and_joins(spark):
    log = spark.createDataFrame([(1, 1, "create", "a"), (1, 5, "update", "b"), (2, 2, "create", "c"), (2, 6, "delete", None)], "entity long, epoch long, kind string, after string")
    assert sorted((r.entity, r.after) for r in H.as_of(H.versions(log), 5).collect()) == [(1, "b"), (2, "c")] == sorted((r.entity, r.after) for r in H.state_at(log, 5).collect())
    assert sorted(rows(H.difference(H.state_at(log, 2), H.state_at(log, 9)))) == [(1, "update", "b"), (2, "delete", None)]
    a, b = spark.createDataFrame([(1,), (None,)], "x long"), spark.createDataFrame([(1,), (None,)], "y long")
    assert R.join(a, b, [("x", "y")]).count() == 1 and R.join(a, b, [("x", "y")], null_safe=True).count() == 2


def test_subscriptions_outlive_a_failing_handler(spark, tmp_path):
    from quillgraph.streaming import feed

    df = spark.createDataFrame([(1, "created", "A"), (2, "deleted", "B")], "node long, kind string, label string")
    df.write.parquet(str(tmp_path / "in"))
    seen = []

    def bad(batch, n):
        raise RuntimeError("no")

    stream = feed.change_stream(spark, str(tmp_path / "in"), df.schema)
    feed.listen(feed.subscribed(stream, ["created"], ["A"]), {"bad": bad, "good": lambda b, n: seen.extend(r.node for r in b.collect())}, str(tmp_path / "state"), once=True).awaitTermination()
    assert seen == [1]


def test_fingerprints_tell_surroundings_apart(spark):
    at = dict(rows(C.fingerprint(plain(spark, [(1, 2), (3, 4), (5, 6), (6, 7)], [8]))))
    assert at[1] == at[3] and at[2] == at[4] and len({at[1], at[2], at[5], at[6], at[7], at[8]}) == 6


def test_kcore_in_slices_leaves_no_edges_behind(spark, monkeypatch):
    monkeypatch.setattr(A, "PEELED_IDS", 2, raising=False)
    g = plain(spark, [(1, 2), (2, 1), (1, 3), (2, 3), (3, 4), (4, 5), (5, 5)], [9])
    stored = lambda: {p for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).iterdir()}
    A.Rounds(spark)
    before = stored()
    want = dict.fromkeys((1, 2, 3), 2) | {4: 1, 5: 1, 9: 0}
    assert dict(rows(A.kcore(g))) == want
    left = stored() - before
    assert left and all(spark.read.parquet(f"file://{p}").columns[0] == "id" for p in left if any(p.glob("*.parquet")))
    assert not any(list(p.glob("part-0*[0-9]")) for p in left)  # no checkpoints of rounds
    assert {n for n, inside in rows(A.kcore(g, 2)) if inside} == {1, 2, 3}
