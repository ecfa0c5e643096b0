"""Cognitive scores over the events (a node is a user; users of one minute are active together) and over the trades, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algorithms as A
from ..operators import cognition as C
from ..operators import relational as R
from ..operators import scoring, search
from ..sources.tables import read, star_graph, trade_graph
from .patterns import TRADES
from .registry import query
from .retrieval import DISTANCE, LIST, NOW, Q

HOUR = 3600


def batches(spark, sf_dir):
    """(batch, node, ts): users of one hour."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return read(spark, sf_dir, "events").select(F.floor(seconds / HOUR).alias("batch"), F.col("user_id").alias("node"), seconds.alias("ts"))


_PAIRS = f"""x AS (SELECT CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) AS batch, user_id AS node, max(epoch(ts)) AS ts FROM events GROUP BY 1, 2), s AS (SELECT batch FROM x GROUP BY 1 HAVING count(*) <= 100),
    p AS (SELECT a.node AS a, b.node AS b, a.batch, greatest(a.ts, b.ts) AS ts FROM x a JOIN x b ON a.batch = b.batch AND a.node < b.node WHERE a.batch IN (SELECT batch FROM s))"""


@query("synapse_pairs", f"""WITH {_PAIRS}, r AS (SELECT a, b, least(10, sum(0.2 * pow(2.0, -({NOW} - ts) / 604800.0)) + 0.1 * pow(2.0, -({NOW} - min(ts)) / 604800.0)) AS w FROM p GROUP BY 1, 2),
    t AS (SELECT n, least(1.0, 100 / sum(w)) AS k FROM (SELECT a AS n, w FROM r UNION ALL SELECT b, w FROM r) GROUP BY 1)
    SELECT a, b, round(w * least(u.k, v.k), 8) AS weight FROM r JOIN t u ON u.n = a JOIN t v ON v.n = b WHERE w * least(u.k, v.k) >= 0.01""")
def synapses(spark, sf_dir):
    return C.synapses(batches(spark, sf_dir), NOW).withColumn("weight", F.round("weight", 8))


@query("co_change", f"WITH {_PAIRS} SELECT a, b, count(*) AS n, round(count(*) * pow(2.0, -({NOW} - max(ts)) / 2592000.0), 8) AS strength FROM p GROUP BY 1, 2")
def co_change(spark, sf_dir):
    return C.co_change(batches(spark, sf_dir), NOW).withColumn("strength", F.round("strength", 8))


@query("mutation_frequency", "SELECT user_id AS node, round(least(1.0, ln(1 + count(*)) / ln(101)), 8) AS score FROM events GROUP BY 1")
def mutation_frequency(spark, sf_dir):
    return C.mutation_frequency(batches(spark, sf_dir)).withColumn("score", F.round("score", 8))


_METRICS = f"""m AS (SELECT n_nationkey::BIGINT AS node, coalesce((SELECT sum(weight) FROM e WHERE d = n_nationkey), 0)::DOUBLE AS pagerank, coalesce((SELECT count(*) FROM e WHERE s = n_nationkey), 0)::DOUBLE AS mutations,
    n_nationkey / 25.0 AS annotation, n_regionkey::DOUBLE AS betweenness, (n_nationkey % 4)::DOUBLE AS scar FROM nation)"""
_RISK = "least(1, greatest(0, 0.25 * pagerank / (SELECT max(pagerank) FROM m) + 0.25 * mutations / (SELECT max(mutations) FROM m) + 0.2 * (1 - annotation) + 0.15 * betweenness / (SELECT max(betweenness) FROM m) + 0.15 * scar / (SELECT max(scar) FROM m)))"


def _risk(spark, sf_dir):
    """Risks of the nations; what they sell stands for their rank."""
    g = trade_graph(spark, sf_dir)
    sold = A.arcs(g, "weight").groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("pagerank"))
    out = A.arcs(g).groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("mutations"))
    n = g.nodes["Nation"].join(sold, "id", "left").join(out, "id", "left")
    return C.fabric_risk(n.select(F.col("id").alias("node"), "pagerank", "mutations", (F.col("id") / 25.0).alias("annotation"), F.col("region").cast("double").alias("betweenness"), (F.col("id") % 4).cast("double").alias("scar")))


@query("fabric_risk", f"WITH {TRADES}, {_METRICS} SELECT node, round({_RISK}, 8) AS risk FROM m")
def fabric_risk(spark, sf_dir):
    return _risk(spark, sf_dir).withColumn("risk", F.round("risk", 8))


@query("risk_zones")
def risk_zones(spark, sf_dir):
    return C.risk_zones(trade_graph(spark, sf_dir), _risk(spark, sf_dir), 0.6).withColumn("risk", F.round("risk", 8))


@query("spreading_activation", f"""WITH {TRADES}, l AS (SELECT s, d, weight / (SELECT max(weight) FROM e) AS w FROM e), h0 AS (SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (3, 0.5)) t(n, e))"""
       + "".join(f", h{i} AS (SELECT d AS n, sum(e * w * 0.5) AS e FROM h{i - 1} JOIN l ON s = n WHERE e * w * 0.5 >= 0.01 GROUP BY 1)" for i in (1, 2, 3))
       + " SELECT n AS node, round(sum(e), 8) AS activation FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1")
def activation(spark, sf_dir):
    e = A.arcs(trade_graph(spark, sf_dir), "weight")
    links = e.crossJoin(F.broadcast(e.agg(F.max("w").alias("top")))).select("src", "dst", (F.col("w") / F.col("top")).alias("weight"))
    found = C.spreading_activation(links, spark.createDataFrame([(0, 1.0), (3, 0.5)], "node long, energy double"))
    return found.withColumn("activation", F.round("activation", 8))


@query("stagnation", f"""SELECT user_id % 10 AS community, round(least(1, greatest(0, 0.4 * exp(-avg(value)) + 0.35 * least(1, ({NOW} - max(epoch(ts))) / 2592000.0) + 0.25 * (1 - tanh(avg(value / 100))))), 8) AS stagnation
    FROM events GROUP BY 1""")
def stagnation(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("community"), F.col("user_id").alias("node"), F.col("value").alias("energy"), seconds.alias("last_change"), (F.col("value") / 100).alias("synapse_activity"))
    return C.stagnation(rows, NOW).withColumn("stagnation", F.round("stagnation", 8))


_HORIZONS = "SELECT event_id AS node, ['operational', 'consolidated', 'archived'][event_id % 3 + 1] AS horizon, value / 10 AS energy, (event_id % 20) * 86400.0 AS age, (event_id % 15) * 86400.0 AS stay FROM events"


@query("memory_horizon", f"""SELECT horizon, CASE WHEN horizon = 'operational' AND energy >= 2 AND age >= 3600 THEN 'consolidated' WHEN horizon = 'operational' AND energy < 0.1 AND age > 604800 THEN 'archived'
    WHEN horizon = 'consolidated' AND energy < 0.1 AND stay > 604800 THEN 'archived' WHEN horizon = 'archived' AND energy >= 2 THEN 'operational' ELSE horizon END AS next, count(*) AS n FROM ({_HORIZONS}) GROUP BY 1, 2""")
def memory_horizon(spark, sf_dir):
    id_ = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        id_.alias("node"), F.element_at(F.array(*map(F.lit, ("operational", "consolidated", "archived"))), (id_ % 3 + 1).cast("int")).alias("horizon"),
        (F.col("value") / 10).alias("energy"), ((id_ % 20) * 86400.0).alias("age"), ((id_ % 15) * 86400.0).alias("in_horizon"),
    )
    return C.memory_horizon(rows).groupBy("horizon", "next").agg(F.count("*").alias("n"))


@query("consolidation", """WITH w AS (SELECT event_id AS node, user_id % 50 AS community FROM events WHERE value < 0.3 AND event_id % 7 / 50.0 <= 0.1), k AS (SELECT community FROM w GROUP BY 1 HAVING count(*) >= 2)
    SELECT community, node FROM w WHERE community IN (SELECT community FROM k)""")
def consolidation(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("node"), (F.col("user_id") % 50).alias("community"), F.col("value").alias("energy"), (F.col("event_id") % 7 / 50.0).alias("pagerank"))
    return C.consolidation(rows)


@query("cognitive_search", f"""WITH c AS (SELECT vec_id AS node, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {LIST}) AS s FROM embeddings ORDER BY {DISTANCE['cosine'].replace('v,', 'CAST(embedding AS DOUBLE[]),')}, vec_id LIMIT 20),
    c2 AS (SELECT node, least(1, greatest(0, s)) AS sim FROM c), l AS (SELECT vec_id AS x, (vec_id * 7 + 3) % 500 AS y, label / 2.0 AS w FROM embeddings WHERE vec_id < 500 AND vec_id <> (vec_id * 7 + 3) % 500),
    b AS (SELECT x, y, w FROM l UNION ALL SELECT y, x, w FROM l), n AS (SELECT y AS node, max(sim * tanh(w)) AS syn FROM c2 JOIN b ON x = node GROUP BY 1),
    f AS (SELECT coalesce(c2.node, n.node) AS node, coalesce(sim, 0) AS sim, coalesce(syn, 0) AS syn FROM c2 FULL JOIN n ON c2.node = n.node),
    g AS (SELECT f.*, 1 - exp(-(label / 3.0)) AS en, vec_id % 11 AS rk FROM f JOIN embeddings ON vec_id = f.node)
    SELECT node, round(least(1, 0.3 * sim + 0.3 * en + 0.3 * rk / (SELECT max(rk) FROM g) + 0.1 * syn), 6) AS score FROM g""")
def cognitive_search(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    near = search.knn(e, "embedding", Q, 20, "cosine", "vec_id").select(F.col("id").alias("node"), (1 - F.col("distance")).alias("similarity"))
    other = ((F.col("vec_id") * 7 + 3) % 500).alias("b")
    links = e.where("vec_id < 500").select(F.col("vec_id").alias("a"), other, (F.col("label") / 2.0).alias("weight")).where("a <> b")
    energy = e.select(F.col("vec_id").alias("node"), (F.col("label") / 3.0).alias("energy"))
    rank = e.select(F.col("vec_id").alias("node"), (F.col("vec_id") % 11).alias("rank"))
    return C.cognitive_search(near, energy, rank, links).select("node", F.round("score", 6).alias("score"))


@query("cognitive_boost", "SELECT n_nationkey::BIGINT AS node, round(n_nationkey / 10.0 + CASE WHEN n_nationkey < 5 THEN 0.5 ELSE 0 END, 6) AS score FROM nation")
def boost(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") / 10.0).alias("score"))
    return C.cognitive_boost(n, spark.range(5).select(F.col("id").alias("node"), F.lit(0.5).alias("boost"))).withColumn("score", F.round("score", 6))


@query("distillation", f"WITH {_PAIRS} SELECT a, b, round(count(*) * pow(2.0, -({NOW} - max(ts)) / 2592000.0), 8) AS weight FROM p GROUP BY 1, 2 HAVING count(*) * pow(2.0, -({NOW} - max(ts)) / 2592000.0) >= 1.5")
def distillation(spark, sf_dir):
    links = C.co_change(batches(spark, sf_dir), NOW).select("a", "b", F.col("strength").alias("weight"))
    return C.distilled(links, spark.createDataFrame([], "node long, energy double"), 1.5)[0].withColumn("weight", F.round("weight", 8))


@query("engram_formation")
def engrams(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_suppkey").alias("node"))
    return C.engram_formation(rows, 3, 0.0).withColumn("share", F.round("share", 8))


@query("hopfield_recall", f"WITH l AS (SELECT vec_id, (1 + label) * list_dot_product(CAST(embedding AS DOUBLE[]), {LIST}) AS x FROM embeddings), e AS (SELECT vec_id, exp(x - (SELECT max(x) FROM l)) AS e FROM l) SELECT vec_id AS id, round(e / (SELECT sum(e) FROM e), 8) AS weight FROM e ORDER BY e DESC, vec_id LIMIT 10")
def hopfield(spark, sf_dir):
    p = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("pattern"), (1.0 + F.col("label")).alias("beta"))
    return C.hopfield(p, Q, 10).withColumn("weight", F.round("weight", 8))


@query("engram_recall", "SELECT o_custkey AS engram, round(count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) / count(*), 8) AS score FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1 HAVING score > 0 ORDER BY score DESC, engram LIMIT 20")
def engram_recall(spark, sf_dir):
    key = lambda c: F.xxhash64(c)
    e = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("engram"), key(F.col("o_orderpriority")).alias("node"))
    cues = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "x string").select(key(F.col("x")).alias("node"))
    return C.recall(e, cues, k=20).withColumn("score", F.round("score", 8))


@query("fsrs_retention", "SELECT event_id AS card, round(1 / (1 + (event_id % 40) / (9 * (1 + value))), 8) AS kept, round(9 * (1 + value) * (1 / 0.9 - 1), 6) AS next_days FROM events")
def fsrs_retention(spark, sf_dir):
    s = 1 + F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("card"), F.round(scoring.retention(F.col("event_id") % 40, s), 8).alias("kept"), F.round(scoring.next_review_days(s, 0.9), 6).alias("next_days")
    )


@query("fsrs_review")
def fsrs_review(spark, sf_dir):
    days = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6 / 86400
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("card"), days.alias("ts"), (F.col("event_id") % 4 + 1).alias("rating"))
    return C.fsrs_review(rows).select("card", F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "reps", "lapses")


@query("pheromones", "SELECT s AS src, d AS dst, round(sum(a * pow(0.95, 40 - c)), 8) AS strength FROM (SELECT user_id AS s, user_id % 7 AS d, event_id % 40 AS c, value AS a FROM events) GROUP BY 1, 2 HAVING sum(a * pow(0.95, 40 - c)) >= 0.01")
def pheromones(spark, sf_dir):
    trails = read(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("user_id") % 7).alias("dst"), (F.col("event_id") % 40).alias("cycle"), F.col("value").alias("amount"))
    return C.pheromones(trails, 40).withColumn("strength", F.round("strength", 8))


@query("immune_detections", "SELECT a.vec_id AS detector, b.vec_id AS node, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM embeddings a JOIN embeddings b ON list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.1 WHERE a.vec_id < 3")
def detections(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vector"))
    d = e.where("node < 3").select(F.col("node").alias("detector"), "vector", F.lit(1.1).alias("radius"))
    return C.detections(d, e).withColumn("distance", F.round("distance", 5))


@query("rag_ranking", """WITH n AS (SELECT p_partkey AS node, p_retailprice AS score, p_size AS richness, p_brand AS label, (p_partkey % 9 + 1)::BIGINT AS tokens FROM part),
    b AS (SELECT *, 0.6 * score / (SELECT max(score) FROM n) + 0.25 * richness / (SELECT max(richness) FROM n) + 0.15 AS base FROM n),
    c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY base DESC, node) = 1 THEN base ELSE 0.7 * base END AS composite FROM b), r AS (SELECT *, row_number() OVER (ORDER BY composite DESC, node) AS rank FROM c),
    t AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS total FROM r WHERE rank <= 50) SELECT rank::INT AS rank, node, round(composite, 8) AS composite FROM t WHERE total <= 100 OR rank = 1""")
def rag(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("richness"), F.col("p_brand").alias("label"), (F.col("p_partkey") % 9 + 1).alias("tokens"))
    return C.within_budget(C.rag_ranked(n, 50), 100).select("rank", "node", F.round("composite", 8).alias("composite"))


@query("fingerprint")
def fingerprint(spark, sf_dir):
    return C.fingerprint(star_graph(spark, sf_dir)).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("score_function", "SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 2.0 END AS e FROM nation")
def score_function(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    table = g.nodes["Nation"].where("key % 2 = 0").select(F.col("id").alias("node"), (F.col("key") / 2.0).alias("energy"))
    return g.with_score("energy", table).query("MATCH (n:Nation) RETURN n.key AS key, energy(n) AS e")


@query("stored_procedure", "SELECT n_name AS name FROM nation WHERE n_nationkey > 20")
def stored_procedure(spark, sf_dir):
    g = star_graph(spark, sf_dir).with_procedure("later", ["k"], "MATCH (n:Nation) WHERE n.key > $k RETURN n.name AS name")
    return g.query("CALL later(20) YIELD name RETURN name")


@query("user_function", "SELECT n_nationkey::BIGINT AS key, n_nationkey::BIGINT * n_nationkey AS square FROM nation")
def user_function(spark, sf_dir):
    from ..functions.registry import register

    register("squared", lambda c: c * c)
    return star_graph(spark, sf_dir).query("MATCH (n:Nation) RETURN n.key AS key, squared(n.key) AS square")


# -- joins of all kinds, distinct on columns
for _kind, _sql in {
    "inner": "SELECT n_nationkey AS k, s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey + 3",
    "left": "SELECT n_nationkey AS k, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey + 3",
    "right": "SELECT n_nationkey AS k, s_suppkey AS s FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey + 3",
    "full": "SELECT n_nationkey AS k, s_suppkey AS s FROM nation FULL JOIN supplier ON s_nationkey = n_nationkey + 3",
    "semi": "SELECT n_nationkey AS k FROM nation SEMI JOIN supplier ON s_nationkey = n_nationkey + 3",
    "anti": "SELECT n_nationkey AS k FROM nation ANTI JOIN supplier ON s_nationkey = n_nationkey + 3",
    "cross": "SELECT n_nationkey AS k, s_suppkey AS s FROM nation CROSS JOIN supplier",
}.items():
    @query(f"join_{_kind}", _sql)
    def _join(spark, sf_dir, kind=_kind):
        n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 3).alias("x"))
        s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("y"))
        return R.join(n, s, [("x", "y")], kind).drop("x", "y")


@query("distinct_on", "SELECT o_custkey AS customer, arg_max(o_orderkey, o_totalprice) AS key FROM orders GROUP BY 1")
def distinct_on(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"))
    return R.distinct_on(o, ["customer"], [F.col("total").desc(), F.col("key")]).drop("total")


@query("map_collect", "SELECT r_name AS region, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def map_collect(spark, sf_dir):
    m = star_graph(spark, sf_dir).query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, map_collect(n.name, n.key) AS m")
    return m.select("region", F.size("m").cast("long").alias("n"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("node_list", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 5, 7)")
def node_list(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return R.node_list(g, [2 * 10**12 + k for k in (1, 5, 7)]).select("name")


# -- retrieval
@query("hybrid_weighted")
def hybrid_weighted(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return search.hybrid_weighted(docs, "text", "embedding", "idiot thation", Q, 10, id_="doc_id").withColumn("score", F.round("score", 8))


@query("mmr_search")
def mmr(spark, sf_dir):
    return search.mmr(read(spark, sf_dir, "embeddings"), "embedding", Q, 5, 30, 0.5, "cosine", "vec_id").withColumn("distance", F.round("distance", 5))


@query("vector_filters", f"SELECT vec_id AS id, round({DISTANCE['cosine']}, 5) AS distance FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE label >= 1 AND label < 4 AND vec_id NOT IN (3, 4) ORDER BY {DISTANCE['cosine']}, vec_id LIMIT 5")
def vector_filters(spark, sf_dir):
    where = {"label": {"$gte": 1, "$lt": 4}, "vec_id": {"$nin": [3, 4]}}
    return search.knn(read(spark, sf_dir, "embeddings"), "embedding", Q, 5, "cosine", "vec_id", where).withColumn("distance", F.round("distance", 5))


@query("quantization_scalar")
def quantization_scalar(spark, sf_dir):
    coded, ranges = search.scalar_quantized(read(spark, sf_dir, "embeddings"), "embedding")
    error = F.array_max(F.zip_with("embedding", "restored", lambda a, b: F.abs(a.cast("double") - b)))
    return search.scalar_restored(coded, ranges).select("vec_id", (error < 0.01).alias("close"))


@query("quantization_binary", "SELECT vec_id, list_sum([CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding])::BIGINT AS ones FROM embeddings")
def quantization_binary(spark, sf_dir):
    b = search.binary_quantized(read(spark, sf_dir, "embeddings"), "embedding")
    return b.select("vec_id", F.aggregate("bits", F.lit(0), lambda s, x: s + F.bit_count(x)).cast("long").alias("ones"))
