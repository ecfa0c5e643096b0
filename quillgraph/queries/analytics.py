"""Graph algorithms over the trade graphs, each with SQL over the tables where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algorithms as A
from ..sources.tables import star_graph, supply_graph, trade_graph
from .patterns import SHORTEST, TRADES
from .registry import query

UNDIRECTED = f"{TRADES}, u AS (SELECT DISTINCT least(s, d) AS a, greatest(s, d) AS b FROM e WHERE s <> d), nb AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), dg AS (SELECT x, count(*) AS d FROM nb GROUP BY 1)"


@query("degree_centrality", f"""WITH {TRADES} SELECT n_nationkey::BIGINT AS node_id, (SELECT count(*) FROM e WHERE d = n_nationkey) AS in_degree, (SELECT count(*) FROM e WHERE s = n_nationkey) AS out_degree,
    (SELECT count(*) FROM e WHERE d = n_nationkey) + (SELECT count(*) FROM e WHERE s = n_nationkey) AS total_degree FROM nation""")
def degree(spark, sf_dir):
    return A.degree_centrality(trade_graph(spark, sf_dir))


@query("degree_star", "SELECT c_custkey AS key, count(o_orderkey) AS placed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def degree_star(spark, sf_dir):
    g = star_graph(spark, sf_dir).project(labels=["Customer", "Order"], types=["PLACED"])
    return A.degree_centrality(g).join(g.nodes["Customer"], F.col("node_id") == F.col("id")).select("key", F.col("out_degree").alias("placed"))


_PR = "r0 AS (SELECT n_nationkey::BIGINT AS v, 1.0::DOUBLE / (SELECT count(*) FROM nation) AS r FROM nation), o AS (SELECT s, count(*) AS k FROM e GROUP BY 1)"
_PR += "".join(f""", r{i} AS (SELECT v, 0.15 / (SELECT count(*) FROM nation) + 0.85 * (coalesce((SELECT sum(r / k) FROM e JOIN r{i - 1} q ON e.s = q.v JOIN o ON o.s = e.s WHERE e.d = x.v), 0)
    + coalesce((SELECT sum(r) FROM r{i - 1} WHERE v NOT IN (SELECT s FROM o)), 0) / (SELECT count(*) FROM nation)) AS r FROM r{i - 1} x)""" for i in range(1, 4))


@query("pagerank_k", f"WITH {TRADES}, {_PR} SELECT v AS node_id, round(r, 8) AS score FROM r3")
def pagerank(spark, sf_dir):
    return A.pagerank(trade_graph(spark, sf_dir), max_iterations=3).withColumn("score", F.round("score", 8))


@query("pagerank_full")
def pagerank_full(spark, sf_dir):
    return A.pagerank(trade_graph(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("hits")
def hits(spark, sf_dir):
    return A.hits(trade_graph(spark, sf_dir)).select("node_id", F.round("hub", 5).alias("hub"), F.round("authority", 5).alias("authority"))


@query("wcc", "SELECT r_regionkey::BIGINT AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def wcc(spark, sf_dir):
    g = star_graph(spark, sf_dir).project(labels=["Nation", "Region"], types=["IN_REGION"])
    c = A.connected_components(g)
    region = g.nodes["Region"].select(F.col("id").alias("component_id"), F.col("key").alias("region"))
    return c.where("node_id <> component_id").join(region, "component_id").groupBy("region").agg(F.count("*").alias("n"))


@query("scc", f"{SHORTEST} SELECT x.a AS node_id, min(x.b) AS component_id FROM m x JOIN m y ON x.a = y.b AND x.b = y.a GROUP BY 1")
def scc(spark, sf_dir):
    return A.strongly_connected_components(trade_graph(spark, sf_dir))


@query("bfs_depth", f"{SHORTEST} SELECT b AS node_id, len AS depth FROM m WHERE a = 0")
def bfs(spark, sf_dir):
    return A.bfs(trade_graph(spark, sf_dir), 0)


#: All ways of up to 32 edges by squaring: more than the 25 nodes have.
_MIN_PLUS = """d1 AS (SELECT s AS a, d AS b, weight::DOUBLE AS w FROM e UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation)""" + "".join(
    f", d{2 * n} AS (SELECT x.a, y.b, min(x.w + y.w) AS w FROM d{n} x JOIN d{n} y ON x.b = y.a GROUP BY 1, 2)" for n in (1, 2, 4, 8, 16)
)


@query("sssp", f"WITH {TRADES}, {_MIN_PLUS} SELECT b AS node_id, w AS distance FROM d32 WHERE a = 0")
def sssp(spark, sf_dir):
    return A.dijkstra(trade_graph(spark, sf_dir), 0, weight="weight")


@query("triangle_count", f"WITH {UNDIRECTED} SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def triangle_count(spark, sf_dir):
    return A.triangle_count(trade_graph(spark, sf_dir))


@query("clustering_coeff", f"""WITH {UNDIRECTED}, t AS (SELECT p.x, count(*) AS t FROM nb p JOIN nb q ON p.x = q.x AND p.y < q.y JOIN u ON u.a = p.y AND u.b = q.y GROUP BY 1)
    SELECT n_nationkey::BIGINT AS node_id, round(CASE WHEN coalesce(d, 0) < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END, 8) AS coefficient, coalesce(t, 0)::BIGINT AS triangles
    FROM nation LEFT JOIN dg ON dg.x = n_nationkey LEFT JOIN t ON t.x = n_nationkey""")
def clustering(spark, sf_dir):
    return A.clustering_coefficient(trade_graph(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 8))


@query("jaccard_topk", f"""WITH {UNDIRECTED}, c AS (SELECT p.x AS a, q.x AS b, count(*) AS s FROM nb p JOIN nb q ON p.y = q.y AND p.x <> q.x GROUP BY 1, 2)
    SELECT a AS node1, b AS node2, round(s / (m.d + n.d - s), 8) AS score FROM c JOIN dg m ON m.x = a JOIN dg n ON n.x = b WHERE a = 0 ORDER BY s / (m.d + n.d - s) DESC, b LIMIT 5""")
def jaccard(spark, sf_dir):
    return A.similarity_topk(trade_graph(spark, sf_dir), 0, 5).withColumn("score", F.round("score", 8))


@query("adamic_adar", f"WITH {UNDIRECTED} SELECT p.x AS node1, q.x AS node2, round(sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END), 8) AS score FROM nb p JOIN nb q ON p.y = q.y AND p.x < q.x JOIN dg ON dg.x = p.y GROUP BY 1, 2")
def adamic_adar(spark, sf_dir):
    return A.neighbour_similarity(trade_graph(spark, sf_dir), "adamic_adar").withColumn("score", F.round("score", 8))


@query("closeness", f"{SHORTEST} SELECT a AS node_id, round(coalesce(sum(CASE WHEN len > 0 THEN 1 END) / nullif(sum(len), 0), 0), 8) AS closeness FROM m GROUP BY 1")
def closeness(spark, sf_dir):
    return A.closeness_centrality(trade_graph(spark, sf_dir)).withColumn("closeness", F.round("closeness", 8))


@query("betweenness")
def betweenness(spark, sf_dir):
    return A.betweenness_centrality(trade_graph(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("kcore")
def kcore(spark, sf_dir):
    return A.kcore(trade_graph(spark, sf_dir))


@query("minimum_spanning_tree")
def mst(spark, sf_dir):
    return A.minimum_spanning_forest(trade_graph(spark, sf_dir), "weight")


@query("label_propagation")
def label_propagation(spark, sf_dir):
    return A.label_propagation(trade_graph(spark, sf_dir))


@query("floyd_warshall", f"WITH {TRADES}, {_MIN_PLUS} SELECT a AS source, b AS target, w AS distance FROM d32")
def floyd_warshall(spark, sf_dir):
    return A.floyd_warshall(trade_graph(spark, sf_dir), "weight")


@query("max_flow")
def max_flow(spark, sf_dir):
    return A.max_flow(trade_graph(spark, sf_dir), 0, 1, "weight")


@query("louvain")
def louvain(spark, sf_dir):
    return A.louvain(trade_graph(spark, sf_dir))


@query("bridges")
def bridges(spark, sf_dir):
    return A.bridges(trade_graph(spark, sf_dir))


@query("khop", f"WITH {UNDIRECTED} SELECT id, min(depth) AS depth FROM (SELECT 0::BIGINT AS id, 0::BIGINT AS depth UNION ALL SELECT y, 1 FROM nb WHERE x = 0 UNION ALL SELECT b.y, 2 FROM nb a JOIN nb b ON a.y = b.x WHERE a.x = 0) GROUP BY 1")
def khop(spark, sf_dir):
    return A.khop(trade_graph(spark, sf_dir), 0, 2)[0]


#: The supply graph's directed edges and its undirected ones.
_OFFSET = {"o": 6 * 10**12, "p": 5 * 10**12, "s": 4 * 10**12}
SUPPLY = f"""e AS (SELECT DISTINCT l_orderkey + {_OFFSET['o']} AS s, l_partkey + {_OFFSET['p']} AS d FROM lineitem UNION ALL SELECT DISTINCT l_orderkey + {_OFFSET['o']}, l_suppkey + {_OFFSET['s']} FROM lineitem
    UNION ALL SELECT DISTINCT l_suppkey + {_OFFSET['s']}, l_partkey + {_OFFSET['p']} FROM lineitem),
    v AS (SELECT o_orderkey + {_OFFSET['o']} AS id FROM orders UNION ALL SELECT p_partkey + {_OFFSET['p']} FROM part UNION ALL SELECT s_suppkey + {_OFFSET['s']} FROM supplier)"""


@query("degree_supply", f"""WITH {SUPPLY}, o AS (SELECT s AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT d AS id, count(*) AS n FROM e GROUP BY 1)
    SELECT v.id AS node_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS total_degree FROM v LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def degree_supply(spark, sf_dir):
    return A.degree_centrality(supply_graph(spark, sf_dir))


_SUPPLY_RANK = "n AS (SELECT count(*)::DOUBLE AS n FROM v), k AS (SELECT s, count(*) AS k FROM e GROUP BY 1), r0 AS (SELECT id, 1 / n AS r FROM v, n)" + "".join(
    f""", l{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} ANTI JOIN k ON id = s), g{i} AS (SELECT d AS id, sum(r / k) AS got FROM e JOIN k USING (s) JOIN r{i - 1} x ON x.id = e.s GROUP BY 1),
    r{i} AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS r FROM v LEFT JOIN g{i} USING (id), n, l{i})"""
    for i in (1, 2, 3)
)


@query("pagerank_supply", f"WITH {SUPPLY}, {_SUPPLY_RANK} SELECT id AS node_id, round(r * 1e6, 4) AS millionths FROM r3")
def pagerank_supply(spark, sf_dir):
    r = A.pagerank(supply_graph(spark, sf_dir), max_iterations=3, tolerance=0.0)
    return r.select("node_id", F.round(F.col("score") * 1e6, 4).alias("millionths"))


@query("triangles_supply", """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
    SELECT count(*) AS triangles FROM c JOIN b USING (l_orderkey) JOIN h USING (l_suppkey, l_partkey)""")
def triangles_supply(spark, sf_dir):
    return A.triangle_count(supply_graph(spark, sf_dir))


@query("bfs_supply", f"""WITH RECURSIVE {SUPPLY}, p AS (SELECT {_OFFSET['o']}::BIGINT AS id, 0::BIGINT AS depth UNION SELECT d, depth + 1 FROM p JOIN e ON id = s WHERE depth < 4)
    SELECT id AS node_id, min(depth) AS depth FROM p GROUP BY 1""")
def bfs_supply(spark, sf_dir):
    return A.bfs(supply_graph(spark, sf_dir), _OFFSET["o"])


@query("wcc_supply")
def wcc_supply(spark, sf_dir):
    return A.connected_components(supply_graph(spark, sf_dir))


@query("kcore_supply")
def kcore_supply(spark, sf_dir):
    return A.kcore(supply_graph(spark, sf_dir))


@query("leiden")
def leiden(spark, sf_dir):
    return A.leiden(trade_graph(spark, sf_dir))


@query("astar", f"WITH {TRADES}, {_MIN_PLUS} SELECT b AS node_id, w AS distance FROM d32 WHERE a = 0 AND b = 7")
def astar(spark, sf_dir):
    return A.astar(trade_graph(spark, sf_dir), 0, 7, "weight")


@query("bellman_ford", f"WITH {TRADES}, {_MIN_PLUS} SELECT b AS node_id, w AS distance, false AS has_negative_cycle FROM d32 WHERE a = 0")
def bellman_ford(spark, sf_dir):
    return A.bellman_ford(trade_graph(spark, sf_dir), 0, "weight")


@query("topological_sort", """WITH v AS (SELECT c_custkey + 3000000000000 AS id, 0 AS level FROM customer UNION ALL SELECT o_orderkey + 6000000000000, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
    SELECT id AS node_id, level::BIGINT AS level, row_number() OVER (ORDER BY level, id) - 1 AS position FROM v""")
def topological_sort(spark, sf_dir):
    return A.topological_sort(star_graph(spark, sf_dir).project(labels=["Customer", "Order"], types=["PLACED"]))


@query("dfs_order")
def dfs(spark, sf_dir):
    return A.dfs(trade_graph(spark, sf_dir), 0)


@query("contraction", f"WITH {TRADES} SELECT a.n_regionkey::BIGINT AS src, b.n_regionkey::BIGINT AS dst, count(*) AS n FROM e JOIN nation a ON a.n_nationkey = s JOIN nation b ON b.n_nationkey = d WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2")
def contraction(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return A.contracted(g, g.nodes["Nation"].select("id", F.col("region").alias("group")))


@query("heat_diffusion", f"""WITH {UNDIRECTED}, h0 AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::DOUBLE AS h FROM nation)""" + "".join(
    f", h{i} AS (SELECT x.id, 0.4 * x.h + 0.6 * (SELECT avg(y.h) FROM nb JOIN h{i - 1} y ON y.id = nb.y WHERE nb.x = x.id) AS h FROM h{i - 1} x)" for i in (1, 2, 3, 4)
) + " SELECT id AS node_id, round(h, 8) AS value FROM h4")
def heat(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return A.heat_diffusion(g, g.nodes["Nation"].select("id", F.col("region").cast("double").alias("value"))).withColumn("value", F.round("value", 8))


@query("personalized_pagerank")
def personalized(spark, sf_dir):
    return A.personalized_pagerank(trade_graph(spark, sf_dir), spark.range(0, 2)).withColumn("score", F.round("score", 6))


@query("stable_communities")
def stable(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return A.stable_communities(A.louvain(g), g.nodes["Nation"].select(F.col("id").alias("node_id"), F.col("region").alias("community_id")), 0.1)


@query("hilbert_features")
def hilbert(spark, sf_dir):
    return A.hilbert_features(trade_graph(spark, sf_dir))


@query("articulation_points")
def articulation(spark, sf_dir):
    return A.articulation_points(trade_graph(spark, sf_dir))


@query("min_cost_max_flow")
def min_cost_flow(spark, sf_dir):
    return A.max_flow(trade_graph(spark, sf_dir), 0, 1, "weight", "lines")


@query("spectral_embedding")
def spectral(spark, sf_dir):
    return A.spectral_embedding(trade_graph(spark, sf_dir)).select("node_id", F.size("embedding").alias("dimensions"))
