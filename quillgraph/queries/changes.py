"""Statements that change a graph, each followed by a query over the changed graph, with SQL for what it must show; change logs and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.tables import read, star_graph
from .registry import query


def changed(name: str, statement: str, then: str, sql: str | None, **params: object) -> None:
    query(name, sql)(lambda spark, sf_dir: star_graph(spark, sf_dir).execute(statement, **params).graph.query(then))


changed("create_nodes", "MATCH (n:Nation) WHERE n.key < 5 CREATE (a:Audit {nation: n.name, level: n.key * 2})", "MATCH (a:Audit) RETURN a.nation AS nation, a.level AS level",
        "SELECT n_name AS nation, n_nationkey::BIGINT * 2 AS level FROM nation WHERE n_nationkey < 5")
changed("create_edges", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.total > 400000 CREATE (c)-[:VALUED {total: o.total}]->(o)",
        "MATCH (c:Customer)-[v:VALUED]->(o:Order) RETURN c.mktsegment AS segment, count(*) AS n, max(v.total) AS most",
        "SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY 1")
changed("delete_detach", "MATCH (o:Order {status: 'F'}) DETACH DELETE o", "MATCH (c:Customer)-[:PLACED]->(o) RETURN o.status AS status, count(*) AS n",
        "SELECT o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' GROUP BY 1")
changed("delete_edges", "MATCH (c:Customer)-[p:PLACED]->(o:Order) WHERE o.total < 100000 DELETE p", "MATCH (c:Customer)-[p:PLACED]->(o:Order) RETURN count(p) AS left, min(o.total) >= 100000 AS large",
        "SELECT count(*) AS left, min(o_totalprice) >= 100000 AS large FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 100000")
changed("set_props", "MATCH (c:Customer) WHERE c.acctbal < 0 SET c.acctbal = 0.0, c.debtor = true, c:Debtor", "MATCH (c:Customer) RETURN c:Debtor AS debtor, c.debtor AS flag, count(*) AS n, min(c.acctbal) AS least",
        "SELECT c_acctbal < 0 AS debtor, CASE WHEN c_acctbal < 0 THEN true END AS flag, count(*) AS n, min(greatest(c_acctbal, 0)) AS least FROM customer GROUP BY 1, 2")
changed("set_map", "MATCH (s:Supplier) WHERE s.key % 2 = 0 SET s += {name: 'even', rank: s.key + 1}", "MATCH (s:Supplier) RETURN s.name = 'even' AS even, count(*) AS n, sum(s.rank) AS ranks",
        "SELECT s_suppkey % 2 = 0 AS even, count(*) AS n, sum(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1 END)::BIGINT AS ranks FROM supplier GROUP BY 1")
changed("remove_props", "MATCH (p:Part) WHERE p.size > 25 REMOVE p.brand, p:Part", "MATCH (p:Part) RETURN count(*) AS n, count(p.brand) AS brands", "SELECT count(*) AS n, count(p_brand) AS brands FROM part WHERE p_size <= 25")
changed("merge_upsert", "MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment}) ON CREATE SET s.fresh = true", "MATCH (s:Segment) RETURN s.name AS name, s.fresh AS fresh, count(*) AS n",
        "SELECT DISTINCT c_mktsegment AS name, true AS fresh, 1::BIGINT AS n FROM customer")
changed("merge_match", "MATCH (n:Nation) MERGE (r:Region {name: CASE WHEN n.key < 3 THEN 'ATLANTIS' ELSE 'ASIA' END}) ON MATCH SET r.key = 99", "MATCH (r:Region) RETURN r.name AS name, r.key AS key",
        "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN 99 ELSE r_regionkey END::BIGINT AS key FROM region UNION ALL SELECT 'ATLANTIS', NULL")
changed("merge_edges", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) MERGE (n)-[:HOSTS]->(s:Segment {name: c.mktsegment})", "MATCH (n:Nation)-[:HOSTS]->(s) RETURN n.name AS nation, count(*) AS segments",
        "SELECT n_name AS nation, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
changed("foreach_create", "MATCH (r:Region) FOREACH (x IN range(1, 3) | CREATE (r)-[:HAS]->(:Slot {no: x}))", "MATCH (r:Region)-[:HAS]->(s:Slot) RETURN r.name AS region, count(*) AS n, sum(s.no) AS total",
        "SELECT r_name AS region, 3::BIGINT AS n, 6::BIGINT AS total FROM region")


def order_log(spark, sf_dir):
    """Events as a change log: an entity is a user, an epoch an event's number; an error deletes."""
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("epoch"), kind.alias("kind"), F.when(kind != "delete", F.col("value")).alias("after"))


_LOG = "l AS (SELECT user_id AS entity, event_id AS epoch, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS kind, CASE WHEN event_type <> 'error' THEN value END AS after FROM events)"


@query("cdc_between", f"WITH {_LOG} SELECT * FROM l WHERE epoch BETWEEN 100 AND 300")
def cdc_between(spark, sf_dir):
    return H.changes_between(order_log(spark, sf_dir), 100, 300)


@query("cdc_history", f"WITH {_LOG} SELECT * FROM l WHERE entity = 8")
def cdc_history(spark, sf_dir):
    return H.history(order_log(spark, sf_dir), 8)


@query("time_travel", f"WITH {_LOG}, x AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY epoch DESC) AS n FROM l WHERE epoch <= 500) SELECT entity, epoch, after FROM x WHERE n = 1 AND kind <> 'delete'")
def time_travel(spark, sf_dir):
    return H.state_at(order_log(spark, sf_dir), 500)


@query("versions_as_of", f"WITH {_LOG}, v AS (SELECT *, lead(epoch) OVER (PARTITION BY entity ORDER BY epoch) AS valid_to FROM l) SELECT entity, epoch, after, valid_to FROM v WHERE epoch <= 700 AND (valid_to IS NULL OR valid_to > 700) AND kind <> 'delete'")
def versions_as_of(spark, sf_dir):
    return H.as_of(H.versions(order_log(spark, sf_dir)), 700).select("entity", "epoch", "after", "valid_to")


@query("state_difference", f"""WITH {_LOG}, a AS (SELECT entity, arg_max(after, epoch) AS v, arg_max(kind, epoch) AS k FROM l WHERE epoch <= 300 GROUP BY 1), b AS (SELECT entity, arg_max(after, epoch) AS v, arg_max(kind, epoch) AS k FROM l GROUP BY 1),
    x AS (SELECT * FROM a WHERE k <> 'delete'), y AS (SELECT * FROM b WHERE k <> 'delete')
    SELECT entity, CASE WHEN x.k IS NULL THEN 'create' WHEN y.k IS NULL THEN 'delete' ELSE 'update' END AS kind, y.v AS after FROM x FULL JOIN y USING (entity) WHERE x.k IS NULL OR y.k IS NULL OR x.v IS DISTINCT FROM y.v""")
def state_difference(spark, sf_dir):
    log = order_log(spark, sf_dir)
    return H.difference(H.state_at(log, 300), H.state_at(log, 2**60))


def _stream_folder(spark, name):
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    if not base.startswith(("file:", "/tmp")) and "://" not in base:
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stream_counters", "SELECT user_id AS node, round(sum(pow(2.0, -(epoch(last) - epoch(ts)) / 2592000.0)), 6) AS value FROM events JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) USING (user_id) GROUP BY 1")
def stream_counters(spark, sf_dir):
    from ..streaming import feed

    schema = read(spark, sf_dir, "events").schema
    events = feed.change_stream(spark, f"{sf_dir}/events*.parquet", schema).select(F.col("user_id").alias("node"), "ts", F.lit(1.0).alias("amount"))
    found = feed.collected(feed.decayed_counters(events, 30 * 86_400.0), _stream_folder(spark, "counters"), mode="update")
    last = found.groupBy("node").agg(F.max_by("value", "batch").alias("value"))
    return last.select("node", F.round("value", 6).alias("value"))


@query("stream_subscription", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def stream_subscription(spark, sf_dir):
    from ..streaming import feed

    schema = read(spark, sf_dir, "events").schema
    events = feed.change_stream(spark, f"{sf_dir}/events*.parquet", schema).withColumnRenamed("event_type", "kind")
    return feed.collected(feed.subscribed(events, ["click", "purchase"]), _stream_folder(spark, "feed")).groupBy("kind").agg(F.count("*").alias("n"))
