"""Queries in the other languages over the star graph: SPARQL over its triples, SQL/PGQ, Gremlin and GraphQL."""

from __future__ import annotations

from ..plans.triples import graph_store
from ..sources.tables import star_graph, trade_graph
from .patterns import TRADES
from .registry import query, text

PREFIXES = "PREFIX p: <prop:> PREFIX e: <edge:> PREFIX l: <label:> "


def sparql(name: str, source: str, sql: str | None, graph=star_graph) -> None:
    query(name, sql)(lambda spark, sf_dir: graph(spark, sf_dir).sparql(PREFIXES + source))


def pgq(name: str, source: str, sql: str, **params: object) -> None:
    query(name, sql)(lambda spark, sf_dir: star_graph(spark, sf_dir).sql(source, **params))


def gremlin(name: str, source: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: star_graph(spark, sf_dir).gremlin(source))


sparql("sparql_bgp", "SELECT ?n ?r WHERE { ?x a l:Nation ; p:name ?n ; e:IN_REGION ?y . ?y p:name ?r }", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
sparql("sparql_filter", "SELECT ?k WHERE { ?x a l:Customer ; p:key ?k ; p:acctbal ?b ; p:mktsegment ?s FILTER(?b > 9000 && (?s = 'BUILDING' || STRSTARTS(?s, 'MACH'))) }",
       "SELECT c_custkey::VARCHAR AS k FROM customer WHERE c_acctbal > 9000 AND (c_mktsegment = 'BUILDING' OR c_mktsegment LIKE 'MACH%')")
sparql("sparql_optional", "SELECT ?k ?o WHERE { ?c a l:Customer ; p:key ?k OPTIONAL { ?c e:PLACED ?x . ?x p:key ?o ; p:total ?t FILTER(?t > 450000) } }",
       "SELECT c_custkey::VARCHAR AS k, o_orderkey::VARCHAR AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000")
sparql("sparql_union", "SELECT ?n WHERE { { ?x a l:Region } UNION { ?x a l:Nation } ?x p:name ?n }", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation")
sparql("sparql_minus", "SELECT ?k WHERE { ?c a l:Customer ; p:key ?k MINUS { ?c e:PLACED ?o . ?o p:status 'F' } }",
       "SELECT c_custkey::VARCHAR AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
sparql("sparql_not_exists", "SELECT ?k WHERE { ?c a l:Customer ; p:key ?k FILTER NOT EXISTS { ?c e:PLACED ?o } }", "SELECT c_custkey::VARCHAR AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sparql("sparql_group", "SELECT ?s (COUNT(?o) AS ?n) (ROUND(AVG(?t)) AS ?mean) WHERE { ?c p:mktsegment ?s ; e:PLACED ?o . ?o p:total ?t } GROUP BY ?s HAVING (COUNT(?o) > 10)",
       "SELECT c_mktsegment AS s, count(*) AS n, floor(avg(o_totalprice) + 0.5) AS mean FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 10")
sparql("sparql_bind", "SELECT ?n ?d ?u WHERE { ?x a l:Nation ; p:key ?k ; p:name ?n BIND(?k * 2 + 1 AS ?d) BIND(LCASE(?n) AS ?u) }", "SELECT n_name AS n, n_nationkey * 2.0::DOUBLE + 1 AS d, lower(n_name) AS u FROM nation")
sparql("sparql_values", "SELECT ?n ?k WHERE { VALUES ?n { 'ASIA' 'EUROPE' 'NOWHERE' } ?x a l:Region ; p:name ?n ; p:key ?k }", "SELECT r_name AS n, r_regionkey::VARCHAR AS k FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
sparql("sparql_subselect", "SELECT ?k ?m WHERE { { SELECT ?c (MAX(?t) AS ?m) WHERE { ?c e:PLACED ?o . ?o p:total ?t } GROUP BY ?c } ?c p:key ?k FILTER(?m > 480000) }",
       "SELECT c_custkey::VARCHAR AS k, m::VARCHAR AS m FROM (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey WHERE m > 480000")
sparql("sparql_path_seq", "SELECT ?r (COUNT(*) AS ?n) WHERE { ?c a l:Customer ; e:FROM_NATION/e:IN_REGION/p:name ?r } GROUP BY ?r",
       "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
sparql("sparql_path_alt_inv", "SELECT ?n (COUNT(?x) AS ?k) WHERE { ?y a l:Nation ; p:name ?n ; ^e:FROM_NATION|e:IN_REGION ?x } GROUP BY ?n", """
    SELECT n_name AS n, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation""")  # fmt: skip
sparql("sparql_path_plus", "SELECT ?b WHERE { ?x p:name ?a ; e:TRADES+ ?y . ?y p:name ?b FILTER(?a = 'FRANCE' || ?a = 'NATION_0') }", f"""
    WITH RECURSIVE {TRADES}, p AS (SELECT n_nationkey::BIGINT AS a, d AS b FROM nation JOIN e ON s = n_nationkey WHERE n_name IN ('FRANCE', 'NATION_0') UNION SELECT a, d FROM p JOIN e ON b = s)
    SELECT n_name AS b FROM p JOIN nation ON n_nationkey = b""", trade_graph)  # fmt: skip
sparql("sparql_path_star", "SELECT ?x WHERE { <node:0> e:TRADES* ?x }", f"WITH RECURSIVE {TRADES}, p AS (SELECT 0::BIGINT AS b UNION SELECT d FROM p JOIN e ON b = s) SELECT 'node:' || b AS x FROM p", trade_graph)
sparql("sparql_ask", "ASK { ?x a l:Region ; p:name 'ASIA' }", "SELECT count(*) > 0 AS answer FROM region WHERE r_name = 'ASIA'")
sparql("sparql_construct", "CONSTRUCT { ?n <ex:part_of> ?r } WHERE { ?x e:IN_REGION ?y . ?x p:name ?m . ?y p:name ?r BIND(IRI(CONCAT('ex:', ?m)) AS ?n) }", """
    SELECT 'ex:' || n_name AS s, 'ex:part_of' AS p, r_name AS o, 'literal' AS o_type, NULL::VARCHAR AS o_lang, NULL::VARCHAR AS g FROM nation JOIN region ON r_regionkey = n_regionkey""")  # fmt: skip
sparql("sparql_order_limit", "SELECT ?k ?t WHERE { ?o a l:Order ; p:key ?k ; p:total ?t } ORDER BY DESC(?t) ?k LIMIT 7", "SELECT o_orderkey::VARCHAR AS k, o_totalprice::VARCHAR AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
sparql("sparql_distinct", "SELECT DISTINCT ?s ?st WHERE { ?c p:mktsegment ?s ; e:PLACED/p:status ?st }", "SELECT DISTINCT c_mktsegment AS s, o_orderstatus AS st FROM customer JOIN orders ON o_custkey = c_custkey")
sparql("sparql_predicates", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?x a l:Supplier ; ?p ?o FILTER(?p != e:SHIPS) } GROUP BY ?p", """
    SELECT p, (SELECT count(*) FROM supplier) AS n FROM (SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'prop:key', 'prop:name', 'prop:acctbal', 'edge:FROM_NATION']) AS p)""")  # fmt: skip


@query("sparql_update", """SELECT n_name AS n, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_nationkey::VARCHAR END AS k FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'Utopia', NULL""")
def sparql_update(spark, sf_dir):
    store = graph_store(star_graph(spark, sf_dir)).update(PREFIXES + """
        INSERT DATA { <ex:new> a l:Nation ; p:name 'Utopia' } ;
        DELETE { ?x p:key ?k } INSERT { ?x p:key 'moved' } WHERE { ?x a l:Nation ; p:key ?k ; e:IN_REGION ?r . ?r p:key 1 } ;
        DELETE { ?x p:name ?n } WHERE { ?x a l:Nation ; p:name ?n ; e:IN_REGION ?r . ?r p:key 2 }
    """)
    return store.query(PREFIXES + "SELECT ?n ?k WHERE { ?x a l:Nation ; p:name ?n OPTIONAL { ?x p:key ?k } }")


@query("sparql_graphs", "SELECT 'ex:b' AS g, count(*) AS n FROM region UNION ALL SELECT 'ex:c', count(*) FROM region")
def sparql_graphs(spark, sf_dir):
    store = graph_store(star_graph(spark, sf_dir)).update(PREFIXES + """
        INSERT { GRAPH <ex:a> { ?x p:name ?n } } WHERE { ?x a l:Region ; p:name ?n } ; COPY <ex:a> TO <ex:b> ; MOVE <ex:a> TO <ex:c> ; CLEAR GRAPH <ex:d>
    """)
    return store.query(PREFIXES + "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x p:name ?n } } GROUP BY ?g")


@query("triple_scan", "SELECT 'edge:IN_REGION' AS p, count(*) AS n FROM nation UNION ALL SELECT 'edge:PLACED', count(*) FROM orders")
def triple_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    return graph_store(star_graph(spark, sf_dir)).triples.where("p IN ('edge:IN_REGION', 'edge:PLACED')").groupBy("p").agg(F.count("*").alias("n"))


pgq("pgq_match", """SELECT segment, count(*) AS n, max(total) AS most FROM GRAPH_TABLE (MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.total > 200000 COLUMNS (c.mktsegment AS segment, o.total)) AS t
    GROUP BY segment""", "SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1")  # fmt: skip
pgq("pgq_join", """SELECT a.region, a.n AS customers, b.n AS suppliers FROM (SELECT region, count(*) AS n FROM GRAPH_TABLE (MATCH (:Customer)-[:FROM_NATION]->()-[:IN_REGION]->(r:Region) COLUMNS (r.name AS region)) GROUP BY region) a
    JOIN (SELECT region, count(*) AS n FROM GRAPH_TABLE (MATCH (:Supplier)-[:FROM_NATION]->()-[:IN_REGION]->(r:Region) COLUMNS (r.name AS region)) GROUP BY region) b ON a.region = b.region""",
    """SELECT r_name AS region, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS customers,
    (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS suppliers FROM region""")  # fmt: skip
pgq("pgq_order_limit", "SELECT key, total FROM GRAPH_TABLE (MATCH (o:Order) COLUMNS (o.key, o.total)) WHERE total < 300000 ORDER BY total DESC, key LIMIT 5 OFFSET 2",
    "SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_totalprice < 300000 ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 2")


@query("pgq_create_graph", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pgq_create_graph(spark, sf_dir):
    from ..graph import GraphCatalog
    from ..plans.pgq import sql
    from ..sources.tables import read

    for name in ("nation", "customer"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"{name}_rows")
    read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey").createOrReplaceTempView("lives_in")
    catalog = GraphCatalog(spark)
    sql(catalog, """CREATE PROPERTY GRAPH People NODE TABLES (nation_rows (n_nationkey BIGINT PRIMARY KEY, n_name VARCHAR), customer_rows (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(25)))
        EDGE TABLES (lives_in (c_custkey BIGINT REFERENCES customer_rows(c_custkey), c_nationkey BIGINT REFERENCES nation_rows(n_nationkey)))""")
    return sql(catalog, "SELECT nation, count(*) AS n FROM GRAPH_TABLE (People MATCH (c:customer_rows)-[:lives_in]->(n:nation_rows) COLUMNS (n.n_name AS nation)) GROUP BY nation")


gremlin("gremlin_out_values", "g.V().hasLabel('Nation').out('IN_REGION').values('name')", "SELECT r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
gremlin("gremlin_has", "g.V().has('Customer', 'acctbal', gt(9500)).values('key')", "SELECT c_custkey AS value FROM customer WHERE c_acctbal > 9500")
gremlin("gremlin_group_count", "g.V().hasLabel('Customer').groupCount().by('mktsegment')", "SELECT c_mktsegment AS key, count(*) AS value FROM customer GROUP BY 1")
gremlin("gremlin_where_not", "g.V().hasLabel('Customer').not(__.out('PLACED').has('status', 'F')).count()", "SELECT count(*) AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
gremlin("gremlin_project", "g.V().hasLabel('Nation').project('nation', 'customers').by('name').by(__.in('FROM_NATION').hasLabel('Customer').count())",
        "SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
gremlin("gremlin_edges", "g.E().hasLabel('CONTAINS').has('quantity', gte(49)).outV().dedup().count()", "SELECT count(DISTINCT l_orderkey) AS value FROM lineitem WHERE l_quantity >= 49")
gremlin("gremlin_order_limit", "g.V().hasLabel('Order').order().by('total', desc).limit(3).values('total')", "SELECT o_totalprice AS value FROM orders ORDER BY 1 DESC LIMIT 3")
gremlin("gremlin_select", "g.V().hasLabel('Customer').as('c').out('PLACED').has('total', gt(480000)).as('o').select('c', 'o').by('key')",
        "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 480000")
gremlin("gremlin_branches", "g.V().hasLabel('Customer').choose(__.out('PLACED'), __.constant('buys'), __.constant('none')).groupCount()",
        "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'buys' ELSE 'none' END AS key, count(*) AS value FROM customer GROUP BY 1")
gremlin("gremlin_sum", "g.V().hasLabel('Supplier').values('key').sum()", "SELECT sum(s_suppkey)::BIGINT AS value FROM supplier")


def graphql(name: str, source: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: star_graph(spark, sf_dir).graphql(source))


graphql("graphql_filter", "{ customer(acctbal_gt: 9000, mktsegment_in: [\"BUILDING\", \"MACHINERY\"]) { key mktsegment } }", "SELECT c_custkey AS key, c_mktsegment AS mktsegment FROM customer WHERE c_acctbal > 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
graphql("graphql_order", "{ order(orderBy: {total: DESC, key: ASC}, limit: 5) { key total } }", "SELECT o_orderkey AS key, o_totalprice AS total FROM orders ORDER BY 2 DESC, 1 LIMIT 5")


@query("graphql_nested", "SELECT n_name AS name, r_name AS region, 1::BIGINT AS n FROM nation JOIN region ON r_regionkey = n_regionkey")
def graphql_nested(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = star_graph(spark, sf_dir).graphql("{ nation { name IN_REGION { name } } }")
    return rows.select("name", F.get("IN_REGION", F.lit(0)).getField("name").alias("region"), F.size("IN_REGION").cast("long").alias("n"))


@query("graphql_mutation", "SELECT r_name AS name FROM region WHERE r_regionkey > 0 UNION ALL SELECT 'Atlantis'")
def graphql_mutation(spark, sf_dir):
    from ..plans.graphql import mutate
    from ..sources.tables import OFFSETS, STRIDE

    g = mutate(star_graph(spark, sf_dir), f'mutation {{ createRegion(name: "Atlantis", key: 9) {{ id }} deleteRegion(id: {OFFSETS["Region"] * STRIDE}) {{ id }} }}')
    return g.graphql("{ region { name } }")


# -- forms of the pattern language that the star queries don't use
text("group_pattern", trade_graph, "MATCH (a:Nation)((x)-[t:TRADES]->(y) WHERE t.weight > 1000000 AND x.name <> y.name){1,2}(b:Nation) RETURN a.id AS a, count(*) AS n", f"""
    WITH {TRADES}, f AS (SELECT s, d FROM e WHERE weight > 1000000 AND s <> d) SELECT a, count(*) AS n FROM (SELECT s AS a FROM f UNION ALL SELECT x.s FROM f x JOIN f y ON x.d = y.s) GROUP BY 1""")  # fmt: skip
text("path_alternation", star_graph, "MATCH (c:Customer)-[:PLACED]->(x) |+| (c:Customer)-[:FROM_NATION]->(x) RETURN labels(x)[0] AS label, count(*) AS n", """
    SELECT 'Order' AS label, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'Nation', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey""")  # fmt: skip
text("simple_paths", trade_graph, "MATCH SIMPLE (a:Nation {id: 0})-[:TRADES*2..2]->(b:Nation) RETURN b.id AS b, count(*) AS n", f"""
    WITH {TRADES} SELECT y.d AS b, count(*) AS n FROM e x JOIN e y ON x.d = y.s WHERE x.s = 0 AND x.d <> 0 AND (y.d = 0 OR y.d <> x.d) GROUP BY 1""")  # fmt: skip
text("all_shortest", trade_graph, "MATCH (a:Nation {id: 0}), (b:Nation) WHERE b.id <> 0 MATCH p = allShortestPaths((a)-[:TRADES*]->(b)) RETURN b.id AS b, p AS len, count(*) AS paths", f"""
    WITH {TRADES}, one AS (SELECT d AS b, 1::BIGINT AS len, count(*) AS paths FROM e WHERE s = 0 AND d <> 0 GROUP BY 1),
    two AS (SELECT y.d AS b, 2::BIGINT AS len, count(*) AS paths FROM e x JOIN e y ON x.d = y.s WHERE x.s = 0 AND y.d <> 0 AND x.d <> 0 GROUP BY 1),
    r1 AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE b NOT IN (SELECT b FROM one))
    SELECT * FROM r1""")  # fmt: skip
text("agg_first_last", star_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS segment, first_value(o.total, o.key) AS first, last_value(o.total, o.key) AS last",
     "SELECT c_mktsegment AS segment, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
text("agg_collect", star_graph, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, collect(n.key) AS keys, collect(DISTINCT n.key % 3) AS rests RETURN region, size(keys) AS n, size(rests) AS k, reduce(s = 0, x IN keys | s + x) AS total",
     "SELECT r_name AS region, count(*) AS n, count(DISTINCT n_nationkey % 3) AS k, sum(n_nationkey)::BIGINT AS total FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
text("agg_regression_all", star_graph, """MATCH ()-[l:CONTAINS]->(p:Part) RETURN round(regr_sxx(l.price, l.quantity) / 1000, 0) AS sxx, round(regr_syy(l.price, l.quantity) / 1e9, 0) AS syy, round(regr_sxy(l.price, l.quantity) / 1e6, 0) AS sxy,
    round(regr_avgx(l.price, l.quantity), 6) AS ax, round(regr_avgy(l.price, l.quantity), 2) AS ay, round(covar_samp(l.price, l.quantity), 1) AS cs""", """
    SELECT round(regr_sxx(l_extendedprice, l_quantity) / 1000, 0) AS sxx, round(regr_syy(l_extendedprice, l_quantity) / 1e9, 0) AS syy, round(regr_sxy(l_extendedprice, l_quantity) / 1e6, 0) AS sxy,
    round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(covar_samp(l_extendedprice, l_quantity), 1) AS cs FROM lineitem JOIN part ON l_partkey = p_partkey""")  # fmt: skip
text("map_functions", star_graph, "MATCH (r:Region) RETURN r.key AS key, properties({a: r.key + 1, b: r.name}).a AS a, duration({days: 2, hours: 3}).nanos AS nanos, size(keys(r)) AS n",
     "SELECT r_regionkey::BIGINT AS key, r_regionkey::BIGINT + 1 AS a, 10800000000000::BIGINT AS nanos, 2::BIGINT AS n FROM region")
text("string_functions", star_graph, """MATCH (n:Nation) RETURN n.key AS key, ltrim('  ' + n.name) AS l, rtrim(n.name + '  ') AS r, char_length(n.name) AS c, octet_length(n.name) AS o, string_join(split(n.name, 'A'), '-') AS j,
    toString(n.key) AS t, n.name || '!' AS x, normalize(n.name) AS u, coalesce(null, n.name) AS y, nullIf(n.key, 3) AS z""", """
    SELECT n_nationkey::BIGINT AS key, n_name AS l, n_name AS r, length(n_name) AS c, octet_length(encode(n_name)) AS o, replace(n_name, 'A', '-') AS j, n_nationkey::VARCHAR AS t, n_name || '!' AS x, n_name AS u, n_name AS y,
    nullif(n_nationkey, 3)::BIGINT AS z FROM nation""")  # fmt: skip
text("number_functions", star_graph, """MATCH (n:Nation) RETURN n.key AS key, round(exp(n.key / 10.0), 8) AS e, round(ln(n.key + 1), 8) AS l, round(log10(n.key + 1), 8) AS l10, round(log2(n.key + 1), 8) AS l2, round(cos(n.key) + tan(n.key), 8) AS t,
    round(degrees(pi()), 6) AS d, round(radians(n.key), 8) AS r, n.key - 30 AS m, round(e(), 8) AS euler""", """
    SELECT n_nationkey::BIGINT AS key, round(exp(n_nationkey / 10.0::DOUBLE), 8) AS e, round(ln(n_nationkey + 1), 8) AS l, round(log10(n_nationkey + 1), 8) AS l10, round(log2(n_nationkey + 1), 8) AS l2,
    round(cos(n_nationkey) + tan(n_nationkey), 8) AS t, round(degrees(pi()), 6) AS d, round(radians(n_nationkey), 8) AS r, n_nationkey::BIGINT - 30 AS m, round(exp(1.0::DOUBLE), 8) AS euler FROM nation""")  # fmt: skip
text("time_functions", star_graph, "MATCH (o:Order) RETURN year(o.day) AS y, month(o.day) AS m, count(*) AS n, min(day(o.day)) AS d", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, min(day(o_orderdate)) AS d FROM orders GROUP BY 1, 2")
text("count_all", star_graph, "MATCH (o:Order) RETURN count(o) AS n", "SELECT count(*) AS n FROM orders")
text("call_procedure", trade_graph, "CALL degree_centrality() YIELD node_id, out_degree WHERE out_degree > 0 RETURN node_id AS node, out_degree AS d", f"WITH {TRADES} SELECT s AS node, count(*) AS d FROM e GROUP BY 1")
