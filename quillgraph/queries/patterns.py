"""Pattern queries over the star graph, each with SQL over the tables."""

from __future__ import annotations

from ..sources.tables import star_graph, trade_graph
from .registry import text

P = lambda name, source, sql, **params: text(name, star_graph, source, sql, **params)

P("flagship", """
    MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.total > 100000
    RETURN c.mktsegment AS segment, count(*) AS n, round(sum(o.total)) AS total ORDER BY n DESC
""", """
    SELECT c_mktsegment AS segment, count(*) AS n, CAST(round(sum(o_totalprice)) AS BIGINT) AS total
    FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1
""")
P("node_scan_label", "MATCH (n:Nation) RETURN n.key AS key, n.name AS name", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation")
P("node_scan_all", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", """
    SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
    UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders
""")
P("label_expression", "MATCH (n:Customer|Supplier&!Part) RETURN labels(n)[0] AS label, count(*) AS n, round(avg(n.acctbal)) AS mean", """
    SELECT 'Customer' AS label, count(*) AS n, CAST(round(avg(c_acctbal)) AS BIGINT) AS mean FROM customer
    UNION ALL SELECT 'Supplier', count(*), CAST(round(avg(s_acctbal)) AS BIGINT) FROM supplier
""")
P("edge_scan_types", "MATCH ()-[e:placed|FROM_NATION]->() RETURN type(e) AS type, count(*) AS n", """
    SELECT 'PLACED' AS type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'FROM_NATION', (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
""")
P("expand_out", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) RETURN n.name AS nation, count(c) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
P("expand_in", "MATCH (n:Nation)<-[:FROM_NATION]-(s:Supplier) RETURN n.name AS nation, count(s) AS n", "SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
P("expand_both", "MATCH (n:Nation)-[e]-(x) RETURN n.name AS nation, count(*) AS n", """
    SELECT n_name AS nation, count(*) AS n FROM (
      SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    JOIN nation ON k = n_nationkey GROUP BY 1
""")
P("two_hop", "MATCH (c:Customer)-[:FROM_NATION]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n", """
    SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
P("three_hop_filter", """
    MATCH (n:Nation)<-[:FROM_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part)
    WHERE p.size < 5 AND l.quantity > 40 AND o.status = 'F' RETURN n.name AS nation, count(*) AS n, round(sum(l.price)) AS price
""", """
    SELECT n_name AS nation, count(*) AS n, CAST(round(sum(l_extendedprice)) AS BIGINT) AS price FROM nation JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    WHERE p_size < 5 AND l_quantity > 40 AND o_orderstatus = 'F' GROUP BY 1
""")
P("optional_match", """
    MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 300000
    RETURN c.key AS key, count(o) AS n, max(o.total) AS most
""", """
    SELECT c_custkey AS key, count(o_orderkey) AS n, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1
""")
P("multi_pattern_join", """
    MATCH (c:Customer)-[:FROM_NATION]->(n:Nation), (s:Supplier)-[:FROM_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs
""", "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
P("node_properties_inline", "MATCH (c:Customer {mktsegment: $s})-[:PLACED]->(o {status: 'O'}) RETURN count(*) AS n", """
    SELECT count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND o_orderstatus = 'O'
""", s="AUTOMOBILE")
P("exists_subquery", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.total > 400000 } RETURN c.key AS key", """
    SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
""")
P("not_exists_subquery", "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order) } AND c.acctbal > 0 RETURN c.key AS key", """
    SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
P("exists_in_expression", "MATCH (c:Customer) RETURN EXISTS { (c)-[:PLACED]->(o) WHERE o.status = 'P' } AS pending, count(*) AS n", """
    SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending, count(*) AS n FROM customer GROUP BY 1
""")
P("count_subquery", "MATCH (c:Customer) WHERE COUNT { (c)-[:PLACED]->(:Order) } > 18 RETURN c.key AS key", """
    SELECT c_custkey AS key FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 18
""")
P("pattern_comprehension", "MATCH (n:Nation) RETURN n.key AS key, size([(n)<-[:FROM_NATION]-(s:Supplier) WHERE s.acctbal > 0 | s.key]) AS n", """
    SELECT CAST(n_nationkey AS BIGINT) AS key, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1
""")
P("call_subquery", """
    MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:FROM_NATION]-(c:Customer) RETURN count(c) AS customers, max(c.acctbal) AS most } RETURN n.name AS nation, customers, most
""", "SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS most FROM nation")
P("call_aggregate_empty", """
    MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 350000 RETURN count(o) AS large, round(sum(o.total), 2) AS worth } RETURN c.key AS key, large, worth
""", """SELECT c_custkey AS key, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) AS large,
    (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) AS worth FROM customer""")
P("call_rows_limited", """
    MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) RETURN o.key AS key, o.total AS total ORDER BY total DESC, key LIMIT 2 } RETURN c.key AS customer, key, total
""", """SELECT o_custkey AS customer, o_orderkey AS key, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
P("value_subquery", """
    MATCH (c:Customer) RETURN c.key AS key, VALUE { MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'O' RETURN max(o.total) } AS most
""", "SELECT c_custkey AS key, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS most FROM customer")
P("optional_call", """
    MATCH (c:Customer) OPTIONAL CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 350000 RETURN count(o) AS large } RETURN c.key AS key, large
""", "SELECT c_custkey AS key, count(o_orderkey) AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 GROUP BY 1")
P("unwind_ordinality", "FOR x IN ['a', 'b', 'c'] WITH ORDINALITY i RETURN x, i", "SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 2), ('c', 3)) t(x, i)")
P("unwind_offset", "FOR x IN range(10, 4, -2) WITH OFFSET i RETURN x, i", "SELECT * FROM (VALUES (10::BIGINT, 0::BIGINT), (8, 1), (6, 2), (4, 3)) t(x, i)")
P("agg_basic", "MATCH (o:Order) RETURN o.priority AS priority, count(*) AS n, min(o.total) AS low, max(o.total) AS high, round(avg(o.total)) AS mean", """
    SELECT o_orderpriority AS priority, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(round(avg(o_totalprice)) AS BIGINT) AS mean FROM orders GROUP BY 1
""")
P("agg_distinct", "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.mktsegment AS segment, count(DISTINCT c) AS customers, count(DISTINCT o.priority) AS priorities", """
    SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
P("agg_stats", "MATCH (s:Supplier) RETURN round(stdev(s.acctbal), 4) AS sd, round(stdevp(s.acctbal), 4) AS sdp, round(variance(s.acctbal), 2) AS v, round(var_pop(s.acctbal), 2) AS vp", """
    SELECT round(stddev_samp(s_acctbal), 4) AS sd, round(stddev_pop(s_acctbal), 4) AS sdp, round(var_samp(s_acctbal), 2) AS v, round(var_pop(s_acctbal), 2) AS vp FROM supplier
""")
P("agg_percentiles", "MATCH (p:Part) RETURN p.kind AS kind, percentile_disc(p.size, 0.5) AS d, round(percentile_cont(p.price, 0.9), 4) AS c", """
    SELECT p_type AS kind, CAST(list_sort(list(p_size))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS DOUBLE) AS d, round(quantile_cont(p_retailprice, 0.9), 4) AS c FROM part GROUP BY 1
""")
P("agg_regression", """
    MATCH ()-[l:CONTAINS]->(p:Part) RETURN round(corr(l.price, l.quantity), 6) AS r, round(regr_slope(l.price, l.quantity), 4) AS slope,
    round(regr_intercept(l.price, l.quantity), 2) AS intercept, round(regr_r2(l.price, l.quantity), 6) AS r2, regr_count(l.price, l.quantity) AS n, round(covar_pop(l.price, l.quantity), 1) AS cov
""", """
    SELECT round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
    round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(covar_pop(l_extendedprice, l_quantity), 1) AS cov FROM lineitem JOIN part ON l_partkey = p_partkey
""")
P("agg_group_concat", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS region, listagg(n.name) AS nations, group_concat(DISTINCT r.name) AS one", """
    SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations, r_name AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
P("agg_having", "MATCH (c:Customer)-[:PLACED]->(o) WITH c.mktsegment AS segment, o.status AS status, count(*) AS n WHERE n > 900 RETURN segment, status, n", """
    SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) > 900
""")
P("agg_expression", "MATCH (o:Order) RETURN o.status AS status, round(sum(o.total) / count(*)) AS mean, count(*) * 2 AS twice", """
    SELECT o_orderstatus AS status, CAST(round(sum(o_totalprice) / count(*)) AS BIGINT) AS mean, count(*) * 2 AS twice FROM orders GROUP BY 1
""")
P("distinct_rows", "MATCH (c:Customer)-[:PLACED]->(o) RETURN DISTINCT c.mktsegment AS segment, o.priority AS priority", "SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey")
P("sort_nulls", """
    MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 440000 WITH c.key AS key, max(o.total) AS most ORDER BY most DESC, key LIMIT 5 RETURN key, most
""", """
    SELECT key, most FROM (SELECT c_custkey AS key, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 440000 GROUP BY 1) ORDER BY most DESC NULLS FIRST, key LIMIT 5
""")
P("top_k", "MATCH (o:Order) RETURN o.key AS key, o.total AS total ORDER BY total DESC, key LIMIT 10", "SELECT o_orderkey AS key, o_totalprice AS total FROM orders ORDER BY total DESC, key LIMIT 10")
P("skip_limit", "MATCH (p:Part) RETURN p.key AS key, p.price AS price ORDER BY price, key SKIP 20 LIMIT $n", "SELECT p_partkey AS key, p_retailprice AS price FROM part ORDER BY price, key LIMIT 7 OFFSET 20", n=7)
P("union_all", "MATCH (c:Customer) RETURN c.key AS key UNION ALL MATCH (s:Supplier) RETURN s.key AS key", "SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey FROM supplier")
P("union_distinct", "MATCH (c:Customer) RETURN c.key AS key UNION MATCH (s:Supplier) RETURN s.key AS key", "SELECT c_custkey AS key FROM customer UNION SELECT s_suppkey FROM supplier")
P("except_all", "MATCH (o:Order) RETURN o.priority AS x EXCEPT ALL MATCH (o:Order) WHERE o.status = 'F' RETURN o.priority AS x", "SELECT o_orderpriority AS x FROM orders EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
P("except_distinct", "MATCH (c:Customer) RETURN c.key AS key EXCEPT MATCH (c:Customer)-[:PLACED]->() RETURN c.key AS key", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
P("intersect_all", "MATCH (o:Order) WHERE o.status = 'O' RETURN o.priority AS x INTERSECT ALL MATCH (o:Order) WHERE o.status = 'F' RETURN o.priority AS x", """
    SELECT o_orderpriority AS x FROM orders WHERE o_orderstatus = 'O' INTERSECT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'
""")
P("intersect_distinct", "MATCH (c:Customer) RETURN c.key AS key INTERSECT MATCH (s:Supplier) RETURN s.key AS key", "SELECT c_custkey AS key FROM customer INTERSECT SELECT s_suppkey FROM supplier")
P("otherwise_empty", "MATCH (r:Region) WHERE r.key > 100 RETURN r.name AS name OTHERWISE MATCH (r:Region) RETURN r.name AS name", "SELECT r_name AS name FROM region")
P("otherwise_nonempty", "MATCH (r:Region) WHERE r.key = 1 RETURN r.name AS name OTHERWISE MATCH (r:Region) RETURN r.name AS name", "SELECT r_name AS name FROM region WHERE r_regionkey = 1")
P("str_funcs", """
    MATCH (p:Part) RETURN p.key AS key, toUpper(p.name) AS up, substring(p.name, 1, 3) AS part, replace(p.name, 'a', 'b') AS swapped, left(p.brand, 3) AS l, right(p.brand, 2) AS r,
    reverse(p.kind) AS back, size(p.name) AS n, split(p.brand, '#')[0] AS head, p.name STARTS WITH 'P' AS s, p.kind CONTAINS 'O' AS c, p.kind ENDS WITH 'D' AS e, trim('  x ') AS t
""", """
    SELECT p_partkey AS key, upper(p_name) AS up, substring(p_name, 2, 3) AS part, replace(p_name, 'a', 'b') AS swapped, left(p_brand, 3) AS l, right(p_brand, 2) AS r,
    reverse(p_type) AS back, length(p_name) AS n, string_split(p_brand, '#')[1] AS head, starts_with(p_name, 'P') AS s, contains(p_type, 'O') AS c, ends_with(p_type, 'D') AS e, 'x' AS t FROM part
""")
P("math_funcs", """
    MATCH (s:Supplier) RETURN s.key AS key, abs(s.acctbal) AS a, ceil(s.acctbal) AS c, floor(s.acctbal) AS f, round(s.acctbal) AS r, sign(s.acctbal) AS g, round(sqrt(abs(s.acctbal)), 6) AS q,
    s.key / 7 AS whole, s.key % 7 AS rest, s.key / 2.0 AS half, round(2 ^ (s.key % 5), 2) AS p, round(sin(s.key), 6) AS si, round(atan2(s.key, 3.0), 6) AS at, s.key / 0 AS none
""", """
    SELECT s_suppkey AS key, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(round(s_acctbal) AS BIGINT) AS r, CAST(sign(s_acctbal) AS BIGINT) AS g,
    round(sqrt(abs(s_acctbal)), 6) AS q, s_suppkey // 7 AS whole, s_suppkey % 7 AS rest, s_suppkey / 2.0::DOUBLE AS half, round(pow(2, s_suppkey % 5), 2) AS p, round(sin(s_suppkey), 6) AS si, round(atan2(s_suppkey, 3.0), 6) AS at,
    CAST(NULL AS BIGINT) AS none FROM supplier
""")
P("date_funcs", """
    MATCH (o:Order) RETURN o.key AS key, year(o.day) AS y, month(o.day) AS m, day(o.day) AS d, hour(o.day) AS h, date(o.day) + duration('P1M') AS later, date(o.day) < date('1995-06-01') AS early
""", """
    SELECT o_orderkey AS key, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, CAST(o_orderdate AS DATE) < DATE '1995-06-01' AS early FROM orders
""")
P("list_funcs", """
    UNWIND range(1, 6) AS n WITH n, range(1, n) AS l RETURN n, head(l) AS h, last(l) AS z, size(tail(l)) AS t, l[-1] AS neg, size(l[1..3]) AS cut, [x IN l WHERE x % 2 = 0 | x * x] AS sq, reduce(s = 0, x IN l | s + x) AS sum
""", """
    SELECT n, 1::BIGINT AS h, n AS z, n - 1 AS t, n AS neg, greatest(least(n, 3) - 1, 0) AS cut, [x * x FOR x IN range(1, n + 1) IF x % 2 = 0] AS sq, CAST(list_sum(range(1, n + 1)) AS BIGINT) AS sum FROM (SELECT unnest(range(1, 7)) AS n)
""")
P("list_predicates", "UNWIND range(1, 5) AS n WITH n, range(1, n) AS l RETURN n, all(x IN l WHERE x < 4) AS a, any(x IN l WHERE x = 3) AS b, none(x IN l WHERE x > 4) AS c, single(x IN l WHERE x > 3) AS d", """
    SELECT n, n < 4 AS a, n >= 3 AS b, n <= 4 AS c, n = 4 AS d FROM (SELECT unnest(range(1, 6)) AS n)
""")
P("case_simple", "MATCH (o:Order) RETURN CASE o.status WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state, count(*) AS n FROM orders GROUP BY 1")
P("case_searched", "MATCH (o:Order) RETURN CASE WHEN o.total > 300000 THEN 'large' WHEN o.total > 100000 THEN 'middle' ELSE 'small' END AS size, count(*) AS n", """
    SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, count(*) AS n FROM orders GROUP BY 1
""")
P("three_valued_logic", "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS c, a OR b AS d, a XOR b AS e, NOT a AS f, a IN [true, null] AS g, a IS NULL AS h", """
    SELECT a, b, a AND b AS c, a OR b AS d, a <> b AS e, NOT a AS f, a IN (true, NULL) AS g, a IS NULL AS h FROM (VALUES (true), (false), (NULL)) x(a), (VALUES (true), (false), (NULL)) y(b)
""")
P("cast_try", "UNWIND ['42', '3.14', 'true', 'x'] AS v RETURN v, CAST(v AS INTEGER) AS i, toFloat(v) AS f, toBoolean(v) AS b", "SELECT * FROM (VALUES ('42', 42::BIGINT, 42.0::DOUBLE, NULL::BOOLEAN), ('3.14', 3, 3.14, NULL), ('true', NULL, NULL, true), ('x', NULL, NULL, NULL)) t(v, i, f, b)")
P("like_regex", "MATCH (p:Part) WHERE p.kind LIKE '%O%' AND p.brand =~ '#[1-3]' RETURN p.key AS key", "SELECT p_partkey AS key FROM part WHERE p_type LIKE '%O%' AND regexp_matches(p_brand, '#[1-3]')")
P("let_filter", "MATCH (o:Order) LET thousands = floor(o.total / 1000) FILTER thousands > 400 RETURN o.key AS key, thousands", "SELECT o_orderkey AS key, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands FROM orders WHERE floor(o_totalprice / 1000) > 400")
P("next_composition", "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.mktsegment AS segment, count(*) AS n NEXT RETURN max(n) AS most, count(*) AS segments", """
    SELECT max(n) AS most, count(*) AS segments FROM (SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
""")
P("cross_join", "MATCH (a:Region), (b:Region) WHERE a.key < b.key RETURN a.name AS a, b.name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
P("map_projection", "MATCH (n:Nation) WITH n{.key, .name, twice: n.key * 2} AS m RETURN m.key AS key, m.name AS name, m.twice AS twice", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_nationkey AS BIGINT) * 2 AS twice FROM nation")

S = lambda name, source, sql, **params: text(name, trade_graph, source, sql, **params)
#: The graph of the path queries as a common table expression: edges e(s, d).
TRADES = """
    w AS (SELECT CAST(c_nationkey AS BIGINT) AS s, CAST(s_nationkey AS BIGINT) AS d, CAST(round(sum(l_extendedprice), 0) AS BIGINT) AS weight FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    e AS (SELECT s, d, weight FROM w)
"""
S("varlen_1_3_walk", "MATCH (a:Nation)-[:TRADES*1..3]->(b:Nation) RETURN a.id AS a, count(*) AS walks", f"""
    WITH {TRADES}, p1 AS (SELECT s AS a, d AS b FROM e), p2 AS (SELECT a, d AS b FROM p1 JOIN e ON b = s), p3 AS (SELECT a, d AS b FROM p2 JOIN e ON b = s)
    SELECT a, count(*) AS walks FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY 1
""")
S("varlen_trail", "MATCH TRAIL (a:Nation)-[:TRADES]->{{2,3}}(b:Nation) RETURN a.id AS a, count(*) AS trails".replace("{{", "{").replace("}}", "}"), f"""
    WITH RECURSIVE {TRADES}, p AS (SELECT s AS a, d AS b, [s * 1000 + d] AS es FROM e UNION ALL SELECT a, d, list_append(es, s * 1000 + d) FROM p JOIN e ON b = s WHERE len(es) < 3 AND NOT list_contains(es, s * 1000 + d))
    SELECT a, count(*) AS trails FROM p WHERE len(es) >= 2 GROUP BY 1
""")
S("varlen_acyclic", "MATCH ACYCLIC (a:Nation)-[:TRADES*1..3]->(b:Nation) RETURN a.id AS a, count(DISTINCT b.id) AS reached, count(*) AS paths", f"""
    WITH RECURSIVE {TRADES}, p AS (SELECT s AS a, d AS b, [s, d] AS ns FROM e WHERE s <> d UNION ALL SELECT a, d, list_append(ns, d) FROM p JOIN e ON b = s WHERE len(ns) < 4 AND NOT list_contains(ns, d))
    SELECT a, count(DISTINCT b) AS reached, count(*) AS paths FROM p GROUP BY 1
""")
SHORTEST = f"""WITH RECURSIVE {TRADES}, p AS (SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT AS b, 0::BIGINT AS len, 1::BIGINT AS dummy FROM nation
    UNION SELECT a, d, len + 1, 1 FROM p JOIN e ON b = s WHERE len < 12), m AS (SELECT a, b, min(len) AS len FROM p GROUP BY 1, 2)"""
S("shortest_path_len", "MATCH (a:Nation {id: 0}), (b:Nation) MATCH p = shortestPath((a)-[:TRADES*]->(b)) RETURN b.id AS b, p AS len", f"{SHORTEST} SELECT b, len FROM m WHERE a = 0")
S("path_value", "MATCH p = (a:Nation {id: 3})-[:TRADES]->(b)-[:TRADES]->(c) RETURN length(p) AS n, nodes(p) AS ns", f"WITH {TRADES} SELECT 2::BIGINT AS n, [x.s, x.d, y.d] AS ns FROM e x JOIN e y ON x.d = y.s WHERE x.s = 3")
S("horizontal_agg", "MATCH p = (a:Nation {id: 3})-[e:TRADES*2..2]->(b) RETURN b.id AS b, reduce(s = 0, x IN nodes(p) | s + x) AS total", f"WITH {TRADES} SELECT y.d AS b, x.s + x.d + y.d AS total FROM e x JOIN e y ON x.d = y.s WHERE x.s = 3")
S("cyclic_triangle", "MATCH (a:Nation)-[:TRADES]->(b:Nation)-[:TRADES]->(c:Nation)-[:TRADES]->(a) RETURN count(*) AS n", f"WITH {TRADES} SELECT count(*) AS n FROM e x JOIN e y ON x.d = y.s JOIN e z ON y.d = z.s AND z.d = x.s")
text("edge_properties", trade_graph, "MATCH (a:Nation)-[t:TRADES]->(b:Nation) WHERE t.weight > 1000000 RETURN a.name AS a, b.name AS b, t.lines AS lines", """
    SELECT a.n_name AS a, b.n_name AS b, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2 HAVING round(sum(l_extendedprice), 0) > 1000000
""")
