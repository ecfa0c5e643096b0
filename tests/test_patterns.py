"""Pattern queries and algorithms on a small literal graph."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.graph import GraphCatalog, PropertyGraph, node_table
from quillgraph.operators import algorithms as A
from quillgraph.plans.parser import SyntaxProblem, parse
from quillgraph.queries.registry import ORACLES, QUERIES
from quillgraph.sources.tables import trade_graph


@pytest.fixture(scope="module")
def social(spark):
    person = spark.createDataFrame([(1, "Alix", 30, "NYC"), (2, "Gus", 25, "LA"), (3, "Vincent", 35, "NYC")], "id long, name string, age long, city string")
    company = spark.createDataFrame([(4, "Acme Corp", 2010), (5, "Globex Inc", 2015)], "id long, name string, founded long")
    knows = spark.createDataFrame([(1, 1, 2, 2020), (2, 2, 3, 2021), (3, 1, 3, 2019)], "id long, src long, dst long, since long")
    works = spark.createDataFrame([(4, 1, 4, "Engineer"), (5, 2, 5, "Manager"), (6, 3, 4, "Director")], "id long, src long, dst long, role string")
    edges = {"KNOWS": knows.withColumn("type", F.lit("KNOWS")), "WORKS_AT": works.withColumn("type", F.lit("WORKS_AT"))}
    return PropertyGraph(spark, {"Person": node_table(person, "Person"), "Company": node_table(company, "Company")}, edges)


def rows(df):
    return [tuple(r) for r in df.collect()]


CASES = [
    ("MATCH (a:Person)-[k:KNOWS]->(b) WHERE a.age > 26 RETURN a.name, b.name ORDER BY k.since", [("Alix", "Vincent"), ("Alix", "Gus")]),
    ("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b {name: 'Gus'}) RETURN a.name, b.name ORDER BY a.name", [("Alix", "Gus"), ("Gus", None), ("Vincent", None)]),
    ("MATCH (a)-[:WORKS_AT]->(c) WITH c, count(*) AS n WHERE n > 1 MATCH (c)<-[:WORKS_AT]-(p) RETURN p.name, n ORDER BY p.name", [("Alix", 2), ("Vincent", 2)]),
    ("MATCH p = (a {name: 'Alix'})-[:KNOWS*1..2]->(b) RETURN b.name, length(p), nodes(p) ORDER BY length(p), b.name", [("Gus", 1, [1, 2]), ("Vincent", 1, [1, 3]), ("Vincent", 2, [1, 2, 3])]),
    ("MATCH (a:Person) WHERE NOT (a)-[:KNOWS]->() RETURN a.name", [("Vincent",)]),
    ("MATCH (a:Person) RETURN a.name, COUNT { (a)-[:KNOWS]-(b) WHERE b.age > 30 } AS n ORDER BY a.name", [("Alix", 1), ("Gus", 1), ("Vincent", 0)]),
    ("UNWIND [3, 1, null] AS x RETURN x, x / 2 AS h ORDER BY x DESC", [(None, None), (3, 1), (1, 0)]),
    ("MATCH (a:Person {name: 'Alix'})-[:KNOWS*0..1]->(b) RETURN count(*) AS n", [(3,)]),
    ("MATCH (a:Person) RETURN a.missing = 1 OR true AS t LIMIT 1", [(True,)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_query(social, text, want):
    assert rows(social.query(text)) == want


COUNTED = [
    # two and one work at 4 and 5, so 2 * 2 and 1 * 1 pairs
    ("MATCH (a:Person)-[:WORKS_AT]->(c:Company), (b:Person)-[:WORKS_AT]->(c) RETURN c.name, count(*) AS n ORDER BY n DESC", [("Acme Corp", 4), ("Globex Inc", 1)]),
    ("MATCH (a)-[:WORKS_AT]->(c:Company), (b)-[:WORKS_AT]->(c), (c)<-[:WORKS_AT]-(d {city: 'NYC'})-[:KNOWS]->() WITH c, count(*) AS n RETURN c.name, n", [("Acme Corp", 8)]),
    ("MATCH (a:Person)-[:WORKS_AT]->(c) MATCH (b)-[:WORKS_AT]->(c) WHERE a.age > 30 RETURN a.name, count(*) AS n, count(*) + 1 AS more", [("Vincent", 2, 3)]),
    ("MATCH (a:Person)-[:WORKS_AT]->(c), (b)-[:KNOWS]->(c) RETURN count(*) AS n", [(0,)]),
    ("MATCH (a:Person)-[:WORKS_AT]->(c), (b:Person)-[:WORKS_AT]->(c:Nothing) RETURN count(*) AS n", [(0,)]),
]
NOT_COUNTED = [
    ("MATCH (a:Person)-[:WORKS_AT]->(c), (b)-[:WORKS_AT]->(c) WHERE a.age < b.age RETURN count(*) AS n", [(1,)]),
    ("MATCH (a:Person)-[:WORKS_AT]->(c:Company), (b)-[:WORKS_AT]->(c) RETURN c.name, count(*) AS n, max(b.age) AS m ORDER BY n", [("Globex Inc", 1, 25), ("Acme Corp", 4, 35)]),
    ("MATCH (a:Person)-[:WORKS_AT]->(c), (a)-[:KNOWS]->(b)-[:WORKS_AT]->(c) RETURN count(*) AS n", [(1,)]),
]


@pytest.mark.parametrize("text,want,fewer", [(*c, True) for c in COUNTED] + [(*c, False) for c in NOT_COUNTED])
def test_paths_that_are_only_counted_make_no_pairs(social, text, want, fewer):
    out = social.query(text)
    assert rows(out) == want
    assert ("_times" in out._jdf.queryExecution().analyzed().toString()) == fewer


def test_algorithms(social):
    assert A.triangle_count(social).first()[0] == 2
    assert {r.node_id: r.component_id for r in A.connected_components(social).collect()} == dict.fromkeys(range(1, 6), 1)
    assert abs(sum(r.score for r in A.pagerank(social, max_iterations=8).collect()) - 1) < 1e-9


def test_syntax_and_constraints(spark, social):
    for bad in ("MATCH (a RETURN a", "RETURN 1 +", "MATCH (a) RETURN b.x"):
        with pytest.raises(SyntaxProblem):
            parse(bad) if "b.x" not in bad else social.query(bad)
    catalog = GraphCatalog(spark)
    catalog.add_constraint("unique", "Person", "city")
    catalog.add_constraint("not_null", "Person", "age")
    assert [r.violations for r in catalog.violations(social).collect()] == [2, 0]


def test_louvain_covers_nodes_beyond_the_edge_limit(spark, monkeypatch):
    monkeypatch.setattr(A, "SEQUENTIAL_EDGES", 3)
    node = node_table(spark.range(1, 9), "N")
    e = spark.createDataFrame([(1, 6, 7), (2, 7, 8)], "id long, src long, dst long").withColumn("type", F.lit("E"))
    got = {r.node_id: r.community_id for r in A.louvain(PropertyGraph(spark, {"N": node}, {"E": e})).collect()}
    assert got == {i: i for i in range(1, 6)} | dict.fromkeys((6, 7, 8), 6)


def test_max_flow_runs_on_all_trades(spark):
    from quillgraph.queries import analytics  # noqa: F401  it registers the queries

    sf_dir = "/root/testdata/sf0.01"
    e = {(r.src, r.dst): r.weight for r in trade_graph(spark, sf_dir).edges["TRADES"].collect() if r.src != r.dst}
    room, flow = {k: float(w) for k, w in e.items()}, 0.0
    while True:
        by, queue = {0: None}, [0]
        for x in queue:
            for y in range(25):
                if y not in by and room.get((x, y), 0) > 0:
                    by[y] = x
                    queue.append(y)
        if 1 not in by:
            break
        path, y = [], 1
        while by[y] is not None:
            path.append((by[y], y))
            y = by[y]
        add = min(room[k] for k in path)
        for a, b in path:
            room[a, b] -= add
            room[b, a] = room.get((b, a), 0.0) + add
        flow += add
    assert "max_flow" not in ORACLES and QUERIES["max_flow"](spark, sf_dir).first().max_flow == flow


def test_hits_and_label_propagation_run_to_the_end(spark, monkeypatch):
    from quillgraph.queries import analytics  # noqa: F401  it registers the queries

    asked = []
    result = spark.range(1).selectExpr("id AS node_id", "0.0D AS hub", "0.0D AS authority")
    for name in ("hits", "label_propagation"):
        monkeypatch.setattr(A, name, lambda g, *args, **named: asked.append((args, named)) or result)
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [((), {})] * 2
