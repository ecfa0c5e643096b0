"""Changes to a graph, subqueries, and the other query languages, on a small literal graph."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.registry import register, unregister
from quillgraph.graph import GraphCatalog
from quillgraph.plans import gremlin, graphql
from quillgraph.plans.pgq import sql
from quillgraph.plans.sparql import SparqlProblem
from quillgraph.plans.triples import graph_store

from .graphs import people, rows

P = "PREFIX p: <prop:> PREFIX e: <edge:> PREFIX l: <label:> "


@pytest.fixture(scope="module")
def g(spark):
    return people(spark)


@pytest.mark.parametrize(("text", "want"), [
    ("MATCH (p:Person) CALL { WITH p MATCH (p)-[:KNOWS]->(q) RETURN count(q) AS n, collect(q.name) AS l, max(q.age) AS m } RETURN p.name, n, size(l), m ORDER BY p.name",
     [("Ada", 2, 2, 35), ("Ben", 1, 1, 35), ("Cleo", 0, 0, None)]),
    ("MATCH (p:Person) CALL { WITH p MATCH (p)-[:KNOWS]->(q) RETURN q.name AS q ORDER BY q DESC LIMIT 1 } RETURN p.name, q ORDER BY p.name", [("Ada", "Cleo"), ("Ben", "Cleo")]),
    ("MATCH (p:Person) OPTIONAL CALL { WITH p MATCH (p)-[:KNOWS]->(q) RETURN q.name AS q } RETURN p.name, q ORDER BY p.name, q", [("Ada", "Ben"), ("Ada", "Cleo"), ("Ben", "Cleo"), ("Cleo", None)]),
    ("MATCH (p:Person) RETURN p.name, VALUE { MATCH (p)-[:KNOWS]->(q) RETURN sum(q.age) } AS t ORDER BY p.name", [("Ada", 60), ("Ben", 35), ("Cleo", None)]),
    ("MATCH (p:Person) WHERE VALUE { MATCH (p)-[:KNOWS]->(q) RETURN count(*) } = 0 RETURN p.name", [("Cleo",)]),
    ("MATCH (a:Person)((x)-[k:KNOWS]->(y) WHERE k.since > 2018 AND y.age > 20){1,2}(b) RETURN a.name, b.name ORDER BY a.name, b.name", [("Ada", "Ben"), ("Ada", "Cleo"), ("Ada", "Cleo"), ("Ben", "Cleo")]),
    ("MATCH (a:Person {name: 'Ada'})((x)-[k:KNOWS]->(y)){0,1}(b) RETURN b.name ORDER BY b.name", [("Ada",), ("Ben",), ("Cleo",)]),
    ("MATCH (a:Person {name: 'Ben'})-[:KNOWS]->(b) | (a:Person {name: 'Ben'})-[:WORKS_AT]->(b) RETURN a.name, b.name ORDER BY b.name", [("Ben", "Cleo"), ("Ben", "Tiber")]),
    ("MATCH (a:Person) RETURN first_value(a.name, a.age) AS f, last_value(a.name, a.age) AS l", [("Ben", "Cleo")]),
    ("RETURN properties({a: 1, b: 'x'}).b AS b, duration({days: 2, hours: 1}).days AS d", [("x", 2)]),
])
def test_pattern_language(g, text, want):
    assert rows(g.query(text)) == want


@pytest.mark.parametrize(("change", "then", "want"), [
    ("CREATE (n:Person {name: 'Dan', age: 40})-[:KNOWS {since: 2024}]->(m:City:Place {name: 'Lyon'})", "MATCH (a:Person)-[k:KNOWS]->(b:Place) RETURN a.name, k.since, b.name, labels(b)", [("Dan", 2024, "Lyon", ["City", "Place"])]),
    ("MATCH (p:Person) CREATE (p)-[:HAS]->(c:Card {owner: p.name})", "MATCH (p)-[:HAS]->(c:Card) RETURN p.name, c.owner ORDER BY p.name", [("Ada", "Ada"), ("Ben", "Ben"), ("Cleo", "Cleo")]),
    ("MATCH (p:Person {city: 'Oslo'}) SET p.age = p.age + 1, p.tag = 'x', p:Local", "MATCH (p:Local) RETURN p.name, p.age, p.tag ORDER BY p.name", [("Ada", 31, "x"), ("Cleo", 36, "x")]),
    ("MATCH (p:Person {name: 'Ben'}) SET p = {name: 'B', age: 1}", "MATCH (p:Person) RETURN p.name, p.age, p.city ORDER BY p.name", [("Ada", 30, "Oslo"), ("B", 1, None), ("Cleo", 35, "Oslo")]),
    ("MATCH (:Person)-[k:KNOWS]->(b {name: 'Cleo'}) SET k.since = 1", "MATCH ()-[k:KNOWS]->() RETURN k.since ORDER BY k.since", [(1,), (1,), (2020,)]),
    ("MATCH (p:Person {name: 'Ben'}) REMOVE p.city, p:Person", "MATCH (p:Person) RETURN p.name, p.city ORDER BY p.name", [("Ada", "Oslo"), ("Cleo", "Oslo")]),
    ("MATCH (p:Person {name: 'Ben'}) DETACH DELETE p", "MATCH (p:Person)-[k]->(q) RETURN p.name, q.name ORDER BY p.name, q.name", [("Ada", "Cleo"), ("Ada", "Fjord"), ("Cleo", "Fjord")]),
    ("UNWIND ['Ben', 'Eve', 'Eve'] AS n MERGE (p:Person {name: n}) ON CREATE SET p.age = 1 ON MATCH SET p.age = 99", "MATCH (p:Person) RETURN p.name, p.age ORDER BY p.name", [("Ada", 30), ("Ben", 99), ("Cleo", 35), ("Eve", 1)]),
    ("MATCH (a:Person {name: 'Ada'}), (b:Person) WHERE b.name <> 'Ada' MERGE (a)-[k:KNOWS]->(b) MERGE (b)-[l:LIKES]->(a)", "MATCH (a)-[k:KNOWS|LIKES]->(b) RETURN type(k) AS t, count(*) AS n ORDER BY t", [("KNOWS", 3), ("LIKES", 2)]),
    ("MATCH (p:Person {name: 'Ben'}) FOREACH (x IN [1, 2] | CREATE (p)-[:OWNS]->(:Thing {no: x}))", "MATCH (p)-[:OWNS]->(t) RETURN p.name, t.no ORDER BY t.no", [("Ben", 1), ("Ben", 2)]),
])
def test_changes(g, change, then, want):
    changed = g.execute(change).graph
    assert rows(changed.query(then)) == want
    assert g.query("MATCH (n) RETURN count(*) AS n").first().n == 5  # the old graph is as it was


def test_delete_needs_detach_and_returns_rows(g):
    with pytest.raises(ValueError, match="DETACH"):
        g.execute("MATCH (p:Person {name: 'Ben'}) DELETE p")
    assert rows(g.execute("CREATE (n:Person {name: 'Dan'}) RETURN n.name AS name").rows) == [("Dan",)]
    assert g.execute("MATCH (p:Person) SET p.age = 1").rows is None


@pytest.mark.parametrize(("text", "want"), [
    ("SELECT ?n ?a WHERE { ?x a l:Person ; p:name ?n ; p:age ?a . FILTER(?a > 26) } ORDER BY ?n", [("Ada", "30"), ("Cleo", "35")]),
    ("SELECT ?n ?m WHERE { ?x a l:Person ; p:name ?n OPTIONAL { ?x e:KNOWS ?y . ?y p:name ?m FILTER(?m != 'Ben') } } ORDER BY ?n ?m", [("Ada", "Cleo"), ("Ben", "Cleo"), ("Cleo", None)]),
    ("SELECT ?n WHERE { { ?x p:age ?a } UNION { ?x p:founded ?f } ?x p:name ?n } ORDER BY ?n", [("Ada",), ("Ben",), ("Cleo",), ("Fjord",), ("Tiber",)]),
    ("SELECT ?n WHERE { ?x a l:Person ; p:name ?n MINUS { ?x e:KNOWS ?z } }", [("Cleo",)]),
    ("SELECT ?a ?b WHERE { ?x e:KNOWS+ ?y . ?x p:name ?a . ?y p:name ?b } ORDER BY ?a ?b", [("Ada", "Ben"), ("Ada", "Cleo"), ("Ben", "Cleo")]),
    ("SELECT ?b WHERE { ?x p:name 'Ben' . ?x e:KNOWS* ?y . ?y p:name ?b } ORDER BY ?b", [("Ben",), ("Cleo",)]),
    ("SELECT DISTINCT ?n WHERE { ?x p:name 'Ada' ; e:KNOWS/e:WORKS_AT/p:name ?n } ORDER BY ?n", [("Fjord",), ("Tiber",)]),
    ("SELECT ?n WHERE { ?x p:name 'Fjord' . ?x ^e:WORKS_AT/p:name ?n } ORDER BY ?n", [("Ada",), ("Cleo",)]),
    ("SELECT ?b WHERE { ?x p:name 'Ada' ; !(e:KNOWS|a|p:age|p:city|p:name) ?y . ?y p:name ?b }", [("Fjord",)]),
    ("SELECT ?c (COUNT(?x) AS ?k) (AVG(?a) AS ?m) WHERE { ?x p:city ?c ; p:age ?a } GROUP BY ?c ORDER BY DESC(?k)", [("Oslo", 2, 32.5), ("Rome", 1, 25.0)]),
    ("SELECT ?n ?d WHERE { ?x p:name ?n ; p:age ?a BIND(?a * 2 AS ?d) FILTER(CONTAINS(?n, 'e') && STRLEN(?n) > 3) }", [("Cleo", 70.0)]),
    ("SELECT ?n ?a WHERE { VALUES (?n ?a) { ('Ada' UNDEF) ('Ben' 7) } ?x p:name ?n } ORDER BY ?n", [("Ada", None), ("Ben", "7")]),
    ("SELECT ?n WHERE { { SELECT ?x WHERE { ?x p:age ?a } ORDER BY DESC(?a) LIMIT 1 } ?x p:name ?n }", [("Cleo",)]),
    ("ASK { ?x p:name 'Zed' }", [(False,)]),
    ("SELECT ?n (IF(?a > 28, 'old', 'young') AS ?k) (COALESCE(?c, 'none') AS ?d) WHERE { ?x p:name ?n ; p:age ?a OPTIONAL { ?x p:nothing ?c } } ORDER BY ?n", [("Ada", "old", "none"), ("Ben", "young", "none"), ("Cleo", "old", "none")]),
    ("SELECT (MIN(?a) AS ?lo) (MAX(?a) AS ?hi) (GROUP_CONCAT(?n; SEPARATOR='|') AS ?all) WHERE { ?x p:age ?a ; p:name ?n }", [("25", "35", "Ada|Ben|Cleo")]),
    ("SELECT (STRBEFORE(?n, 'd') AS ?a) (DATATYPE(?g) AS ?d) WHERE { ?x p:name ?n ; p:age ?g FILTER(REGEX(?n, '^ad', 'i')) }", [("A", "http://www.w3.org/2001/XMLSchema#integer")]),
])
def test_sparql(g, text, want):
    assert rows(g.sparql(P + text)) == want


def test_sparql_updates_and_graphs(g):
    store = graph_store(g).update(P + "INSERT DATA { <ex:a> p:name 'Zed' . GRAPH <ex:g> { <ex:b> p:name 'Inside' } } ; DELETE { ?x p:age ?a } INSERT { ?x p:age 1 } WHERE { ?x p:name 'Ben' ; p:age ?a } ; MOVE <ex:g> TO <ex:h>")
    assert rows(store.query(P + "SELECT ?n WHERE { ?x p:name ?n ; p:age 1 }")) == [("Ben",)]
    assert rows(store.query(P + "SELECT ?g ?n WHERE { GRAPH ?g { ?x p:name ?n } }")) == [("ex:h", "Inside")]
    assert rows(store.update("CLEAR GRAPH <ex:h>").query(P + "ASK { GRAPH ?g { ?x p:name ?n } }")) == [(False,)]
    assert rows(store.query(P + "CONSTRUCT { ?x <ex:is> ?n } WHERE { ?x p:name ?n FILTER(?n = 'Zed') }")) == [("ex:a", "ex:is", "Zed", "literal", None, None)]
    with pytest.raises(SparqlProblem):
        store.query("SELECT ?x WHERE { SERVICE <http://x> { ?x ?p ?o } }")


@pytest.mark.parametrize(("text", "want"), [
    ("g.V().hasLabel('Person').has('age', gt(26)).out('KNOWS').values('name')", [("Ben",), ("Cleo",)]),
    ("g.V().hasLabel('Person').groupCount().by('city')", [("Oslo", 2), ("Rome", 1)]),
    ("g.V().hasLabel('Person').where(__.out('KNOWS')).values('name')", [("Ada",), ("Ben",)]),
    ("g.V().has('Person','name','Ada').as('a').out('KNOWS').as('b').select('a','b').by('name')", [("Ada", "Ben"), ("Ada", "Cleo")]),
    ("g.V().hasLabel('Person').project('n','k').by('name').by(__.out('KNOWS').count())", [("Ada", 2), ("Ben", 1), ("Cleo", 0)]),
    ("g.E().hasLabel('KNOWS').has('since', gte(2020)).inV().values('name')", [("Ben",), ("Cleo",)]),
    ("g.V().hasLabel('Person').union(__.out('KNOWS'), __.out('WORKS_AT')).count()", [(6,)]),
    ("g.V().hasLabel('Person').coalesce(__.out('KNOWS').values('name'), __.constant('none'))", [("Ben",), ("Cleo",), ("Cleo",), ("none",)]),
    ("g.V().hasLabel('Person').group().by('city').by(__.values('age').sum())", [("Oslo", 65), ("Rome", 25)]),
    ("g.V().hasLabel('Person').values('age').fold()", [([25, 30, 35],)]),
])
def test_gremlin(g, text, want):
    assert sorted(rows(g.gremlin(text))) == want


def test_gremlin_and_graphql_changes(g):
    assert rows(gremlin.mutate(g, "g.V().has('name', 'Ben').property('age', 7)").query("MATCH (p:Person {age: 7}) RETURN p.name")) == [("Ben",)]
    assert rows(gremlin.mutate(g, "g.addE('LIKES').from(1).to(2).property('w', 3)").query("MATCH (p)-[l:LIKES]->(q) RETURN p.name, q.name, l.w")) == [("Ada", "Ben", 3)]
    assert gremlin.mutate(g, "g.V().has('name', 'Ada').drop()").query("MATCH ()-[k]->() RETURN count(*) AS n").first().n == 3
    changed = graphql.mutate(g, 'mutation { createPerson(name: "Zoe", age: 3) { id } updatePerson(id: 1, age: 31) { id } deletePerson(id: 2) { id } }')
    assert rows(changed.query("MATCH (p:Person) RETURN p.name, p.age ORDER BY p.name")) == [("Ada", 31), ("Cleo", 35), ("Zoe", 3)]


def test_graphql(g):
    got = g.graphql("{ person(age_gt: 26, orderBy: {age: DESC}) { name KNOWS { name } works_at { founded } } }").collect()
    assert [(r.name, [x.name for x in r.KNOWS], [x.founded for x in r.works_at]) for r in got] == [("Cleo", [], [2010]), ("Ada", ["Ben", "Cleo"], [2010])]
    assert rows(g.graphql("query Q($n: String) { a: person(name: $n) { ...F } firm(first: 1, orderBy: name) { name } } fragment F on Person { name }", {"n": "Ben"})) == [("a", '{"name":"Ben"}'), ("firm", '{"name":"Fjord"}')]
    with pytest.raises(graphql.GraphqlProblem):
        g.graphql("{ nobody { name } }")


def test_pgq(spark, g):
    assert rows(g.sql("SELECT a, count(*) AS n FROM GRAPH_TABLE (MATCH (a:Person)-[k:KNOWS]->(b:Person) WHERE k.since > $y COLUMNS (a.name AS a, b.name)) GROUP BY a ORDER BY a", y=2019)) == [("Ada", 1), ("Ben", 1)]
    g.nodes["Person"].select("id", "name").createOrReplaceTempView("person_rows")
    g.edges["KNOWS"].select("id", F.col("src").alias("a"), F.col("dst").alias("b"), "since").createOrReplaceTempView("knows_rows")
    catalog = GraphCatalog(spark)
    sql(catalog, "CREATE PROPERTY GRAPH Own NODE TABLES (person_rows (id BIGINT PRIMARY KEY, name VARCHAR(9))) EDGE TABLES (knows_rows (id BIGINT PRIMARY KEY, a BIGINT REFERENCES person_rows(id), b BIGINT REFERENCES person_rows(id), since INT))")
    assert rows(sql(catalog, "SELECT * FROM GRAPH_TABLE (Own MATCH (x:person_rows)-[k:knows_rows]->(y) COLUMNS (x.name AS x, k.since)) ORDER BY since")) == [("Ada", 2019), ("Ada", 2020), ("Ben", 2021)]


def test_explain_profile_scores_procedures_and_functions(spark, g):
    assert "Project" in " ".join(r.plan for r in g.query("EXPLAIN MATCH (a:Person) RETURN a.name").collect())
    assert g.query("PROFILE MATCH (a:Person) RETURN count(*) AS n").where("rows = 1").count() > 0
    scored = g.with_score("energy", spark.createDataFrame([(1, 0.5)], "node long, energy double"))
    assert rows(scored.query("MATCH (p:Person) RETURN p.name, energy(p) AS e ORDER BY p.name")) == [("Ada", 0.5), ("Ben", None), ("Cleo", None)]
    assert rows(g.with_procedure("older", ["n"], "MATCH (p:Person) WHERE p.age > $n RETURN p.name AS name").query("CALL older(32) YIELD name RETURN name")) == [("Cleo",)]
    register("shout", lambda c: F.upper(c))
    assert rows(g.query("MATCH (p:Person {id: 1}) RETURN shout(p.name) AS s")) == [("ADA",)]
    unregister("shout")


def test_files(spark, g, tmp_path):
    g.save(str(tmp_path / "snap"))
    again = type(g).load(spark, str(tmp_path / "snap"), ["Person", "Firm"], ["KNOWS", "WORKS_AT"])
    g.dump_json(str(tmp_path / "json"))
    lines = type(g).load_json(spark, str(tmp_path / "json"), ["Person", "Firm"], ["KNOWS", "WORKS_AT"])
    for x in (again, lines):
        assert rows(x.query("MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name ORDER BY a.name, b.name")) == [("Ada", "Ben"), ("Ada", "Cleo"), ("Ben", "Cleo")]
    (tmp_path / "a.csv").write_text("name,score\nAda,1\n\nBen,\n")
    assert rows(g.query("LOAD CSV WITH HEADERS FROM $f AS row RETURN row.name AS n, row.score AS s ORDER BY n", f=str(tmp_path / "a.csv"))) == [("Ada", "1"), ("Ben", None)]
    (tmp_path / "a.nt").write_text('<ex:a> <ex:p> "x"@en .\n# no\n<ex:a> <ex:q> <ex:b> .\n')
    from quillgraph.plans.sparql import TripleStore
    from quillgraph.sources.files import load_ntriples

    store = TripleStore(spark, load_ntriples(spark, str(tmp_path / "a.nt")))
    assert rows(store.query("SELECT ?o (LANG(?o) AS ?l) WHERE { <ex:a> <ex:p> ?o }")) == [("x", "en")]
    assert g.with_pandas("Pet", g.nodes_df("Firm")[["id", "name"]].assign(id=[8, 9])).query("MATCH (p:Pet) RETURN count(*) AS n").first().n == 2
