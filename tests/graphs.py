"""Small literal graphs of the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.graph import PropertyGraph, node_table


def people(spark):
    """Three people who know each other in a triangle and work at two companies."""
    person = spark.createDataFrame([(1, "Ada", 30, "Oslo"), (2, "Ben", 25, "Rome"), (3, "Cleo", 35, "Oslo")], "id long, name string, age long, city string")
    firm = spark.createDataFrame([(4, "Fjord", 2010), (5, "Tiber", 2015)], "id long, name string, founded long")
    knows = spark.createDataFrame([(1, 1, 2, 2020), (2, 2, 3, 2021), (3, 1, 3, 2019)], "id long, src long, dst long, since long")
    works = spark.createDataFrame([(4, 1, 4, "builder"), (5, 2, 5, "baker"), (6, 3, 4, "clerk")], "id long, src long, dst long, role string")
    edges = {"KNOWS": knows.withColumn("type", F.lit("KNOWS")), "WORKS_AT": works.withColumn("type", F.lit("WORKS_AT"))}
    return PropertyGraph(spark, {"Person": node_table(person, "Person"), "Firm": node_table(firm, "Firm")}, edges)


def plain(spark, edges, nodes=()):
    """A graph of edges (a, b) or (a, b, weight); nodes: further ones."""
    rows = [(i, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0, float(e[3]) if len(e) > 3 else 0.0) for i, e in enumerate(edges)]
    ids = sorted({x for e in edges for x in e[:2]} | set(nodes))
    e = spark.createDataFrame(rows, "id long, src long, dst long, w double, cost double").withColumn("type", F.lit("E"))
    return PropertyGraph(spark, {"N": node_table(spark.createDataFrame([(i,) for i in ids], "id long"), "N")}, {"E": e})


def rows(df):
    return [tuple(r) for r in df.collect()]
