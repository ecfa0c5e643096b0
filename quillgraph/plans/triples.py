"""A property graph as triples.

A node's IRI is node:<id>; its labels are rdf:type label:<label>; a property is prop:<name>; an edge edge:<type> leads from node to node. Values are literals of their type;
those that aren't texts, numbers, truths or times are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import EDGE_KEYS, NODE_KEYS, PropertyGraph
from .sparql import RDF_TYPE, XSD, TripleStore

KINDS = {"string": "literal", "bigint": XSD + "integer", "int": XSD + "integer", "double": XSD + "double", "float": XSD + "double", "boolean": XSD + "boolean", "date": XSD + "date",
         "timestamp": XSD + "dateTime", "timestamp_ntz": XSD + "dateTime"}


def iri(id_: Column) -> Column:
    return F.concat(F.lit("node:"), id_.cast("string"))


def triples(g: PropertyGraph) -> DataFrame:
    """(s, p, o, o_type, o_lang, g). A scan of one predicate prunes all branches but its own, as the predicate of a branch is a constant."""
    none = F.lit(None).cast("string")
    frames = []

    def add(df: DataFrame, s: Column, p: str, o: Column, kind: str) -> None:
        frames.append(df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_type"), none.alias("o_lang"), none.alias("g")).where("o IS NOT NULL"))

    for df in g.nodes.values():
        add(df.select("id", F.explode("labels").alias("label")), iri(F.col("id")), RDF_TYPE, F.concat(F.lit("label:"), F.col("label")), "iri")
        for c in df.columns:
            kind = KINDS.get(df.schema[c].dataType.simpleString())
            if c not in NODE_KEYS and kind:
                value = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.endswith("dateTime") else F.col(f"`{c}`").cast("string")
                add(df, iri(F.col("id")), f"prop:{c}", value, kind)
    for type_, df in g.edges.items():
        add(df.select(*EDGE_KEYS), iri(F.col("src")), f"edge:{type_}", iri(F.col("dst")), "iri")
    return reduce(lambda a, b: a.unionByName(b), frames)


def graph_store(g: PropertyGraph) -> TripleStore:
    """Edges that run twice between two nodes are one triple, as a graph of triples is a set."""
    return TripleStore(g.spark, triples(g))
