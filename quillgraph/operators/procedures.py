"""CALL: graph algorithms and introspection by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import algorithms as A

PROCEDURES: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {
    "pagerank": (A.pagerank, ["damping", "max_iterations", "tolerance"]),
    "betweenness_centrality": (A.betweenness_centrality, ["normalized"]),
    "closeness_centrality": (A.closeness_centrality, ["wf_improved"]),
    "degree_centrality": (A.degree_centrality, ["normalized"]),
    "hits": (A.hits, ["max_iterations", "tolerance"]),
    "bfs": (A.bfs, ["start"]),
    "dfs": (A.dfs, ["start"]),
    "connected_components": (A.connected_components, []),
    "strongly_connected_components": (A.strongly_connected_components, []),
    "topological_sort": (A.topological_sort, []),
    "dijkstra": (A.dijkstra, ["source", "target", "weight"]),
    "sssp": (A.sssp, ["source", "weight"]),
    "bellman_ford": (A.bellman_ford, ["source", "weight"]),
    "floyd_warshall": (A.floyd_warshall, ["weight"]),
    "clustering_coefficient": (A.clustering_coefficient, []),
    "triangle_count": (A.triangle_count, []),
    "label_propagation": (A.label_propagation, ["max_iterations"]),
    "louvain": (A.louvain, ["resolution"]),
    "kruskal": (A.minimum_spanning_forest, ["weight"]),
    "prim": (A.minimum_spanning_forest, ["weight"]),
    "max_flow": (A.max_flow, ["source", "sink", "capacity"]),
    "min_cost_max_flow": (A.max_flow, ["source", "sink", "capacity", "cost"]),
    "articulation_points": (A.articulation_points, []),
    "bridges": (A.bridges, []),
    "kcore": (A.kcore, ["k"]),
    "subgraph.khop": (
        lambda g, center, k=1, rel_types=None, max_neighbors_per_hop=0: A.khop(g, center, k, rel_types, max_neighbors_per_hop)[0], ["center", "k", "rel_types", "max_neighbors_per_hop"],
    ),
    "leiden": (A.leiden, ["resolution"]),
    "spectral_embedding": (A.spectral_embedding, ["dimensions"]),
    "hilbert_features": (A.hilbert_features, ["levels"]),
    "similarity.topk": (A.similarity_topk, ["node", "k", "metric"]),
}


def similarity(g: PropertyGraph, node1: int, node2: int, metric: str = "jaccard") -> DataFrame:
    pair = A.neighbour_similarity(g, metric, node1).where(F.col("node2") == node2).select("score")
    return pair.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


PROCEDURES["similarity"] = (similarity, ["node1", "node2", "metric"])


def call(graph: PropertyGraph, name: str, args: list[Any]) -> DataFrame:
    """Result of a procedure. A leading namespace is dropped; arguments come by position or as one map."""
    low = name.lower()
    if low in ("db.labels", "labels"):
        return graph.labels()
    if low in ("db.relationshiptypes", "relationshiptypes"):
        return graph.relationship_types()
    if low in ("db.propertykeys", "propertykeys"):
        return graph.property_keys()
    if low.endswith("procedures"):
        return graph.spark.createDataFrame([(n, ", ".join(p)) for n, (_, p) in sorted(PROCEDURES.items())], "name string, parameters string")
    own = graph.procedures.get(low)
    if own is not None:
        names, text = own
        return graph.query(text, **dict(zip(names, args, strict=True)))
    if low in ("cognitive.metrics", "cognitive.scores"):
        return graph.spark.createDataFrame([(n,) for n in sorted(graph.scores)], "score string")
    found = next((n for n in (low, low.split(".", 1)[-1]) if n in PROCEDURES), None)
    if found is None:
        raise ValueError(f"no procedure {name}")
    f, names = PROCEDURES[found]
    given = dict(args[0]) if len(args) == 1 and isinstance(args[0], dict) else dict(zip(names, args, strict=False))
    unknown = set(given) - set(names)
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return f(graph, **given)
