"""Property graphs as DataFrames: one table for each node label and for each edge type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_KEYS, EDGE_KEYS = ("id", "labels"), ("id", "src", "dst", "type")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Union by name; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def node_table(df: DataFrame, label: str, key: str | Column = "id", offset: int = 0, /, **props: str | Column) -> DataFrame:
    """id, labels and properties of a table; without props all other columns are properties."""
    key_column = F.col(key) if isinstance(key, str) else key
    named = props or {c: c for c in df.columns if c not in (key, "id", "labels")}
    return df.select(
        (key_column.cast("long") + F.lit(offset)).alias("id"),
        F.array(F.lit(label)).alias("labels") if "labels" not in df.columns else F.col("labels"),
        *[(F.col(c) if isinstance(c, str) else c).alias(p) for p, c in named.items()],
    )


def edge_table(df: DataFrame, type_: str, src: Column, dst: Column, id_: Column | None = None, **props: str | Column) -> DataFrame:
    """id, src, dst, type and properties. Without an id column the id is a hash of the ends and properties: parallel edges
    that agree in everything share it."""
    named = {p: (F.col(c) if isinstance(c, str) else c) for p, c in props.items()}
    return df.select(
        (id_.cast("long") if id_ is not None else F.xxhash64(src, dst, F.lit(type_), *named.values())).alias("id"),
        src.cast("long").alias("src"),
        dst.cast("long").alias("dst"),
        F.lit(type_).alias("type"),
        *[c.alias(p) for p, c in named.items()],
    )


@dataclass
class PropertyGraph:
    """Nodes by label and edges by type. Tables are lazy; every change makes a new graph.

    ends: for an edge type the labels of its source and target, if all its edges are known to lie between them.
    """

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    name: str = "default"
    #: Tables (node, value) of scores that queries may ask for by a function of the same name: energy(n), risk(n).
    scores: dict[str, DataFrame] = field(default_factory=dict)
    #: Stored procedures: lower-cased name -> (names of parameters, query text).
    procedures: dict[str, tuple[list[str], str]] = field(default_factory=dict)

    # -- scans
    def node_scan(self, labels: tuple | None = None) -> DataFrame:
        """Nodes that satisfy a label expression; tables that can't are not read."""
        frames = [df for label, df in self.nodes.items() if labels is None or self._possible(labels, label)]
        if not frames:
            return self.spark.createDataFrame([], "id long, labels array<string>")
        out = stacked(frames)
        return out if labels is None or self._certain(labels) else out.where(label_test(F.col("labels"), labels))

    def _possible(self, e: tuple, label: str) -> bool:
        # Nodes with several labels stand in the table of their first one, so only a graph of single labels prunes.
        if label in self.mixed_labels:
            return True
        return bool(_holds(e, {label}))

    def _certain(self, e: tuple) -> bool:
        return not self.mixed_labels and e[0] in ("label", "any", "or")

    @property
    def mixed_labels(self) -> set[str]:
        return getattr(self, "_mixed", set())

    def edge_scan(self, types: list[str] | None = None) -> DataFrame:
        """Edges of the given types, all if none are given; types are compared without case."""
        wanted = {t.lower() for t in types or []}
        frames = [df for t, df in self.edges.items() if not wanted or t.lower() in wanted]
        if not frames:
            return self.spark.createDataFrame([], "id long, src long, dst long, type string")
        return stacked(frames)

    def simple_edges(self, types: list[str] | None = None) -> DataFrame:
        """Undirected edges without loops and repeats: (a, b) with a < b."""
        e = self.edge_scan(types)
        return e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    # -- projections
    def project(self, labels: list[str] | None = None, types: list[str] | None = None, where: Callable[[str], str | None] | None = None) -> PropertyGraph:
        """The part with these labels and types; edges that lose an end go."""
        nodes = {n: df for n, df in self.nodes.items() if labels is None or n in labels}
        if where:
            nodes = {n: df.where(cond) if (cond := where(n)) else df for n, df in nodes.items()}
        kept = stacked([df.select("id") for df in nodes.values()])
        edges = {}
        for t, df in self.edges.items():
            if types is None or t in types:
                near = df.join(kept.withColumnRenamed("id", "src"), "src", "left_semi")
                edges[t] = near.join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*df.columns)
        return PropertyGraph(self.spark, nodes, edges, {t: e for t, e in self.ends.items() if t in edges})

    def with_tables(self, nodes: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None) -> PropertyGraph:
        out = replace(self, nodes=nodes if nodes is not None else dict(self.nodes), edges=edges if edges is not None else dict(self.edges))
        if self.mixed_labels:
            out._mixed = set(self.mixed_labels)
        return out

    # -- catalog
    def labels(self) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in sorted(self.nodes)], "label string")

    def relationship_types(self) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in sorted(self.edges)], "relationshipType string")

    def property_keys(self) -> DataFrame:
        keys = {c for df in self.nodes.values() for c in df.columns if c not in NODE_KEYS}
        keys |= {c for df in self.edges.values() for c in df.columns if c not in EDGE_KEYS}
        return self.spark.createDataFrame([(x,) for x in sorted(keys)], "propertyKey string")

    # -- storage
    def save(self, path: str) -> None:
        """A Parquet folder for each label and type."""
        for kind, tables in (("nodes", self.nodes), ("edges", self.edges)):
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, labels: list[str], types: list[str]) -> PropertyGraph:
        return PropertyGraph(
            spark, {x: spark.read.parquet(f"{path}/nodes/{x}") for x in labels}, {x: spark.read.parquet(f"{path}/edges/{x}") for x in types}
        )

    def dump_json(self, path: str) -> None:
        """JSON lines for each label and type."""
        for kind, tables in (("nodes", self.nodes), ("edges", self.edges)):
            for name, df in tables.items():
                df.write.mode("overwrite").json(f"{path}/{kind}/{name}")

    @staticmethod
    def load_json(spark: SparkSession, path: str, labels: list[str], types: list[str]) -> PropertyGraph:
        """A graph of dump_json. Numbers come back as long or double; what was null everywhere is gone."""
        return PropertyGraph(spark, {x: spark.read.json(f"{path}/nodes/{x}") for x in labels}, {x: spark.read.json(f"{path}/edges/{x}") for x in types})

    # -- other libraries
    def nodes_df(self, label: str) -> object:
        """The nodes of a label as a pandas DataFrame: all of them come to the driver."""
        return self.nodes[label].toPandas()

    def edges_df(self, type_: str) -> object:
        return self.edges[type_].toPandas()

    def with_pandas(self, label: str, frame: object, key: str = "id") -> PropertyGraph:
        """The graph with a table of nodes from a pandas or polars DataFrame; `key` becomes the id."""
        data = frame.to_pandas() if hasattr(frame, "to_pandas") else frame
        return self.with_tables({**self.nodes, label: node_table(self.spark.createDataFrame(data), label, key)})

    def to_networkx(self, most: int = 1_000_000) -> object:
        """A networkx MultiDiGraph; all nodes and edges come to the driver, so at most so many."""
        import networkx

        out = networkx.MultiDiGraph()
        for label, df in self.nodes.items():
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} nodes of {label}")
            out.add_nodes_from((r.id, {"labels": r.labels, **{k: v for k, v in r.asDict().items() if k not in NODE_KEYS}}) for r in rows)
        for type_, df in self.edges.items():
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} edges of {type_}")
            out.add_edges_from((r.src, r.dst, r.id, {"type": r.type, **{k: v for k, v in r.asDict().items() if k not in EDGE_KEYS}}) for r in rows)
        return out

    @staticmethod
    def from_networkx(spark: SparkSession, source: object, label: str = "Node", type_: str = "EDGE") -> PropertyGraph:
        """A graph of a networkx graph with integer nodes; attributes become properties."""
        import pandas as pd

        nodes = pd.DataFrame([{"id": n, **{k: v for k, v in d.items() if k != "labels"}} for n, d in source.nodes(data=True)])
        edges = pd.DataFrame([{"id": i, "src": a, "dst": b, **{k: v for k, v in d.items() if k != "type"}} for i, (a, b, d) in enumerate(source.edges(data=True))])
        e = spark.createDataFrame(edges) if len(edges) else spark.createDataFrame([], "id long, src long, dst long")
        return PropertyGraph(spark, {label: node_table(spark.createDataFrame(nodes), label)}, {type_: e.withColumn("type", F.lit(type_))})

    # -- scores and procedures
    def with_score(self, name: str, table: DataFrame) -> PropertyGraph:
        """The graph with a score: a table (node, value); a function of that name joins it by id."""
        return replace(self, scores={**self.scores, name.lower(): table})

    def with_procedure(self, name: str, parameters: list[str], text: str) -> PropertyGraph:
        """The graph with a stored query that CALL name(values) runs."""
        return replace(self, procedures={**self.procedures, name.lower(): (parameters, text)})

    def sparql(self, text: str) -> DataFrame:
        """Rows of a SPARQL query over the graph's triples (see plans.triples)."""
        from .plans.triples import graph_store

        return graph_store(self).query(text)

    def gremlin(self, text: str) -> DataFrame:
        from .plans.gremlin import query

        return query(self, text)

    def graphql(self, text: str, variables: dict | None = None) -> DataFrame:
        from .plans.graphql import query

        return query(self, text, variables)

    def sql(self, text: str, **params: object) -> DataFrame:
        from .plans.pgq import sql

        return sql(self, text, **params)

    def query(self, text: str, **params: object) -> DataFrame:
        from .plans.builder import run

        return run(self, text, params)

    def execute(self, text: str, **params: object) -> object:
        """Outcome (graph, rows) of a statement that changes the graph."""
        from .operators.mutation import execute

        return execute(self, text, **params)


def _holds(e: tuple, labels: set[str]) -> bool:
    match e:
        case ("label", name):
            return name in labels
        case ("any",):
            return bool(labels)
        case ("not", inner):
            return not _holds(inner, labels)
        case ("and", a, b):
            return _holds(a, labels) and _holds(b, labels)
        case ("or", a, b):
            return _holds(a, labels) or _holds(b, labels)
    raise ValueError(f"not a label expression: {e}")


def label_test(labels: Column, e: tuple) -> Column:
    match e:
        case ("label", name):
            return F.array_contains(labels, name)
        case ("any",):
            return F.size(labels) > 0
        case ("not", inner):
            return ~label_test(labels, inner)
        case ("and", a, b):
            return label_test(labels, a) & label_test(labels, b)
        case ("or", a, b):
            return label_test(labels, a) | label_test(labels, b)
    raise ValueError(f"not a label expression: {e}")


class GraphCatalog:
    """Named graphs, projections and constraints of a session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.graphs, self.current = spark, {}, None
        self.constraints: list[tuple[str, str, str, object]] = []

    def create(self, name: str, graph: PropertyGraph, replace_: bool = False) -> PropertyGraph:
        if name in self.graphs and not replace_:
            raise ValueError(f"graph {name} exists")
        self.graphs[name] = graph
        self.current = self.current or name
        return graph

    def use(self, name: str) -> PropertyGraph:
        self.current = name if name in self.graphs else self._missing(name)
        return self.graphs[name]

    def drop(self, name: str) -> None:
        self.graphs.pop(name, None) or self._missing(name)
        self.current = None if self.current == name else self.current

    def _missing(self, name: str) -> str:
        raise KeyError(f"no graph {name}")

    def show(self) -> DataFrame:
        return self.spark.createDataFrame([(n, n == self.current) for n in sorted(self.graphs)], "graph string, current boolean")

    def add_constraint(self, kind: str, label: str, *args: object) -> None:
        """kind: unique or key (properties), not_null (property), check (SQL condition)."""
        self.constraints.append((kind, label, f"{kind}:{label}:{','.join(map(str, args))}", args))

    def violations(self, graph: PropertyGraph) -> DataFrame:
        """(constraint, violations) of all constraints."""
        out = []
        for kind, label, name, args in self.constraints:
            df = graph.nodes[label] if label in graph.nodes else graph.edges[label]
            if kind in ("unique", "key"):
                bad = df.groupBy(*args).count().where("count > 1")
                if kind == "unique":
                    bad = bad.dropna(subset=list(args))
                counted = bad.select(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
                if kind == "key":
                    nulls = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in args]))
                    counted = counted.unionByName(nulls.select(F.count("*").alias("violations"))).select(F.sum("violations").alias("violations"))
            elif kind == "not_null":
                counted = df.where(F.col(args[0]).isNull()).select(F.count("*").alias("violations"))
            else:
                counted = df.where(f"NOT ({args[0]})").select(F.count("*").alias("violations"))
            out.append(counted.select(F.lit(name).alias("constraint"), F.col("violations").cast("long").alias("violations")))
        return stacked(out)
