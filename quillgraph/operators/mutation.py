"""Statements that change a graph. Tables are immutable, so a change gives a new graph and leaves the old one as it was.

The rows of a statement are computed once for each writing clause (a checkpoint), so that new ids don't change when a table is read again.
Only tables in which a variable can lie, by the labels it was matched with, are joined with its changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import EDGE_KEYS, NODE_KEYS, PropertyGraph, stacked
from ..plans.builder import Bound, Builder, State, used_labels
from ..plans.parser import EdgePattern, NodePattern, PathPattern, Query, SyntaxProblem, parse
from .iterate import Rounds

WRITES = ("create", "merge", "set", "remove", "delete", "foreach")
#: Table of nodes that have no label.
NO_LABEL = "_"


@dataclass
class Outcome:
    """The changed graph, and the rows that the statement returns (None without RETURN)."""

    graph: PropertyGraph
    rows: DataFrame | None


def execute(graph: PropertyGraph, text: str, **params: Any) -> Outcome:
    """Run a statement with CREATE/INSERT, MERGE, SET, REMOVE, [DETACH] DELETE or FOREACH; NEXT chains statements."""
    tree, writer = parse(text), Writer(graph, params)
    rows = writer.statement(tree)
    return Outcome(writer.graph, rows)


class Writer:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any]):
        self.graph, self.params, self.rounds = graph, params, Rounds(graph.spark)
        self.labels: dict[str, Any] = {}  # label expression that a variable was matched with

    def statement(self, tree: Any) -> DataFrame | None:
        if isinstance(tree, Query):
            return self.clauses(tree, State(None))
        op, _, left, right = tree
        if op != "next":
            raise SyntaxProblem(f"{op} can't combine statements that change the graph")
        rows = self.statement(left)
        state = State(None) if rows is None else State(rows, {c: Bound("value") for c in rows.columns})
        return self.clauses(right, state)

    def clauses(self, q: Query, state: State) -> DataFrame | None:
        builder = Builder(self.graph, self.params)
        builder.needed = builder._needed(q)
        returned = False
        for clause in q.clauses:
            builder.graph = self.graph
            if clause[0] in WRITES:
                state = getattr(self, "do_" + clause[0])(builder, state, *clause[1:])
            else:
                if clause[0] == "match":
                    self.learn(clause[2])
                state = builder.query(Query([clause]), state)
                returned = clause[0] == "project" and clause[1]
        return state.df if returned else None

    # -- helpers
    def learn(self, patterns: list[PathPattern]) -> None:
        for p in patterns:
            for x in p.items[::2]:
                if isinstance(x, NodePattern) and x.labels is not None:
                    self.labels.setdefault(x.var, x.labels)
            for x in p.items[1::2]:
                if isinstance(x, EdgePattern) and x.types:
                    self.labels.setdefault(x.var, tuple(x.types))

    def unit(self, state: State) -> State:
        return state if state.df is not None else State(self.graph.spark.range(1).select(F.lit(1).alias("_unit")), state.vars)

    def next_id(self) -> int:
        frames = [df.select("id") for df in self.graph.nodes.values()]
        return (stacked(frames).agg(F.max("id")).first()[0] if frames else 0) or 0

    def tables(self, var: str, kind: str) -> list[str]:
        """Names of the tables in which a variable can lie."""
        if kind == "edge":
            types = {t.lower() for t in self.labels.get(var, ())}
            return [t for t in self.graph.edges if not types or t.lower() in types]
        labels = self.labels.get(var)
        return [n for n in self.graph.nodes if labels is None or self.graph._possible(labels, n)]

    def replaced(self, kind: str, changed: dict[str, DataFrame], mixed: set[str] = frozenset()) -> None:
        tables = {**(self.graph.nodes if kind == "node" else self.graph.edges), **changed}
        out = self.graph.with_tables(nodes=tables) if kind == "node" else self.graph.with_tables(edges=tables)
        if mixed or self.graph.mixed_labels:
            out._mixed = set(self.graph.mixed_labels) | set(mixed)
        if kind == "edge":
            out.ends = {t: e for t, e in out.ends.items() if t not in changed}
        self.graph = out

    def ids(self, state: State, var: str) -> DataFrame:
        return state.df.select(F.col(f"`{state.vars[var].props['id']}`").alias("id")).where("id IS NOT NULL").distinct()

    # -- CREATE
    def do_create(self, builder: Builder, state: State, patterns: list[PathPattern]) -> State:
        state = self.unit(state)
        nodes: list[NodePattern] = []
        edges: list[tuple[NodePattern, EdgePattern, NodePattern]] = []
        for p in patterns:
            for x in p.items[::2]:
                if x.var not in state.vars and x.var not in [n.var for n in nodes]:
                    nodes.append(x)
            edges += [(p.items[i - 1], p.items[i], p.items[i + 1]) for i in range(1, len(p.items), 2)]
        self.learn(patterns)
        values: dict[str, Column] = {}
        for x in [*nodes, *(e for _, e, _ in edges)]:
            for key, e in x.props.items():
                state, values[f"{x.var}__{key}"] = builder.value(state, e)
        made = [*[n.var for n in nodes], *[e.var for _, e, _ in edges]]
        first, row = self.next_id() + 1, F.monotonically_increasing_id()
        keys = [(F.lit(first) + row * len(made) + j).cast("long").alias(f"{v}__id") for j, v in enumerate(made)]
        df = self.rounds.keep(state.df.select("*", *[c.alias(n) for n, c in values.items()], *keys))
        vars_ = dict(state.vars)
        for x in nodes:
            names = used_labels(x.labels) if x.labels is not None else []
            table, own = names[0] if names else NO_LABEL, {"id": f"{x.var}__id", **{k: f"{x.var}__{k}" for k in x.props}}
            labels = F.array(*[F.lit(n) for n in names]).cast("array<string>")
            new = df.select(F.col(own["id"]).alias("id"), labels.alias("labels"), *[F.col(f"`{c}`").alias(k) for k, c in own.items() if k != "id"])
            old = self.graph.nodes.get(table)
            self.replaced("node", {table: new if old is None else stacked([old, new])}, {table} if len(names) != 1 else set())
            vars_[x.var] = Bound("node", own)
        state = State(df, vars_)
        for a, e, b in edges:
            if not e.types:
                raise SyntaxProblem("an edge that is created needs a type")
            src, dst = (b, a) if e.direction == "in" else (a, b)
            end = lambda x: F.col(f"`{state.vars[x.var].props['id']}`")  # noqa: B023, E731
            own = {"id": f"{e.var}__id", **{k: f"{e.var}__{k}" for k in e.props}}
            new = df.select(
                F.col(own["id"]).alias("id"), end(src).alias("src"), end(dst).alias("dst"), F.lit(e.types[0]).alias("type"),
                *[F.col(f"`{c}`").alias(k) for k, c in own.items() if k != "id"],
            )
            name = next((t for t in self.graph.edges if t.lower() == e.types[0].lower()), e.types[0])
            old = self.graph.edges.get(name)
            self.replaced("edge", {name: new if old is None else stacked([old, new])})
            vars_[e.var] = Bound("edge", own)
        return State(df, vars_)

    # -- DELETE
    def do_delete(self, builder: Builder, state: State, detach: bool, names: list[str]) -> State:
        """Edges first, so that a node may go with all its edges in one clause. Without DETACH a node that keeps an edge is an error."""
        state = State(self.rounds.keep(state.df), state.vars)
        edges = [v for v in names if state.vars[v].kind == "edge"]
        for v in edges:
            ids = self.ids(state, v)
            self.replaced("edge", {t: self.graph.edges[t].join(ids, "id", "left_anti") for t in self.tables(v, "edge")})
        for v in names:
            if v in edges:
                continue
            ids = self.ids(state, v)
            for end in ("src", "dst"):
                own = ids.withColumnRenamed("id", end)
                if detach:
                    self.replaced("edge", {t: df.join(own, end, "left_anti").select(*df.columns) for t, df in self.graph.edges.items()})
                elif any(not df.join(own, end, "left_semi").isEmpty() for df in self.graph.edges.values()):
                    raise ValueError(f"{v} still has edges: use DETACH DELETE")
            self.replaced("node", {t: self.graph.nodes[t].join(ids, "id", "left_anti") for t in self.tables(v, "node")})
        return state

    # -- SET, REMOVE
    def updated(self, state: State, var: str, columns: dict[str, Column], labels: Any = None, only: bool = False) -> None:
        """Set properties (and labels, a function of the old ones) of what a variable holds. If rows of one element disagree, the largest value counts.
        only: all other properties become null."""
        kind = state.vars[var].kind
        id_ = F.col(f"`{state.vars[var].props['id']}`").alias("id")
        new = state.df.select(id_, F.struct(*[c.alias(k) for k, c in columns.items()], F.lit(True).alias("_hit")).alias("_new")).where("id IS NOT NULL")
        new = self.rounds.keep(new.groupBy("id").agg(F.max("_new").alias("_new")))
        changed, fixed = {}, NODE_KEYS if kind == "node" else EDGE_KEYS
        tables = self.graph.nodes if kind == "node" else self.graph.edges
        for t in self.tables(var, kind):
            old = tables[t]
            joined, hit = old.join(new, "id", "left"), F.col("_new").isNotNull()
            out = [F.col(c) for c in fixed if c != "labels"]
            if kind == "node":
                out.insert(1, F.when(hit, labels(F.col("labels"))).otherwise(F.col("labels")).alias("labels") if labels else F.col("labels"))
            for c in [x for x in old.columns if x not in fixed] + [k for k in columns if k not in old.columns]:
                was = F.col(f"`{c}`") if c in old.columns else F.lit(None)
                then = F.col(f"_new.`{c}`") if c in columns else (F.lit(None) if only else was)
                out.append(F.when(hit, then).otherwise(was).alias(c))
            changed[t] = joined.select(*out)
        self.replaced(kind, changed, set(changed) if labels else set())

    def do_set(self, builder: Builder, state: State, items: list) -> State:
        for item in items:
            if item[0] == "label":
                self.updated(state, item[1], {}, lambda l, n=item[2]: F.array_union(l, F.array(F.lit(n))))
            elif item[0] == "prop":
                state, c = builder.value(state, item[3])
                self.updated(state, item[1], {item[2]: c})
            else:
                _, var, merge, e = item
                if e[0] != "map":
                    e = ("map", {k: ("lit", v) for k, v in dict(builder.constant(e)).items()})
                columns = {}
                for k, x in e[1].items():
                    state, columns[k] = builder.value(state, x)
                self.updated(state, var, columns, only=not merge)
        return state

    def do_remove(self, builder: Builder, state: State, items: list) -> State:
        for kind, var, name in items:
            if kind == "label":
                self.updated(state, var, {}, lambda l, n=name: F.array_except(l, F.array(F.lit(n))))
            else:
                tables = self.graph.nodes if state.vars[var].kind == "node" else self.graph.edges
                if any(name in tables[t].columns for t in self.tables(var, state.vars[var].kind)):
                    self.updated(state, var, {name: F.lit(None)})
        return state

    # -- MERGE
    def do_merge(self, builder: Builder, state: State, patterns: list[PathPattern], on_create: list, on_match: list) -> State:
        """Rows for which the pattern matches are bound to what matches; for each distinct set of outer values without a match it is created once."""
        self.learn(patterns)
        fresh = state.df is None
        state = self.unit(state)
        builder.needed |= {x.var for p in patterns for x in p.items}
        # Values of the pattern's properties, which say which rows want the same new elements.
        wanted: dict[str, str] = {}
        for p in patterns:
            for x in p.items:
                for key, e in x.props.items():
                    state, c = builder.value(state, e)
                    name = builder.fresh("want")
                    state = State(state.df.withColumn(name, c), {**state.vars, name: Bound("value")})
                    wanted[f"{x.var}.{key}"] = name
        state = State(self.rounds.keep(state.df), state.vars)
        bound = [v for x in (x for p in patterns for x in p.items) if (v := x.var) in state.vars]
        keyed = [
            PathPattern([
                type(x)(**{**vars(x), "props": {k: ("var", wanted[f"{x.var}.{k}"]) for k in x.props}}) for x in p.items
            ], p.var, p.mode, p.shortest)
            for p in patterns
        ]
        keys = [*wanted.values(), *[c for v in dict.fromkeys(bound) for c in builder.identity(state, v)]]
        outer = state.df.select(*[F.col(f"`{c}`") for c in keys]).distinct() if keys else state.df.limit(1).select(F.lit(1).alias("_one"))
        outer_state = State(outer, {**{w: Bound("value") for w in wanted.values()}, **{v: Bound(state.vars[v].kind, {"id": state.vars[v].props["id"]}) for v in bound}})
        hits = outer_state
        for p in keyed:
            hits = builder.path(hits, p)
        hits = State(self.rounds.keep(hits.df), hits.vars)
        same = reduce(lambda a, b: a & b, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"h.`{c}`")) for c in outer.columns])
        missing = outer.alias("o").join(hits.df.select(*[F.col(f"`{c}`") for c in outer.columns]).distinct().alias("h"), same, "left_anti")
        made = self.do_create(builder, State(missing, outer_state.vars), keyed)
        builder.graph = self.graph
        if on_create:
            self.do_set(builder, made, on_create)
        if on_match:
            builder.graph = self.graph
            self.do_set(builder, hits, on_match)
        builder.graph = self.graph
        out = state
        for p in keyed:
            out = builder.path(out, p)
        kept = {v: b for v, b in out.vars.items() if v not in wanted.values()}
        df = out.df.drop(*wanted.values(), *(["_unit"] if fresh else []))
        return State(self.rounds.keep(df), kept)

    # -- FOREACH
    def do_foreach(self, builder: Builder, state: State, var: str, source: tuple, clauses: list) -> State:
        state = self.unit(state)
        inner = builder.unwind(state, var, source, None, 0)
        for clause in clauses:
            builder.graph = self.graph
            inner = getattr(self, "do_" + clause[0])(builder, inner, *clause[1:])
        return state
