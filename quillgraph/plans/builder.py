"""From parsed queries to DataFrames.

A row of a running query is a row of flat columns: a node or edge variable `n` is the columns `n__id`, `n__name`, ..., a value is one
column of its own name. So Catalyst prunes what a query doesn't use down to the scans, and pushes filters of single variables
below the joins. An edge step is an equi-join on the edge table's src or dst; a node that is bound only to be passed
through is not joined at all if the graph declares the ends of the edge type.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions.aggregate import AGGREGATES, DISTINCT
from ..functions.registry import USER_FUNCTIONS
from ..graph import PropertyGraph, label_test
from .parser import EdgePattern, GroupPattern, NodePattern, PathPattern, Query, SyntaxProblem, parse

#: Hops that an open upper bound adds to the lower one.
OPEN_HOPS = 10


@dataclass
class Bound:
    kind: str  # node, edge, value, path, edges (of a variable-length step)
    props: dict[str, str] = field(default_factory=dict)  # property -> column


@dataclass
class State:
    df: DataFrame | None
    vars: dict[str, Bound] = field(default_factory=dict)

    def col(self, var: str, prop: str) -> Column:
        return F.col(f"`{var}__{prop}`")


def conjuncts(e: tuple | None) -> list[tuple]:
    if e is None:
        return []
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


def used_names(x: Any, out: set[str] | None = None) -> set[str]:
    """Names of all variables that stand in a tree."""
    out = set() if out is None else out
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
        out.add(x[1])
    elif isinstance(x, (tuple, list)):
        for y in x:
            used_names(y, out)
    elif isinstance(x, dict):
        used_names(list(x.values()), out)
    elif isinstance(x, Query):
        used_names(x.clauses, out)
    elif isinstance(x, PathPattern):
        used_names([x.items, x.others], out)
    elif isinstance(x, GroupPattern):
        used_names([x.inner, x.where], out)
    elif isinstance(x, (NodePattern, EdgePattern)):
        out.add(x.var)
        used_names([x.props, x.where], out)
    return out


def has_aggregate(e: Any) -> bool:
    if isinstance(e, tuple):
        if e and e[0] == "func" and e[1] in AGGREGATES:
            return True
        if e and e[0] in ("exists", "countsub", "valuesub", "patcomp"):
            return False
        return any(has_aggregate(x) for x in e)
    return isinstance(e, list) and any(has_aggregate(x) for x in e)


def only_counts(clause: tuple | None) -> bool:
    """Whether a clause returns rows with aggregates and each of these is count(*)."""
    if clause is None or clause[0] != "project" or (clause[3] and clause[3][0] == ("star",)):
        return False

    def walk(x: Any) -> list:
        own = [x] if isinstance(x, tuple) and x and x[0] == "func" and x[1] in AGGREGATES else []
        return own + [z for y in x for z in walk(y)] if isinstance(x, (tuple, list)) else own

    found = walk(list(clause[1:]))
    return bool(found) and any(has_aggregate(e) for e, _ in clause[3]) and all(list(f[2][:1]) == [("star",)] and not f[3] for f in found)


class Builder:
    def __init__(self, graph: PropertyGraph, params: dict[str, Any], catalog: Any = None):
        self.graph, self.params, self.catalog, self.n = graph, params, catalog, 0
        self.needed: set[str] = set()
        #: Columns that say how many rows a row of the next aggregation stands for.
        self.times: list[str] = []

    def fresh(self, stem: str) -> str:
        self.n += 1
        return f"_{stem}{self.n}"

    # -- statements
    def run(self, tree: Any) -> DataFrame:
        if isinstance(tree, Query):
            return self.query(tree, State(None)).df
        if tree[0] in ("explain", "profile"):
            from .explain import explained, profiled

            return (explained if tree[0] == "explain" else profiled)(self.run(tree[1]))
        op, every, left, right = tree
        a = self.run(left)
        if op == "next":
            state = State(a, {c: Bound("value") for c in a.columns})
            return self.query(right, state).df
        b = self.run(right)
        if len(a.columns) != len(b.columns):
            raise SyntaxProblem(f"{op} of {len(a.columns)} and {len(b.columns)} columns")
        if op == "union":
            return a.union(b) if every else a.union(b).distinct()
        if op == "except":
            return a.exceptAll(b) if every else a.subtract(b)
        if op == "intersect":
            return a.intersectAll(b) if every else a.intersect(b)
        # otherwise: the right side only if the left one is empty
        flag = a.limit(1).agg(F.count("*").alias("_some"))
        return a.union(b.crossJoin(F.broadcast(flag)).where("_some = 0").drop("_some"))

    def query(self, q: Query, state: State) -> State:
        outer, self.times = self.times, []
        try:
            return self.clauses(q, state)
        finally:
            self.times = outer

    def clauses(self, q: Query, state: State) -> State:
        self.needed |= self._needed(q)
        for i, clause in enumerate(q.clauses):
            kind = clause[0]
            if kind == "match":
                after = q.clauses[i + 1] if i + 1 < len(q.clauses) else None
                state = self.match(state, clause[1], clause[2], clause[3], after if only_counts(after) else None)
            elif kind == "filter":
                state = self.filter(state, clause[1])
            elif kind == "unwind":
                state = self.unwind(state, *clause[1:])
            elif kind == "let":
                for e, name in clause[1]:
                    state = self.with_value(state, name, e)
            elif kind == "project":
                state = self.project(state, *clause[1:])
                self.times = []
            elif kind == "page":
                state = State(self.page(state.df, state, clause[1:], {}), state.vars)
            elif kind == "subquery":
                state = self.subquery(state, *clause[1:])
            elif kind == "procedure":
                state = self.procedure(state, *clause[1:])
            elif kind == "finish":
                state = State(state.df.limit(0).select())
            elif kind == "load":
                state = self.load(state, *clause[1:])
            else:
                raise SyntaxProblem(f"{kind} changes the graph: use graph.execute")
        return state

    def _needed(self, q: Query) -> set[str]:
        """Variables of which more than the id is asked."""
        out: set[str] = set()

        def walk(x: Any) -> None:
            if isinstance(x, tuple):
                if x and x[0] == "func" and x[1] in ("id", "elementid", "count") and x[2] and x[2][0][0] == "var":
                    return
                if len(x) == 2 and x[0] == "var":
                    out.add(x[1])
                for y in x:
                    walk(y)
            elif isinstance(x, list):
                for y in x:
                    walk(y)
            elif isinstance(x, dict):
                walk(list(x.values()))
            elif isinstance(x, Query):
                walk(x.clauses)
            elif isinstance(x, PathPattern):
                walk([x.items, x.others])
            elif isinstance(x, GroupPattern):
                walk([x.inner, x.where])
            elif isinstance(x, (NodePattern, EdgePattern)):
                if x.props or x.where is not None:
                    out.add(x.var)
                walk([x.props, x.where])

        walk(q)
        return out

    # -- matching
    def match(self, state: State, optional: bool, patterns: list[PathPattern], where: tuple | None, counts: tuple | None = None) -> State:
        """counts: the clause that follows, if all it aggregates is count(*)."""
        if not optional:
            counted = self.counted(state, patterns, [where, counts]) if counts else {}
            for i, p in enumerate(patterns):
                if i not in counted:
                    state = self.path(state, p)
            state = self.filter(state, where)
            for i, var in counted.items():
                state = self.multiplied(state, patterns[i], var)
            return state
        if state.df is None:
            state = State(self.graph.spark.range(1).select(F.lit(1).alias("_unit")))
        keys = [v for v in state.vars if v in used_names(list(patterns)) | used_names(where)]
        inner = self.correlated(state, keys)
        for p in patterns:
            inner = self.path(inner, p)
        inner = self.filter(inner, where)
        return self.attach(state, inner, keys, "left")

    def counted(self, state: State, patterns: list[PathPattern], others: list) -> dict[int, str]:
        """Plain paths of which one node, bound by what is left, is all that the rest asks for: place -> that variable. Of these only the number matters."""
        names = [used_names(p) for p in patterns]
        asked = used_names(others) | set(state.vars)
        found: dict[int, str] = {}
        for i, p in enumerate(patterns):
            shared = names[i] & asked.union(*names[:i], *names[i + 1 :])
            nodes = [x for x in p.items[::2] if x.var in shared]
            plain = not (p.others or p.shortest or p.var) and not any(isinstance(x, GroupPattern) or isinstance(x, EdgePattern) and (x.low is not None or x.high is not None) for x in p.items)
            if plain and len(p.items) > 1 and len(shared) == len(nodes) == 1 and nodes[0].labels is None and not nodes[0].props and nodes[0].where is None:
                bound = set(state.vars).union(*[names[j] for j in range(len(patterns)) if j != i and j not in found])
                if nodes[0].var in bound:
                    found[i] = nodes[0].var
        # What is found later may not take away what binds an earlier one.
        kept = set(state.vars).union(*[names[j] for j in range(len(patterns)) if j not in found])
        return {i: v for i, v in found.items() if v in kept}

    def multiplied(self, state: State, p: PathPattern, var: str) -> State:
        """The rows for which a path from `var` is there, with the number of such paths in a column of self.times."""
        c, own, times = state.vars[var].props["id"], self.fresh("key"), self.fresh("times")
        found = self.path(State(state.df.select(F.col(f"`{c}`")).distinct(), {var: Bound("node", {"id": c})}), p)
        number = found.df.groupBy(F.col(f"`{c}`").alias(own)).agg(F.count(F.lit(1)).alias(times))
        self.times.append(times)
        return State(state.df.join(number, F.col(f"`{c}`") == F.col(own)).drop(own), state.vars)

    def correlated(self, state: State, keys: list[str]) -> State:
        """What an inner query sees of these variables: their distinct values, so repeated outer rows are looked up once."""
        if not keys or state.df is None:
            return State(None)
        columns = [c for k in keys for c in self.columns_of(state, k)]
        return State(state.df.select(*[F.col(f"`{c}`") for c in columns]).distinct(), {k: state.vars[k] for k in keys})

    def columns_of(self, state: State, var: str) -> list[str]:
        b = state.vars[var]
        return list(b.props.values()) if b.kind in ("node", "edge") else [var]

    def identity(self, state: State, var: str) -> list[str]:
        b = state.vars[var]
        return [b.props["id"]] if b.kind in ("node", "edge") else [var]

    def attach(self, outer: State, inner: State, keys: list[str], how: str) -> State:
        """Join an inner result back on the variables it was given; null equals null."""
        new = {v: b for v, b in inner.vars.items() if v not in outer.vars}
        on, renamed = [], inner.df
        for k in keys:
            for c in self.identity(outer, k):
                own = self.fresh("key")
                renamed = renamed.withColumn(own, F.col(f"`{c}`"))
                plain = outer.vars[k].kind == "node" and not getattr(outer, "nullable", False)
                on.append((c, own, plain))
        columns = [own for _, own, _ in on] + [c for v in new for c in (b_cols(new[v], v))]
        right = renamed.select(*[F.col(f"`{c}`") for c in columns])
        if not on:
            df = outer.df.join(right, how=how) if how != "left" else outer.df.join(right, F.lit(True), "left")
        else:
            cond = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(own)) if not plain else F.col(f"`{c}`") == F.col(own) for c, own, plain in on])
            df = outer.df.join(right, cond, how)
        if how not in ("left_semi", "left_anti"):
            df = df.drop(*[own for _, own, _ in on])
        return State(df, {**outer.vars, **(new if how not in ("left_semi", "left_anti") else {})})

    def node_columns(self, df: DataFrame, var: str, kind: str) -> tuple[DataFrame, Bound]:
        props = {c: f"{var}__{c}" for c in df.columns}
        return df.select(*[F.col(f"`{c}`").alias(n) for c, n in props.items()]), Bound(kind, props)

    def join_state(self, state: State, df: DataFrame, on: Column | None = None) -> DataFrame:
        if state.df is None:
            return df
        return state.df.join(df, on) if on is not None else state.df.crossJoin(df)

    def bind_node(self, state: State, node: NodePattern, at: str | None = None) -> State:
        """Bind a node variable; `at`: a column with its id, from the edge just taken."""
        var = node.var
        if var in state.vars:
            b = state.vars[var]
            if at is not None:
                state = State(state.df.where(F.col(f"`{at}`") == F.col(f"`{b.props['id']}`")).drop(at), state.vars)
            return self.node_tests(state, node, label_too=True)
        full = var in self.needed or node.labels is not None or at is None
        if at is not None and not full:
            return State(state.df.withColumnRenamed(at, f"{var}__id"), {**state.vars, var: Bound("node", {"id": f"{var}__id"})})
        if at is not None and node.labels is not None and var not in self.needed and getattr(self, "_sure_end", None) == node.labels:
            return State(state.df.withColumnRenamed(at, f"{var}__id"), {**state.vars, var: Bound("node", {"id": f"{var}__id"})})
        table, bound = self.node_columns(self.graph.node_scan(node.labels), var, "node")
        df = table if state.df is None else (
            state.df.join(table, F.col(f"`{at}`") == F.col(f"`{var}__id`")).drop(at) if at is not None else state.df.crossJoin(table)
        )
        return self.node_tests(State(df, {**state.vars, var: bound}), node)

    def node_tests(self, state: State, node: NodePattern, label_too: bool = False) -> State:
        if label_too and node.labels is not None and "labels" in state.vars[node.var].props:
            state = State(state.df.where(label_test(state.col(node.var, "labels"), node.labels)), state.vars)
        for key, e in node.props.items():
            state = self.filter(state, ("bin", "=", ("prop", ("var", node.var), key), e))
        return self.filter(state, node.where)

    def path(self, state: State, p: PathPattern) -> State:
        if p.others:
            return self.alternatives(state, p)
        if p.shortest:
            return self.shortest(state, p)
        if p.var:
            self.needed |= {x.var for x in p.items if isinstance(x, EdgePattern)}
        grouped = any(isinstance(x, GroupPattern) for x in p.items)
        # Start where a variable is bound already, if there is one.
        items = list(p.items)
        nodes = items[::2]
        start = 0 if grouped else next((i for i, n in enumerate(nodes) if n.var in state.vars), 0)
        state = self.bind_node(state, nodes[start])
        for i in range(start, len(nodes) - 1):
            state = self.step(state, nodes[i], items[2 * i + 1], nodes[i + 1], p.mode)
        for i in range(start, 0, -1):
            state = self.step(state, nodes[i], _turned(items[2 * i - 1]), nodes[i - 1], p.mode, turned=True)
        if p.var:
            state = self.path_value(state, p)
        return state

    def alternatives(self, state: State, p: PathPattern) -> State:
        """The union of paths; variables that one of them lacks are null in its rows. `|` keeps a row once, `|+|` as often as it is found."""
        first = PathPattern(p.items, p.var, p.mode, p.shortest)
        found = [self.path(state, x) for x in [first, *p.others]]
        named = [c for s in found for v, b in s.vars.items() if not v.startswith("_anon") for c in b_cols(b, v)]
        keep = list(dict.fromkeys(named))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.df.select(*[F.col(f"`{c}`") for c in keep if c in s.df.columns]) for s in found])
        vars_ = {v: b for s in reversed(found) for v, b in s.vars.items() if not v.startswith("_anon")}
        return State(df if p.every else df.distinct(), vars_)

    def group(self, state: State, a: NodePattern, g: GroupPattern, b: NodePattern, mode: str) -> State:
        """A quantified path, unrolled: for each number of repetitions a chain of joins with the condition inside each of them."""
        high = g.high if g.high is not None else g.low + OPEN_HOPS
        columns = list(state.df.columns)
        out: list[State] = []
        chain = state
        here = a
        if g.low == 0:
            at = self.fresh("at")
            same = State(state.df.withColumn(at, F.col(f"`{state.vars[a.var].props['id']}`")), state.vars)
            out.append(self.bind_node(same, b, at))
        for turn in range(1, high + 1):
            names = {x.var: self.fresh(f"turn{turn}_") for x in g.inner.items}
            first = g.inner.items[0]
            names[first.var] = here.var
            self.needed |= set(names.values())
            swap = lambda e: _renamed_all(e, names)  # noqa: B023, E731
            own = [type(x)(**{**vars(x), "var": names[x.var], "props": {k: swap(v) for k, v in x.props.items()}, "where": swap(x.where)}) for x in g.inner.items]
            if chain.vars[here.var].props.keys() == {"id"}:  # a node that was only passed through until now
                full = NodePattern(self.fresh("full"))
                self.needed.add(full.var)
                at = self.fresh("at")
                chain = self.bind_node(State(chain.df.withColumn(at, F.col(f"`{chain.vars[here.var].props['id']}`")), chain.vars), full, at)
                names[first.var] = full.var
                own[0] = type(first)(**{**vars(own[0]), "var": full.var, "props": {k: _renamed_all(v, names) for k, v in first.props.items()}, "where": _renamed_all(first.where, names)})
            chain = self.node_tests(chain, own[0], label_too=True)
            for i in range(1, len(own), 2):
                chain = self.step(chain, own[i - 1], own[i], own[i + 1], mode)
            chain = self.filter(chain, _renamed_all(g.where, names))
            here = own[-1]
            if turn >= g.low:
                at = self.fresh("at")
                end = State(chain.df.withColumn(at, F.col(f"`{chain.vars[here.var].props['id']}`")), chain.vars)
                out.append(self.bind_node(end, b, at))
        vars_ = {**state.vars, b.var: out[0].vars[b.var]}
        keep = list(dict.fromkeys([*columns, *b_cols(vars_[b.var], b.var)]))
        df = reduce(lambda x, y: x.unionByName(y), [s.df.select(*[F.col(f"`{c}`") for c in keep]) for s in out])
        return State(df, vars_)

    def edge_table(self, edge: EdgePattern, extra: bool) -> DataFrame:
        """(from, to, edge columns); both directions of an undirected step, so a loop counts twice."""
        table = self.graph.edge_scan(edge.types)
        own = [F.col(f"`{c}`").alias(f"{edge.var}__{c}") for c in table.columns] if extra else [F.col("id").alias(f"{edge.var}__id")]
        ahead = table.select(F.col("src").alias(f"{edge.var}__from"), F.col("dst").alias(f"{edge.var}__to"), *own)
        back = table.select(F.col("dst").alias(f"{edge.var}__from"), F.col("src").alias(f"{edge.var}__to"), *own)
        return {"out": ahead, "in": back, "both": ahead.unionByName(back)}[edge.direction]

    def step(self, state: State, a: NodePattern, edge: EdgePattern, b: NodePattern, mode: str, turned: bool = False) -> State:
        if isinstance(edge, GroupPattern):
            return self.group(state, a, edge, b, mode)
        if edge.low is not None or edge.high is not None:
            return self.many_steps(state, a, edge, b, mode, turned)
        here = F.col(f"`{state.vars[a.var].props['id']}`")
        again = edge.var in state.vars
        bare = edge.var if not again else self.fresh("edge")
        own = EdgePattern(bare, edge.types, edge.direction, props=edge.props, where=edge.where)
        table = self.edge_table(own, extra=edge.var in self.needed)
        df = state.df.join(table, here == F.col(f"`{bare}__from`")).drop(f"{bare}__from")
        props = {c.removeprefix(f"{bare}__"): c for c in table.columns if not c.endswith(("__from", "__to"))}
        new = State(df, {**state.vars, bare: Bound("edge", props)})
        if again:
            new = State(new.df.where(F.col(f"`{bare}__id`") == F.col(f"`{state.vars[edge.var].props['id']}`")), new.vars)
        for key, e in edge.props.items():
            new = self.filter(new, ("bin", "=", ("prop", ("var", bare), key), e))
        new = self.filter(new, edge.where)
        ends = [self.graph.ends.get(t) for t in self.graph.edges if t.lower() in {x.lower() for x in edge.types}]
        side = {"out": 1, "in": 0}.get(edge.direction)
        sure = {("label", e[side]) if e else None for e in ends} if side is not None else {None}
        self._sure_end = sure.pop() if len(sure) == 1 else None
        new = self.bind_node(new, b, f"{bare}__to")
        self._sure_end = None
        return new

    def many_steps(self, state: State, a: NodePattern, edge: EdgePattern, b: NodePattern, mode: str, turned: bool) -> State:
        """Variable-length step: a join for each hop, the union of the wanted depths. Edge ids are carried as a list."""
        from ..operators.paths import walks

        low = edge.low or 0
        high = edge.high if edge.high is not None else low + OPEN_HOPS
        one = EdgePattern("_hop", edge.types, edge.direction, props=edge.props, where=edge.where)
        hops = State(self.edge_table(one, extra=bool(edge.props) or edge.where is not None or edge.var in self.needed), {})
        hops.vars["_hop"] = Bound("edge", {c.removeprefix("_hop__"): c for c in hops.df.columns})
        for key, e in edge.props.items():
            hops = self.filter(hops, ("bin", "=", ("prop", ("var", "_hop"), key), e))
        if edge.where is not None:
            hops = self.filter(hops, _renamed(edge.where, edge.var, "_hop"))
        start = self.fresh("start")
        df = state.df.withColumn(start, F.col(f"`{state.vars[a.var].props['id']}`"))
        ends = walks(
            df.select(start).distinct(), start,
            hops.df.select(F.col("_hop__from").alias("src"), F.col("_hop__to").alias("dst"), F.col("_hop__id").alias("id")), low, high, mode,
        )
        to, length, edges, nodes = (f"{edge.var}__{x}" for x in ("to", "length", "edges", "nodes"))
        named = ends.select(F.col("start").alias(f"{start}_"), F.col("node").alias(to), F.col("length").alias(length), F.col("edges").alias(edges), F.col("nodes").alias(nodes))
        df = df.join(named, F.col(start) == F.col(f"{start}_")).drop(start, f"{start}_")
        if turned:
            df = df.withColumn(edges, F.reverse(edges)).withColumn(nodes, F.reverse(nodes))
        new = State(df, {**state.vars, edge.var: Bound("edges", {"length": length, "edges": edges, "nodes": nodes})})
        return self.bind_node(new, b, to)

    def path_value(self, state: State, p: PathPattern) -> State:
        ids, edges = [], []
        for x in p.items:
            b = state.vars[x.var]
            if isinstance(x, NodePattern):
                ids.append(F.array(F.col(f"`{b.props['id']}`")))
            elif b.kind == "edges":
                edges.append(F.col(f"`{b.props['edges']}`"))
                inner = F.col(f"`{b.props['nodes']}`")
                ids.append(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))))
                if x is p.items[-2]:
                    pass
            else:
                edges.append(F.array(F.col(f"`{b.props['id']}`")))
        none = F.array().cast("array<bigint>")
        value = F.struct(F.concat(*ids).alias("nodes"), F.concat(none, *edges).alias("edges"))
        return State(state.df.withColumn(p.var, value), {**state.vars, p.var: Bound("path")})

    def shortest(self, state: State, p: PathPattern) -> State:
        """Unweighted shortest paths between the ends of a pattern; the path variable holds the length, one row for each shortest path."""
        from ..operators.paths import shortest_lengths

        first, edge, last = p.items[0], p.items[1], p.items[-1]
        state = self.bind_node(self.bind_node(state, first), last)
        a, b = (f"`{state.vars[x.var].props['id']}`" for x in (first, last))
        one = EdgePattern("_hop", edge.types, edge.direction)
        hops = self.edge_table(one, extra=False).select(F.col("_hop__from").alias("src"), F.col("_hop__to").alias("dst"))
        pairs = state.df.select(F.col(a).alias("start"), F.col(b).alias("goal")).distinct()
        found = shortest_lengths(pairs, hops, edge.high if edge.high is not None else None, count_paths=p.shortest == "all")
        var = p.var or self.fresh("path")
        found = found.select(F.col("start").alias("_sp_a"), F.col("goal").alias("_sp_b"), F.col("length").alias(var), "paths")
        df = state.df.join(found, (F.col(a) == F.col("_sp_a")) & (F.col(b) == F.col("_sp_b"))).drop("_sp_a", "_sp_b")
        df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("paths")))).drop("_copy", "paths") if p.shortest == "all" else df.drop("paths")
        return State(df, {**state.vars, var: Bound("value")})

    # -- clauses
    def filter(self, state: State, where: tuple | None) -> State:
        for part in conjuncts(where):
            negated = part[0] == "not" and part[1][0] == "exists"
            if part[0] == "exists" or negated:
                q = part[1][1] if negated else part[1]
                keys = [v for v in state.vars if v in used_names(q)]
                inner = self.query(q, self.correlated(state, keys))
                state = self.attach(state, inner, keys, "left_anti" if negated else "left_semi")
            else:
                state, c = self.value(state, part)
                state = State(state.df.where(c), state.vars)
        return state

    def value(self, state: State, e: tuple) -> tuple[State, Column]:
        """Column of an expression; subqueries in it are joined to the rows first."""
        state, plain = self.lift(state, e)
        return state, Expression(self, state).column(plain)

    def lift(self, state: State, e: Any) -> tuple[State, Any]:
        """Replace subqueries in an expression by columns that hold their values."""
        if isinstance(e, list):
            out = []
            for x in e:
                state, y = self.lift(state, x)
                out.append(y)
            return state, out
        if not isinstance(e, tuple):
            return state, e
        if e and e[0] in ("exists", "countsub", "valuesub", "patcomp"):
            return self.subvalue(state, e)
        if len(e) == 4 and e[0] == "func" and e[1] in self.graph.scores and len(e[2]) == 1 and e[2][0][0] == "var":
            return self.score(state, e[1], e[2][0][1])
        out = []
        for x in e:
            state, y = self.lift(state, x)
            out.append(y)
        return state, tuple(out)

    def score(self, state: State, name: str, var: str) -> tuple[State, tuple]:
        """The value that a table of scores has for a node; null if it has none."""
        table, own = self.graph.scores[name], self.fresh("score")
        value = next(c for c in table.columns if c != "node")
        named = table.select(F.col("node").alias(own + "n"), F.col(value).alias(own))
        df = state.df.join(named, F.col(f"`{state.vars[var].props['id']}`") == F.col(own + "n"), "left").drop(own + "n")
        return State(df, {**state.vars, own: Bound("value")}), ("var", own)

    def subvalue(self, state: State, e: tuple) -> tuple[State, tuple]:
        q, name = e[1], self.fresh("sub")
        if e[0] == "valuesub":
            return self.scalar_subquery(state, q, name)
        last = q.clauses[-1] if q.clauses else None
        if e[0] in ("exists", "countsub") and last and last[0] == "project" and not last[2] and last[6][2] is None and not any(has_aggregate(x) for x, _ in last[3]):
            q = Query(q.clauses[:-1])  # what a row holds doesn't matter, only that it is there
        keys = [v for v in state.vars if v in used_names(list(e[1:]))]
        inner = self.query(self._carrying(q, keys) if e[0] != "patcomp" else q, self.correlated(state, keys))
        by = [c for k in keys for c in self.identity(state, k)]
        grouped = inner.df.groupBy(*[F.col(f"`{c}`") for c in by])
        if e[0] == "patcomp":
            inner, c = self.value(inner, e[2])
            result = inner.df.groupBy(*[F.col(f"`{c_}`") for c_ in by]).agg(F.collect_list(c).alias(name))
        else:
            result = grouped.agg(F.count("*").alias(name))
        vars_ = {k: state.vars[k] for k in keys} | {name: Bound("value")}
        out = self.attach(state, State(result, vars_), keys, "left")
        v: tuple = ("var", name)
        if e[0] == "exists":
            v = ("bin", ">", ("func", "coalesce", [v, ("lit", 0)], False), ("lit", 0))
        elif e[0] == "countsub":
            v = ("func", "coalesce", [v, ("lit", 0)], False)
        elif e[0] == "patcomp":
            v = ("func", "coalesce", [v, ("list", [])], False)
        return out, v

    def scalar_subquery(self, state: State, q: Query, name: str) -> tuple[State, tuple]:
        """VALUE { }: the value of the one row, null without a row. If there are several, the smallest."""
        last = q.clauses[-1] if q.clauses else None
        if not last or last[0] != "project" or len(last[3]) != 1:
            raise SyntaxProblem("VALUE { } returns one value")
        renamed = Query([*q.clauses[:-1], (*last[:3], [(last[3][0][0], name)], *last[4:])])
        if state.df is None:
            state = State(self.graph.spark.range(1).select(F.lit(1).alias("_unit")), state.vars)
        keys = [v for v in state.vars if v in used_names(renamed)]
        inner, lone = self.inner_rows(state, keys, renamed)
        if not lone:
            by = [c for k in keys for c in self.identity(state, k)]
            inner = State(inner.df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.min(name).alias(name)), {k: state.vars[k] for k in keys} | {name: Bound("value")})
        return self.attach_filled(state, inner, keys, lone, optional=True), ("var", name)

    def with_value(self, state: State, name: str, e: tuple) -> State:
        state = state if state.df is not None else State(self.graph.spark.range(1).select(F.lit(1).alias("_unit")), state.vars)
        state, c = self.value(state, e)
        return State(state.df.withColumn(name, c), {**state.vars, name: Bound("value")})

    def unwind(self, state: State, var: str, e: tuple, ordinal: str | None, base: int) -> State:
        """A row for each item; null and empty lists give none."""
        if state.df is None:
            state = State(self.graph.spark.range(1).select(F.lit(1).alias("_unit")))
        state, c = self.value(state, e)
        if ordinal is None:
            df = state.df.withColumn(var, F.explode(c))
        else:
            df = state.df.select("*", F.posexplode(c).alias(ordinal, var)).withColumn(ordinal, (F.col(ordinal) + base).cast("long"))
        return State(df, {**state.vars, var: Bound("value"), **({ordinal: Bound("value")} if ordinal else {})})

    def project(self, state: State, final: bool, distinct: bool, items: list, group: list | None, where: tuple | None, page: tuple) -> State:
        if state.df is None:
            state = State(self.graph.spark.range(1).select(F.lit(1).alias("_unit")))
        if items and items[0] == ("star",):
            items = [(("var", v), v) for v in state.vars if not v.startswith("_")] + items[1:]
        lifted = []
        for e, alias in items:
            state, plain = self.lift(state, e)
            lifted.append((plain, alias))
        x = Expression(self, state)
        if group is not None or any(has_aggregate(e) for e, _ in lifted):
            bound = {a: state.vars[e[1]] for e, a in lifted if not final and e[0] == "var" and e[1] in state.vars}
            whole = {a: b for a, b in bound.items() if b.kind in ("node", "edge")}
            out = self.aggregate(state, lifted, group, x, {a: b.props for a, b in whole.items()})
            keep = {a: (whole[a].kind, {p: f"{a}__{p}" for p in whole[a].props}) if a in whole else ("value", None) for _, a in lifted}
            before = None
        else:
            keep, selects = {}, []
            for e, alias in lifted:
                if e[0] == "var" and not final and state.vars.get(e[1], Bound("value")).kind in ("node", "edge", "edges"):
                    b = state.vars[e[1]]
                    props = {p: f"{alias}__{p}" for p in b.props}
                    selects += [F.col(f"`{c}`").alias(props[p]) for p, c in b.props.items()]
                    keep[alias] = (b.kind, props)
                else:
                    selects.append(x.column(e).alias(alias))
                    keep[alias] = (state.vars[e[1]].kind if e[0] == "var" and e[1] in state.vars else "value", None)
            before, out = state, selects
        new_vars = {a: Bound(k if k in ("node", "edge", "edges", "path") and p else ("path" if k == "path" else "value"), p or {}) for a, (k, p) in keep.items()}
        order = page[0]
        if before is None:
            df = out
        elif distinct or not order:
            df = state.df.select(*out)
            df = df.distinct() if distinct else df
        else:
            # ORDER BY may use what isn't returned: sort on the wide rows, then select.
            state, wide = self.sorted(state, order, {a: e for e, a in lifted}, page[2], page[1])
            return self.filter(State(wide.select(*out), new_vars), where)
        result = State(df, new_vars)
        named = _by_text([(e, a) for e, a in lifted if e[0] != "var" or new_vars[a].kind == "value"])
        result = State(self.page(df, result, ([(_swap(e, named), d, n) for e, d, n in order], page[1], page[2]), {}), new_vars)
        return self.filter(result, where)

    def sorted(self, state: State, order: list, aliases: dict[str, tuple], limit: tuple | None, skip: tuple | None) -> tuple[State, DataFrame]:
        keys = []
        for e, down, nulls in order:
            if e[0] == "var" and e[1] in aliases and e[1] not in state.vars:
                e = aliases[e[1]]
            state, c = self.value(state, e)
            keys.append(_order_key(c, down, nulls))
        return state, self.cut(state.df.orderBy(*keys), skip, limit)

    def page(self, df: DataFrame, state: State, page: tuple, _: dict) -> DataFrame:
        order, skip, limit = page
        if order:
            x = Expression(self, state)
            df = df.orderBy(*[_order_key(x.column(e), down, nulls) for e, down, nulls in order])
        return self.cut(df, skip, limit)

    def cut(self, df: DataFrame, skip: tuple | None, limit: tuple | None) -> DataFrame:
        if skip is not None:
            df = df.offset(int(self.constant(skip)))
        return df.limit(int(self.constant(limit))) if limit is not None else df

    def constant(self, e: tuple) -> Any:
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params[e[1]]
        if e[0] == "neg":
            return -self.constant(e[1])
        if e[0] == "list":
            return [self.constant(x) for x in e[1]]
        if e[0] == "map":
            return {k: self.constant(v) for k, v in e[1].items()}
        raise SyntaxProblem("a constant is asked for here")

    def aggregate(self, state: State, items: list, group: list | None, x: Expression, whole: dict[str, dict[str, str]]) -> DataFrame:
        """Group by the items without an aggregate; aggregates inside larger expressions are computed first, then the rest.

        whole: nodes and edges that stay bound, with their columns; they are grouped by all of these.
        """
        keys = [(e, a) for e, a in items if not has_aggregate(e) and a not in whole]
        columns: dict[str, Column] = {}

        def pull(e: Any) -> Any:
            if isinstance(e, tuple) and e and e[0] == "func" and e[1] in AGGREGATES:
                name = f"_agg{len(columns)}"
                columns[name] = x.aggregate(e)
                return ("var", name)
            if isinstance(e, tuple):
                return tuple(pull(y) for y in e)
            return [pull(y) for y in e] if isinstance(e, list) else e

        rest = [(pull(e), a) for e, a in items]
        by = [(e, f"_key{i}") for i, (e, _) in enumerate(keys)]
        extra = [(e, f"_group{i}") for i, e in enumerate(group or []) if e not in [k for k, _ in keys] and not (e[0] == "var" and e[1] in [a for _, a in keys])]
        own = [F.col(f"`{c}`") for props in whole.values() for c in props.values()]
        by_columns = [x.column(e).alias(n) for e, n in by + extra] + own
        grouped = state.df.groupBy(*by_columns).agg(*[c.alias(n) for n, c in columns.items()]) if columns else state.df.select(*by_columns).distinct()
        named = _by_text(by)
        after = State(grouped, {c: Bound("value") for c in grouped.columns})
        y = Expression(self, after)
        return grouped.select(
            *[y.column(_swap(e, named)).alias(a) for (e, a) in rest if a not in whole],
            *[F.col(f"`{c}`").alias(f"{a}__{p}") for a, props in whole.items() for p, c in props.items()],
        )

    def subquery(self, state: State, optional: bool, scope: list[str] | None, inner_query: Query) -> State:
        """CALL { }: the inner rows of each outer row. An inner query that only aggregates has one row for each outer row, also where nothing matched."""
        if state.df is None:
            return self.query(inner_query, State(None))
        keys = [v for v in state.vars if v in (scope if scope is not None else used_names(inner_query))]
        inner, lone = self.inner_rows(state, keys, inner_query)
        return self.attach_filled(state, inner, keys, lone, optional)

    def inner_rows(self, state: State, keys: list[str], q: Query) -> tuple[State, dict[str, tuple]]:
        """Rows of an inner query with the variables it was given, and, if it only aggregates, the expression of each column over no rows.

        Its ORDER BY, SKIP and LIMIT hold for each outer row by itself.
        """
        last = q.clauses[-1] if q.clauses else None
        if not last or last[0] != "project" or not keys:
            carried = self._carrying(q, keys)
            lone = self.over_nothing(last) if last and last[0] == "project" else {}
            return self.query(carried, self.correlated(state, keys)), lone if keys else {}
        page, lone = last[6], self.over_nothing(last)
        order, skip, limit = page
        cut = skip is not None or limit is not None
        plain = Query([*q.clauses[:-1], (*last[:5], None if lone else last[5], ([], None, None))])
        inner = self.query(self._carrying(plain, keys), self.correlated(state, keys))
        if cut and not lone:
            named = {a: e for e, a in last[3]}
            x = Expression(self, inner)
            by = [F.col(f"`{c}`") for k in keys for c in self.identity(inner, k)]
            within = Window.partitionBy(*by).orderBy(*([_order_key(x.column(_swap(e, _by_text([(e2, a) for a, e2 in named.items()]))), d, n) for e, d, n in order] or [F.lit(1)]))
            first = int(self.constant(skip)) if skip is not None else 0
            place = F.col("_place")
            df = inner.df.withColumn("_place", F.row_number().over(within)).where(place > first)
            df = df.where(place <= first + int(self.constant(limit))) if limit is not None else df
            inner = State(df.drop("_place"), inner.vars)
        if lone and last[5] is not None:
            lone = {**lone, "_where": last[5]}
        return inner, lone

    def over_nothing(self, project: tuple) -> dict[str, tuple]:
        """For a projection of aggregates only: each column's expression with counts 0, lists empty and all other aggregates null. Else empty."""
        _, _, _, items, group, _, _ = project
        if group is not None or not any(has_aggregate(e) for e, _ in items):
            return {}

        def empty(e: Any) -> Any:
            if isinstance(e, tuple) and e and e[0] == "func" and e[1] in AGGREGATES:
                return ("lit", 0) if e[1] in ("count", "regr_count") else ("list", []) if e[1] in ("collect", "collect_list") else ("lit", None)
            if isinstance(e, tuple):
                return tuple(empty(x) for x in e)
            return [empty(x) for x in e] if isinstance(e, list) else e

        filled = {a: empty(e) for e, a in items}
        return {} if any(used_names(e) for e in filled.values()) else filled

    def attach_filled(self, state: State, inner: State, keys: list[str], lone: dict[str, tuple], optional: bool) -> State:
        where = lone.pop("_where", None) if lone else None
        if not lone:
            return self.attach(state, inner, keys, "left" if optional else "inner")
        hit = self.fresh("hit")
        out = self.attach(state, State(inner.df.withColumn(hit, F.lit(True)), {**inner.vars, hit: Bound("value")}), keys, "left")
        for a, e in lone.items():
            c = F.col(f"`{a}`")
            filled = F.array().cast(out.df.schema[a].dataType) if e == ("list", []) else Expression(self, out).column(e).cast(out.df.schema[a].dataType)
            out = State(out.df.withColumn(a, F.when(F.col(hit), c).otherwise(filled)), out.vars)
        out = State(out.df.drop(hit), {v: b for v, b in out.vars.items() if v != hit})
        return self.filter(out, where)

    def _carrying(self, q: Query, keys: list[str]) -> Query:
        """The query with the outer variables kept through its projections."""
        out = []
        for c in q.clauses:
            if c[0] == "project":
                _, _, distinct, items, group, where, page = c
                own = [(("var", k), k) for k in keys if k not in [a for _, a in items if a]]
                c = ("project", False, distinct, own + list(items), group, where, page)
            out.append(c)
        return Query(out)

    def procedure(self, state: State, name: str, args: list, yields: list) -> State:
        from ..operators.procedures import call

        values = [self.constant(a) for a in args]
        df = call(self.graph, name, values)
        if yields:
            df = df.select(*[F.col(a).alias(b) for a, b in yields])
        vars_ = {**state.vars, **{c: Bound("value") for c in df.columns}}
        return State(self.join_state(state, df), vars_)

    def load(self, state: State, kind: str, headers: bool, path: tuple, var: str, sep: str) -> State:
        from ..sources.files import load_rows

        df = load_rows(self.graph.spark, self.constant(path), headers, sep).withColumnRenamed("row", var)
        return State(self.join_state(state, df), {**state.vars, var: Bound("value")})


def b_cols(b: Bound, var: str) -> list[str]:
    return list(b.props.values()) if b.kind in ("node", "edge", "edges") else [var]


def _turned(e: EdgePattern) -> EdgePattern:
    return EdgePattern(e.var, e.types, {"out": "in", "in": "out", "both": "both"}[e.direction], e.low, e.high, e.props, e.where)


def _renamed(e: Any, old: str, new: str) -> Any:
    if isinstance(e, tuple):
        return ("var", new) if e == ("var", old) else tuple(_renamed(x, old, new) for x in e)
    return [_renamed(x, old, new) for x in e] if isinstance(e, list) else e


def _renamed_all(e: Any, names: dict[str, str]) -> Any:
    if isinstance(e, tuple):
        return ("var", names[e[1]]) if len(e) == 2 and e[0] == "var" and e[1] in names else tuple(_renamed_all(x, names) for x in e)
    if isinstance(e, dict):
        return {k: _renamed_all(v, names) for k, v in e.items()}
    return [_renamed_all(x, names) for x in e] if isinstance(e, list) else e


def _by_text(items: list) -> dict[str, tuple]:
    return {repr(e): ("var", name) for e, name in items}


def _swap(e: Any, named: dict[str, tuple]) -> Any:
    """The expression with parts that have a name replaced by it."""
    if isinstance(e, tuple):
        return named[repr(e)] if repr(e) in named else tuple(_swap(x, named) for x in e)
    return [_swap(x, named) for x in e] if isinstance(e, list) else e


def _order_key(c: Column, down: bool, nulls: str | None) -> Column:
    """Nulls come last in ascending order and first in descending order, unless the query says."""
    if down:
        return c.desc_nulls_last() if nulls == "last" else c.desc_nulls_first()
    return c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last()


class Expression:
    """Expressions over the rows of a state."""

    def __init__(self, builder: Builder, state: State, local: dict[str, Column] | None = None):
        self.b, self.state, self.local = builder, state, local or {}

    def inner(self, **more: Column) -> Expression:
        return Expression(self.b, self.state, {**self.local, **more})

    def type_of(self, e: tuple) -> T.DataType:
        """Type of an expression, asked from the analyzer; inside lambdas unknown (null type)."""
        if self.local:
            return T.NullType()
        df = self.state.df if self.state.df is not None else self.b.graph.spark.range(1)
        return df.select(self.column(e).alias("x")).schema[0].dataType

    def column(self, e: tuple) -> Column:
        return getattr(self, "do_" + e[0])(*e[1:])

    def do_lit(self, v: Any) -> Column:
        return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)

    def do_param(self, name: str) -> Column:
        v = self.b.params[name]
        return F.array(*[self.do_lit(x) for x in v]) if isinstance(v, (list, tuple)) else self.do_lit(v)

    def do_var(self, name: str) -> Column:
        if name in self.local:
            return self.local[name]
        b = self.state.vars.get(name)
        if b is None:
            raise SyntaxProblem(f"unknown variable {name}")
        if b.kind in ("node", "edge"):
            return F.struct(*[F.col(f"`{c}`").alias(p) for p, c in b.props.items()])
        if b.kind == "edges":
            return F.col(f"`{b.props['edges']}`")
        return F.col(f"`{name}`")

    def do_prop(self, e: tuple, key: str) -> Column:
        if e[0] == "var" and e[1] not in self.local:
            b = self.state.vars.get(e[1])
            if b is not None and b.kind in ("node", "edge"):
                return F.col(f"`{b.props[key]}`") if key in b.props else F.lit(None)
        base = self.column(e)
        return base.getField(key) if not isinstance(self.type_of(e), T.MapType) else F.try_element_at(base, F.lit(key))

    def do_and(self, a: tuple, b: tuple) -> Column:
        return self.column(a) & self.column(b)

    def do_or(self, a: tuple, b: tuple) -> Column:
        return self.column(a) | self.column(b)

    def do_not(self, a: tuple) -> Column:
        return ~self.column(a)

    def do_neg(self, a: tuple) -> Column:
        return -self.column(a)

    def do_isnull(self, a: tuple, no: bool) -> Column:
        return self.column(a).isNotNull() if no else self.column(a).isNull()

    def do_haslabel(self, e: tuple, labels: tuple) -> Column:
        b = self.state.vars[e[1]]
        if b.kind == "edge":
            return reduce(lambda x, y: x | y, [F.col(f"`{b.props['type']}`") == n for n in used_labels(labels)])
        return label_test(F.col(f"`{b.props['labels']}`"), labels)

    def do_typed(self, e: tuple, kind: str) -> Column:
        t, want = self.type_of(e), kind.upper()
        names = {"INTEGER": T.LongType, "INT": T.LongType, "FLOAT": T.DoubleType, "STRING": T.StringType, "BOOLEAN": T.BooleanType, "DATE": T.DateType, "LIST": T.ArrayType}
        return F.when(self.column(e).isNotNull(), F.lit(isinstance(t, names[want])))

    def do_cast(self, e: tuple, kind: str) -> Column:
        return S.try_cast(self.column(e), kind, isinstance(self.type_of(e), T.StringType))

    def do_in(self, a: tuple, b: tuple) -> Column:
        x = self.column(a)
        if b[0] == "list":
            return x.isin(*[self.column(i) for i in b[1]]) if b[1] else F.when(x.isNotNull(), F.lit(False))
        l = self.column(b)
        return F.when(x.isNull() | l.isNull(), F.lit(None)).when(F.array_contains(l, x), F.lit(True)).when(F.exists(l, lambda y: y.isNull()), F.lit(None)).otherwise(F.lit(False))

    def do_bin(self, op: str, a: tuple, b: tuple) -> Column:
        x, y = self.column(a), self.column(b)
        simple = {
            "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y, "xor": lambda: x != y,
            "starts": lambda: x.startswith(y), "ends": lambda: x.endswith(y), "contains": lambda: x.contains(y), "=~": lambda: F.rlike(x, y),
            "like": lambda: F.like(x, y), "^": lambda: F.pow(x, y), "%": lambda: F.call_function("try_mod", x, y),
            "||": lambda: F.concat(x.cast("string"), y.cast("string")) if not isinstance(self.type_of(a), T.ArrayType) else F.concat(x, y),
        }
        if op in simple:
            return simple[op]()
        ta, tb = self.type_of(a), self.type_of(b)
        text_a, text_b = isinstance(ta, T.StringType), isinstance(tb, T.StringType)
        number = lambda t: isinstance(t, (T.NumericType,))
        if op in ("=", "<>"):
            # numbers and texts that look like numbers are equal
            if text_a and number(tb):
                x, y = x.try_cast("double"), y.cast("double")
            elif text_b and number(ta):
                x, y = x.cast("double"), y.try_cast("double")
            return x == y if op == "=" else x != y
        whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
        timed = isinstance(ta, (T.DateType, T.TimestampNTZType, T.TimestampType))
        if op == "+":
            if text_a:
                return F.concat(x, y.cast("string"))
            if timed and isinstance(tb, T.StructType):
                return S.plus_duration(x, y, ta)
            if isinstance(ta, T.ArrayType):
                return F.concat(x, y if isinstance(tb, T.ArrayType) else F.array(y))
            return F.try_add(x, y)
        if op == "-":
            if timed and isinstance(tb, T.StructType):
                return S.plus_duration(x, S.negated(y), ta)
            if timed:
                return S.as_days(x, y) if isinstance(ta, T.DateType) else S.as_nanos(x, y)
            return F.try_subtract(x, y)
        if op == "*":
            return F.try_multiply(x, y)
        if whole:
            return F.when(y != 0, F.call_function("div", x, F.when(y != 0, y)))
        return F.try_divide(x, y)

    def do_list(self, items: list) -> Column:
        return F.array(*[self.column(i) for i in items])

    def do_map(self, items: dict) -> Column:
        return F.struct(*[self.column(v).alias(k) for k, v in items.items()]) if items else F.create_map()

    def do_mapproj(self, e: tuple, items: list) -> Column:
        out = []
        for i in items:
            if i[0] == "all":
                b = self.state.vars[e[1]]
                out += [F.col(f"`{c}`").alias(p) for p, c in b.props.items() if p not in ("id", "labels", "src", "dst", "type")]
            else:
                out.append(self.column(i[2]).alias(i[1]))
        return F.struct(*out)

    def do_index(self, e: tuple, i: tuple) -> Column:
        t = self.type_of(e)
        if i[0] == "lit" and isinstance(i[1], str):
            return self.do_prop(e, i[1])
        if isinstance(t, T.StringType):
            s, n = self.column(e), self.column(i)
            at = F.when(n >= 0, n).otherwise(F.char_length(s) + n)
            return F.when((at >= 0) & (at < F.char_length(s)), S.substring(s, at, F.lit(1)))
        if isinstance(t, T.MapType):
            return F.try_element_at(self.column(e), self.column(i))
        return S.list_item(self.column(e), self.column(i))

    def do_slice(self, e: tuple, low: tuple | None, high: tuple | None) -> Column:
        return S.list_slice(self.column(e), None if low is None else self.column(low), None if high is None else self.column(high))

    def do_case(self, operand: tuple | None, whens: list, other: tuple | None) -> Column:
        out = None
        for w, t in whens:
            cond = self.column(w) if operand is None else self.do_bin("=", operand, w)
            out = F.when(cond, self.column(t)) if out is None else out.when(cond, self.column(t))
        return out if other is None else out.otherwise(self.column(other))

    def do_listcomp(self, var: str, source: tuple, where: tuple | None, e: tuple | None) -> Column:
        l = self.column(source)
        if where is not None:
            l = F.filter(l, lambda x: self.inner(**{var: x}).column(where))
        return l if e is None else F.transform(l, lambda x: self.inner(**{var: x}).column(e))

    def do_quantifier(self, kind: str, var: str, source: tuple, e: tuple) -> Column:
        l = self.column(source)
        test = lambda x: self.inner(**{var: x}).column(e)
        if kind == "all":
            return F.forall(l, test)
        if kind == "single":
            return F.size(F.filter(l, test)) == 1
        return F.exists(l, test) if kind == "any" else ~F.exists(l, test)

    def do_reduce(self, acc: str, start: tuple, var: str, source: tuple, e: tuple) -> Column:
        return F.reduce(self.column(source), self.column(start), lambda a, x: self.inner(**{acc: a, var: x}).column(e))

    def do_func(self, name: str, args: list, distinct: bool) -> Column:
        if name in AGGREGATES:
            return self.aggregate(("func", name, args, distinct))
        if name in ("id", "elementid"):
            return self._entity(args[0], "id")
        if name == "labels":
            return self._entity(args[0], "labels")
        if name == "type":
            return self._entity(args[0], "type")
        if name in ("startnode", "endnode"):
            return self._entity(args[0], "src" if name == "startnode" else "dst")
        if name in ("issource", "isdestination"):
            return self._entity(args[0], "id") == self._entity(args[1], "src" if name == "issource" else "dst")
        if name == "isdirected":
            return self._entity(args[0], "id").isNotNull()
        if name == "haslabel":
            return F.array_contains(self._entity(args[0], "labels"), self.column(args[1]))
        if name in ("property_exists", "exists"):
            return (self.column(args[0]) if len(args) == 1 else self.do_prop(args[0], args[1][1])).isNotNull()
        if name in ("properties", "keys") and args[0][0] == "var" and self.state.vars.get(args[0][1], Bound("")).kind in ("node", "edge"):
            b = self.state.vars[args[0][1]]
            own = {p: c for p, c in b.props.items() if p not in ("id", "labels", "src", "dst", "type")}
            if name == "properties":
                return F.struct(*[F.col(f"`{c}`").alias(p) for p, c in own.items()])
            return F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(p)) for p, c in sorted(own.items())]))
        if name == "properties" and args[0][0] != "var":
            return self.column(args[0])  # a map is its own properties
        if name == "duration" and args[0][0] == "map":
            given = {k: self.column(v).cast("double") for k, v in args[0][1].items()}
            total = lambda units: reduce(lambda a, b: a + b, [given[u] * n for u, n in units.items() if u in given], F.lit(0.0))
            nanos = total({"hours": 3.6e12, "minutes": 6e10, "seconds": 1e9, "milliseconds": 1e6, "microseconds": 1e3, "nanoseconds": 1})
            return F.struct(
                total({"years": 12, "months": 1}).cast("long").alias("months"), total({"weeks": 7, "days": 1}).cast("long").alias("days"), nanos.cast("long").alias("nanos")
            )
        if name in ("session_user", "current_user"):
            return F.call_function("current_user")
        if name in ("current_graph", "current_schema"):
            return F.lit(getattr(self.b.graph, "name", "default"))
        if name in ("size", "length", "cardinality"):
            t = self.type_of(args[0])
            x = self.column(args[0])
            if isinstance(t, T.StructType):
                return F.size(x.edges).cast("long")
            return (F.char_length(x) if isinstance(t, T.StringType) else x if isinstance(t, T.IntegralType) else F.size(x)).cast("long")
        if name in ("nodes", "edges", "relationships"):
            return self.column(args[0]).getField("nodes" if name == "nodes" else "edges")
        if name in ("date_trunc", "truncate"):
            return S.truncate(args[0][1], self.column(args[1]), self.type_of(args[1]))
        if name == "trim" and len(args) == 3:
            return S.trimmed(self.column(args[0]), self.column(args[1]), args[2][1])
        if name == "totypedlist":
            return F.transform(self.column(args[0]), lambda x: S.try_cast(x, args[1][1]))
        if name == "coalesce" and len(args) == 2 and args[1] == ("list", []):
            kind = self.type_of(args[0])
            return F.coalesce(self.column(args[0]), F.array().cast(kind))
        if name == "round" and len(args) == 2:
            return F.round(self.column(args[0]), args[1][1])
        if name == "string_join":
            return F.call_function("array_join", self.column(args[0]), self.column(args[1]))
        if name in USER_FUNCTIONS:
            return USER_FUNCTIONS[name](*[self.column(a) for a in args])
        if name not in S.FUNCTIONS:
            raise SyntaxProblem(f"unknown function {name}")
        return S.FUNCTIONS[name](*[self.column(a) for a in args])

    def _entity(self, e: tuple, prop: str) -> Column:
        b = self.state.vars[e[1]]
        return F.col(f"`{b.props[prop]}`")

    def aggregate(self, e: tuple) -> Column:
        _, name, args, distinct = e
        if args and args[0] == ("star",):
            if self.b.times:
                return F.coalesce(F.sum(reduce(lambda a, b: a * b, [F.col(c) for c in self.b.times])), F.lit(0))
            return F.count(F.lit(1))
        columns: list[Any] = [self.column(a) for a in args]
        if args[0][0] == "var" and self.state.vars.get(args[0][1], Bound("")).kind in ("node", "edge"):
            columns[0] = self._entity(args[0], "id") if name == "count" else columns[0]
        if name in ("sum", "avg") and isinstance(self.type_of(args[0]), T.StringType):
            columns[0] = columns[0].try_cast("double")
        if name in ("group_concat", "listagg") and len(args) > 1:
            columns[1] = args[1][1]
        forms = DISTINCT if distinct else AGGREGATES
        if name not in forms:
            raise SyntaxProblem(f"{name} has no DISTINCT form")
        return forms[name](*columns)


def used_labels(e: tuple) -> list[str]:
    return [e[1]] if e[0] == "label" else [n for x in e[1:] for n in used_labels(x)]


def run(graph: PropertyGraph, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """DataFrame of a query text."""
    return Builder(graph, params or {}).run(parse(text))
