"""Gremlin traversals over a property graph.

A traverser is a row: its element or value, what `as` has named, and the ids of its path. Steps are joins, filters and aggregations of these rows; a traversal inside a step
is run for the distinct places it starts from and joined back. The result has one column `value`, or the columns of a final project or select.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import EDGE_KEYS, NODE_KEYS, PropertyGraph

TOKEN = re.compile(r"""\s+|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[lLdDfF]?|(?P<name>[A-Za-z_]\w*)|(?P<op>[().,\[\]])""")
PREDICATES = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "within": lambda c, *v: c.isin(*v), "without": lambda c, *v: ~c.isin(*v), "between": lambda c, a, b: (c >= a) & (c < b), "inside": lambda c, a, b: (c > a) & (c < b),
    "outside": lambda c, a, b: (c < a) | (c > b), "containing": lambda c, v: c.contains(v), "startingWith": lambda c, v: c.startswith(v),
    "endingWith": lambda c, v: c.endswith(v), "notContaining": lambda c, v: ~c.contains(v), "regex": lambda c, v: c.rlike(v),
}


class GremlinProblem(ValueError):
    """A text that isn't a traversal, or a step that isn't supported."""


@dataclass
class Predicate:
    name: str
    args: list

    def test(self, c: Column) -> Column:
        return PREDICATES[self.name](c, *self.args)


@dataclass
class Steps:
    """A traversal: (name, arguments) one after the other."""

    steps: list[tuple[str, list]]


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise GremlinProblem(f"unexpected character at {at}: {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def traversal(self) -> Steps:
        if self.peek() in ("g", "__"):
            self.at += 1
            self.need(".")
        out = [self.step()]
        while self.peek() == ".":
            self.at += 1
            out.append(self.step())
        return Steps(out)

    def need(self, text: str) -> None:
        if self.peek() != text:
            raise GremlinProblem(f"expected {text}, found {self.peek() or 'the end'}")
        self.at += 1

    def step(self) -> tuple[str, list]:
        kind, name = self.tokens[self.at]
        if kind != "name":
            raise GremlinProblem(f"expected a step, found {name or 'the end'}")
        self.at += 1
        self.need("(")
        args = []
        while self.peek() != ")":
            args.append(self.argument())
            if self.peek() == ",":
                self.at += 1
        self.need(")")
        return name, args

    def argument(self) -> Any:
        kind, text = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "num":
            self.at += 1
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if text == "[":
            self.at += 1
            out = []
            while self.peek() != "]":
                out.append(self.argument())
                if self.peek() == ",":
                    self.at += 1
            self.need("]")
            return out
        if text in ("true", "false"):
            self.at += 1
            return text == "true"
        name = text
        if name in ("P", "TextP", "Order", "T", "Scope") and self.peek(1) == ".":
            self.at += 2
            name = self.peek()
        if name in PREDICATES and self.peek(1) == "(":
            self.at += 2
            args = []
            while self.peek() != ")":
                args.append(self.argument())
                if self.peek() == ",":
                    self.at += 1
            self.need(")")
            return Predicate(name, args[0] if len(args) == 1 and isinstance(args[0], list) else args)
        if name in ("asc", "desc", "incr", "decr", "id", "label", "local", "shuffle") and self.peek(1) != "(":
            self.at += 1
            return ("token", {"incr": "asc", "decr": "desc"}.get(name, name))
        return self.traversal()


@dataclass
class Walk:
    """Traversers: the column _v (id of a node or edge, or a value), kind ('node', 'edge', 'value'), label expression of the nodes if known, tags and their kinds."""

    df: DataFrame
    kind: str
    tags: dict[str, tuple[str, str]] = field(default_factory=dict)  # name -> (column, kind)
    labels: tuple | None = None
    types: tuple[str, ...] | None = None
    columns: list[str] = field(default_factory=list)  # of a final project or select

    def but(self, df: DataFrame, **changes: Any) -> Walk:
        return Walk(**{**vars(self), "df": df, **changes})


class Runner:
    def __init__(self, graph: PropertyGraph):
        self.g, self.n, self.stored = graph, 0, {}

    def fresh(self, stem: str) -> str:
        self.n += 1
        return f"_{stem}{self.n}"

    def elements(self, w: Walk) -> DataFrame:
        return self.g.node_scan(w.labels) if w.kind == "node" else self.g.edge_scan(list(w.types or []))

    def with_props(self, w: Walk, names: list[str] | None = None) -> tuple[Walk, dict[str, str]]:
        """The walk with properties (all, or those named) of its elements in columns of their own."""
        table = self.elements(w)
        fixed = NODE_KEYS if w.kind == "node" else EDGE_KEYS
        wanted = [c for c in table.columns if (c in names if names is not None else c not in fixed)]
        own = {c: self.fresh("p") for c in wanted}
        id_ = self.fresh("id")
        df = w.df.join(table.select(F.col("id").alias(id_), *[F.col(f"`{c}`").alias(n) for c, n in own.items()]), F.col("_v") == F.col(id_)).drop(id_)
        return w.but(df), own

    def run(self, steps: Steps, w: Walk | None = None) -> Walk:
        todo = list(steps.steps)
        while todo:
            name, args = todo.pop(0)
            bys = []
            while todo and todo[0][0] == "by":
                bys.append(todo.pop(0)[1])
            if name in ("addE",):
                raise GremlinProblem("a traversal that changes the graph: use mutate()")
            f = getattr(self, "do_" + name.rstrip("_"), None)
            if f is None:
                raise GremlinProblem(f"unknown step {name}")
            w = f(w, args, bys)
        return w

    # -- starts and moves
    def do_V(self, w: Walk | None, args: list, bys: list) -> Walk:
        ids = args[0] if args and isinstance(args[0], list) else args
        nodes = self.g.node_scan(None).select(F.col("id").alias("_v"))
        nodes = nodes.where(F.col("_v").isin(*ids)) if ids else nodes
        return Walk(nodes.withColumn("_path", F.array("_v")), "node")

    def do_E(self, w: Walk | None, args: list, bys: list) -> Walk:
        edges = self.g.edge_scan([]).select(F.col("id").alias("_v"))
        edges = edges.where(F.col("_v").isin(*args)) if args else edges
        return Walk(edges.withColumn("_path", F.array("_v")), "edge")

    def hop(self, w: Walk, types: list, direction: str, to_edge: bool) -> Walk:
        e = self.g.edge_scan(types)
        a, b, i = self.fresh("a"), self.fresh("b"), self.fresh("e")
        ahead = e.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("id").alias(i))
        back = e.select(F.col("dst").alias(a), F.col("src").alias(b), F.col("id").alias(i))
        table = {"out": ahead, "in": back, "both": ahead.unionByName(back)}[direction]
        df = w.df.join(table, F.col("_v") == F.col(a)).drop("_v", a, *(["_from"] if "_from" in w.df.columns else []))
        if to_edge:
            df = df.withColumnRenamed(i, "_v").withColumnRenamed(b, "_other").withColumn("_path", F.concat("_path", F.array("_v")))
            return w.but(df, kind="edge", labels=None, types=tuple(types))
        df = df.drop(i).withColumnRenamed(b, "_v").withColumn("_path", F.concat("_path", F.array("_v")))
        ends = {self.g.ends.get(t) for t in self.g.edges if not types or t.lower() in {x.lower() for x in types}}
        side = {"out": 1, "in": 0}.get(direction)
        known = ends.pop() if len(ends) == 1 else None
        return w.but(df.drop("_other"), kind="node", labels=("label", known[side]) if known and side is not None else None, types=None)

    def do_out(self, w, args, bys):
        return self.hop(w, args, "out", False)

    def do_in(self, w, args, bys):
        return self.hop(w, args, "in", False)

    def do_both(self, w, args, bys):
        return self.hop(w, args, "both", False)

    def do_outE(self, w, args, bys):
        return self.hop(w, args, "out", True)

    def do_inE(self, w, args, bys):
        return self.hop(w, args, "in", True)

    def do_bothE(self, w, args, bys):
        return self.hop(w, args, "both", True)

    def end_of(self, w: Walk, c: Column) -> Walk:
        e = self.g.edge_scan(list(w.types or [])).select(F.col("id").alias("_i"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
        df = w.df.join(e, F.col("_v") == F.col("_i")).withColumn("_v", c).drop("_i", "_s", "_d", "_other")
        return w.but(df.withColumn("_path", F.concat("_path", F.array("_v"))), kind="node", labels=None, types=None)

    def do_outV(self, w, args, bys):
        return self.end_of(w, F.col("_s"))

    def do_inV(self, w, args, bys):
        return self.end_of(w, F.col("_d"))

    def do_bothV(self, w, args, bys):
        return self.end_of(w, F.explode(F.array("_s", "_d")))

    def do_otherV(self, w, args, bys):
        df = w.df.withColumn("_v", F.col("_other")).drop("_other")
        return w.but(df.withColumn("_path", F.concat("_path", F.array("_v"))), kind="node", labels=None, types=None)

    # -- filters
    def do_hasLabel(self, w, args, bys):
        if w.kind == "edge":
            ids = self.g.edge_scan(args).select(F.col("id").alias("_i"))
            return w.but(w.df.join(ids, F.col("_v") == F.col("_i"), "left_semi"), types=tuple(args))
        labels = reduce(lambda a, b: ("or", a, b), [("label", x) for x in args])
        labels = labels if w.labels is None else ("and", w.labels, labels)
        ids = self.g.node_scan(labels).select(F.col("id").alias("_i"))
        return w.but(w.df.join(ids, F.col("_v") == F.col("_i"), "left_semi"), labels=labels)

    def do_hasId(self, w, args, bys):
        return w.but(w.df.where(F.col("_v").isin(*(args[0] if isinstance(args[0], list) else args))))

    def do_has(self, w, args, bys):
        if len(args) == 3:
            return self.do_has(self.do_hasLabel(w, args[:1], []), args[1:], [])
        key = args[0][1] if isinstance(args[0], tuple) else args[0]
        if key == "label" and isinstance(args[0], tuple):
            return self.do_hasLabel(w, [args[1]], [])
        if key == "id" and isinstance(args[0], tuple):
            return w.but(w.df.where(self.matches(F.col("_v"), args[1])))
        if len(args) == 2 and isinstance(args[1], Steps):
            found, own = self.with_props(w, [key])
            inner = found.but(found.df.withColumn("_w", F.col("_v")).withColumn("_v", F.col(own[key])) if key in own else found.df.limit(0), kind="value")
            return w.but(self.run(args[1], inner).df.withColumn("_v", F.col("_w")).drop("_w", *own.values()))
        found, own = self.with_props(w, [key])
        if key not in own:
            return w.but(w.df.limit(0))
        test = F.col(own[key]).isNotNull() if len(args) == 1 else self.matches(F.col(own[key]), args[1])
        return w.but(found.df.where(test).drop(*own.values()))

    def do_hasNot(self, w, args, bys):
        found, own = self.with_props(w, [args[0]])
        return w.but(found.df.where(F.col(own[args[0]]).isNull()).drop(*own.values())) if own else w

    def matches(self, c: Column, x: Any) -> Column:
        return x.test(c) if isinstance(x, Predicate) else c.isin(*x) if isinstance(x, list) else c == x

    def do_is(self, w, args, bys):
        return w.but(w.df.where(self.matches(F.col("_v"), args[0])))

    def starts(self, w: Walk, steps: Steps) -> tuple[DataFrame, str]:
        """Places from which a traversal finds something, in a column of its own."""
        at = self.fresh("at")
        extra = [c for c, _ in w.tags.values()]
        inner = w.but(w.df.select("_v", *extra).distinct().withColumn(at, F.col("_v")).withColumn("_path", F.array("_v") if w.kind != "value" else F.array().cast("array<bigint>")))
        return self.run(steps, inner).df.select(at).distinct(), at

    def kept(self, w: Walk, steps: Steps, how: str) -> Walk:
        found, at = self.starts(w, steps)
        return w.but(w.df.join(found, F.col("_v").eqNullSafe(F.col(at)), how))

    def do_where(self, w, args, bys):
        if len(args) == 1 and isinstance(args[0], Predicate):  # where(neq('a'))
            column, _ = w.tags[args[0].args[0]]
            return w.but(w.df.where(PREDICATES[args[0].name](F.col("_v"), F.col(column))))
        if len(args) == 2:
            left, right = w.tags[args[0]][0], w.tags[args[1].args[0]][0]
            return w.but(w.df.where(PREDICATES[args[1].name](F.col(left), F.col(right))))
        return self.kept(w, args[0], "left_semi")

    def do_filter(self, w, args, bys):
        return self.do_where(w, args, bys)

    def do_not(self, w, args, bys):
        return self.kept(w, args[0], "left_anti")

    def do_and(self, w, args, bys):
        return reduce(lambda x, s: self.kept(x, s, "left_semi"), args, w)

    def do_or(self, w, args, bys):
        found = reduce(lambda a, b: a.unionByName(b), [f.withColumnRenamed(at, "_at") for f, at in (self.starts(w, s) for s in args)])
        return w.but(w.df.join(found.distinct(), F.col("_v").eqNullSafe(F.col("_at")), "left_semi"))

    def do_dedup(self, w, args, bys):
        keys = [w.tags[a][0] for a in args] if args else ["_v"]
        if bys:
            w2, c = self.by(w, bys[0])
            return w.but(w2.df.withColumn("_key", c).dropDuplicates(["_key"]).drop("_key"))
        return w.but(w.df.dropDuplicates(keys))

    def do_limit(self, w, args, bys):
        return w.but(w.df.limit(args[-1]))

    def do_skip(self, w, args, bys):
        return w.but(w.df.offset(args[-1]))

    def do_range(self, w, args, bys):
        low, high = args[-2:]
        df = w.df.offset(low)
        return w.but(df if high < 0 else df.limit(high - low))

    # -- values
    def value(self, w: Walk, c: Column, drop: list[str]) -> Walk:
        keep = [x for x in w.df.columns if x not in ("_v", "_other", *drop)]
        return w.but(w.df.select(c.alias("_v"), *[F.col(f"`{x}`") for x in keep]), kind="value", labels=None, types=None)

    def do_values(self, w, args, bys):
        found, own = self.with_props(w, args or None)
        if not own:
            return self.value(w, F.lit(None).cast("string"), []).but(w.df.select(F.lit(None).cast("string").alias("_v"), "_path").limit(0))
        if len(own) == 1:
            out = self.value(found, F.col(next(iter(own.values()))), list(own.values()))
        else:
            out = self.value(found, F.explode(F.array(*[F.col(c).cast("string") for c in own.values()])), list(own.values()))
        return out.but(out.df.where("_v IS NOT NULL"))

    def do_properties(self, w, args, bys):
        found, own = self.with_props(w, args or None)
        entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in own.items()])
        out = self.value(found, F.explode(entries), list(own.values()))
        return out.but(out.df.where("_v.value IS NOT NULL"))

    def do_valueMap(self, w, args, bys):
        found, own = self.with_props(w, [a for a in args if isinstance(a, str)] or None)
        return self.value(found, F.struct(*[F.col(c).alias(k) for k, c in own.items()]), list(own.values()))

    def do_elementMap(self, w, args, bys):
        found, own = self.with_props(w, [*(args or [c for c in self.elements(w).columns if c not in (*NODE_KEYS, *EDGE_KEYS)]), "labels", "type"])
        name = F.get(own["labels"], F.lit(0)) if "labels" in own else F.col(own["type"])
        props = [F.col(c).alias(k) for k, c in own.items() if k not in ("labels", "type")]
        return self.value(found, F.struct(F.col("_v").alias("id"), name.alias("label"), *props), list(own.values()))

    def do_id(self, w, args, bys):
        return self.value(w, F.col("_v"), [])

    def do_label(self, w, args, bys):
        found, own = self.with_props(w, ["labels" if w.kind == "node" else "type"])
        c = F.col(next(iter(own.values())))
        return self.value(found, F.get(c, F.lit(0)) if w.kind == "node" else c, list(own.values()))

    def do_constant(self, w, args, bys):
        return self.value(w, F.lit(args[0]), [])

    def do_path(self, w, args, bys):
        return self.value(w, F.col("_path"), [])

    # -- aggregates: one traverser comes out
    def one(self, w: Walk, c: Column) -> Walk:
        return Walk(w.df.agg(c.alias("_v")).withColumn("_path", F.array().cast("array<bigint>")), "value")

    def do_count(self, w, args, bys):
        return self.one(w, F.count(F.lit(1)))

    def do_sum(self, w, args, bys):
        return self.one(w, F.sum("_v"))

    def do_mean(self, w, args, bys):
        return self.one(w, F.avg("_v"))

    def do_min(self, w, args, bys):
        return self.one(w, F.min("_v"))

    def do_max(self, w, args, bys):
        return self.one(w, F.max("_v"))

    def do_fold(self, w, args, bys):
        return self.one(w, F.sort_array(F.collect_list("_v")))

    def do_unfold(self, w, args, bys):
        kind = w.df.schema["_v"].dataType.simpleString()
        if kind.startswith("map"):
            df = w.df.select(F.explode(F.map_entries("_v")).alias("_v"), *[c for c in w.df.columns if c != "_v"])
        else:
            df = w.df.withColumn("_v", F.explode("_v")) if kind.startswith("array") else w.df
        return w.but(df)

    def by(self, w: Walk, args: list) -> tuple[Walk, Column]:
        """Column of a by(): a property, id, label, a traversal of one value, or the element itself."""
        what = [a for a in args if not (isinstance(a, tuple) and a[1] in ("asc", "desc", "shuffle", "local"))]
        if not what:
            return w, F.col("_v")
        if isinstance(what[0], tuple):
            if what[0][1] == "id":
                return w, F.col("_v")
            found, own = self.with_props(w, ["labels" if w.kind == "node" else "type"])
            c = F.col(next(iter(own.values())))
            return found, F.get(c, F.lit(0)) if w.kind == "node" else c
        if isinstance(what[0], str):
            if w.kind == "value":
                return w, F.col("_v").getField(what[0])
            found, own = self.with_props(w, [what[0]])
            return found, F.col(own[what[0]]) if own else F.lit(None)
        at, out = self.fresh("at"), self.fresh("by")
        # Values per start: aggregates inside are made for each start.
        inner = w.but(w.df.select("_v").distinct().withColumn(at, F.col("_v")).withColumn("_path", F.array("_v")))
        found = Local(self.g, at).run(what[0], inner).df.groupBy(at).agg(F.min("_v").alias(out))
        if what[0].steps[-1][0] == "count":
            df = w.df.join(found, F.col("_v").eqNullSafe(F.col(at)), "left").drop(at).fillna(0, [out])
        else:
            df = w.df.join(found, F.col("_v").eqNullSafe(F.col(at)), "left").drop(at)
        return w.but(df), F.col(out)

    def do_groupCount(self, w, args, bys):
        w, c = self.by(w, bys[0] if bys else [])
        return Walk(w.df.groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("value")), "value", columns=["key", "value"])

    def do_group(self, w, args, bys):
        w, key = self.by(w, bys[0] if bys else [])
        if len(bys) < 2:
            agg = F.sort_array(F.collect_list("_v"))
        elif isinstance(bys[1][0], Steps) and bys[1][0].steps[-1][0] in REDUCERS:
            last = bys[1][0].steps[-1][0]
            if len(bys[1][0].steps) > 1:
                w, value = self.by(w, [Steps(bys[1][0].steps[:-1])]) if bys[1][0].steps[0][0] != "values" or len(bys[1][0].steps) > 2 else self.by(w, [bys[1][0].steps[0][1][0]])
            else:
                value = F.col("_v")
            agg = REDUCERS[last](value)
        else:
            w, value = self.by(w, bys[1])
            agg = F.sort_array(F.collect_list(value))
        return Walk(w.df.groupBy(key.alias("key")).agg(agg.alias("value")), "value", columns=["key", "value"])

    def do_order(self, w, args, bys):
        keys, drop = [], []
        for b in bys or [[]]:
            before = set(w.df.columns)
            w, c = self.by(w, b)
            down = any(isinstance(a, tuple) and a[1] == "desc" for a in b)
            if any(isinstance(a, tuple) and a[1] == "shuffle" for a in b):
                c = F.rand()
            keys.append(c.desc() if down else c.asc())
            drop += [x for x in w.df.columns if x not in before]
        return w.but(w.df.orderBy(*keys).drop(*drop))

    # -- tags and records
    def do_as(self, w, args, bys):
        column = self.fresh("tag")
        return w.but(w.df.withColumn(column, F.col("_v")), tags={**w.tags, **{a: (column, w.kind) for a in args}})

    def do_select(self, w, args, bys):
        if len(args) == 1 and args[0] in w.tags:
            column, kind = w.tags[args[0]]
            out = w.but(w.df.withColumn("_v", F.col(column)), kind=kind, labels=None, types=None)
            if bys:
                out, c = self.by(out, bys[0])
                return self.value(out, c, [])
            return out
        made = []
        for i, name in enumerate(args):
            column, kind = w.tags[name]
            if bys:
                side, c = self.by(w.but(w.df.withColumn("_keep", F.col("_v")).withColumn("_v", F.col(column)), kind=kind, labels=None, types=None), bys[i % len(bys)])
                out = self.fresh("s")
                w = w.but(side.df.withColumn(out, c).withColumn("_v", F.col("_keep")).drop("_keep"))
                made.append((name, out))
            else:
                made.append((name, column))
        return Walk(w.df.select(*[F.col(c).alias(n) for n, c in made]), "value", columns=args)

    def do_project(self, w, args, bys):
        made = []
        for i, name in enumerate(args):
            w, c = self.by(w, bys[i % len(bys)] if bys else [])
            out = self.fresh("s")
            w = w.but(w.df.withColumn(out, c))
            made.append((name, out))
        return Walk(w.df.select(*[F.col(c).alias(n) for n, c in made]), "value", columns=args)

    # -- branches
    def branch(self, w: Walk, steps: Steps) -> Walk:
        return self.run(steps, w)

    def stacked(self, w: Walk, found: list[Walk]) -> Walk:
        kinds = {f.kind for f in found}
        keep = [c for c in found[0].df.columns if all(c in f.df.columns for f in found)]
        df = reduce(lambda a, b: a.unionByName(b), [f.df.select(*keep) for f in found])
        return Walk(df, kinds.pop() if len(kinds) == 1 else "value", dict(w.tags))

    def do_union(self, w, args, bys):
        return self.stacked(w, [self.branch(w, s) for s in args])

    def do_optional(self, w, args, bys):
        return self.stacked(w, [self.branch(w, args[0]), self.kept(w, args[0], "left_anti")])

    def do_coalesce(self, w, args, bys):
        found, rest = [], w
        for s in args:
            found.append(self.branch(rest, s))
            rest = self.kept(rest, s, "left_anti")
        return self.stacked(w, found)

    def do_choose(self, w, args, bys):
        yes, no = self.kept(w, args[0], "left_semi"), self.kept(w, args[0], "left_anti")
        return self.stacked(w, [self.branch(yes, args[1]), self.branch(no, args[2]) if len(args) > 2 else no])

    def do_repeat(self, w, args, bys):
        raise GremlinProblem("repeat needs times: use path patterns")

    def do_sideEffect(self, w, args, bys):
        return w

    def do_aggregate(self, w, args, bys):
        self.stored[args[0]] = w.df.select(F.col("_v"))
        return w

    def do_store(self, w, args, bys):
        return self.do_aggregate(w, args, bys)

    def do_cap(self, w, args, bys):
        return Walk(self.stored[args[0]].agg(F.sort_array(F.collect_list("_v")).alias("_v")).withColumn("_path", F.array().cast("array<bigint>")), "value")

    def do_identity(self, w, args, bys):
        return w


REDUCERS = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "fold": lambda c: F.sort_array(F.collect_list(c))}


class Local(Runner):
    """A traversal inside by(): aggregates are made for each start `at`."""

    def __init__(self, graph: PropertyGraph, at: str):
        super().__init__(graph)
        self.at = at

    def fresh(self, stem: str) -> str:
        return super().fresh(f"{self.at}_{stem}")

    def one(self, w: Walk, c: Column) -> Walk:
        return Walk(w.df.groupBy(self.at).agg(c.alias("_v")).withColumn("_path", F.array().cast("array<bigint>")), "value")


def query(graph: PropertyGraph, text: str) -> DataFrame:
    """Rows of a traversal g.V()... or g.E()...: `value`, or the columns of a last project, select, group or groupCount."""
    parser = Parser(text.strip().rstrip(";"))
    steps = parser.traversal()
    if parser.peek():
        raise GremlinProblem(f"unexpected {parser.peek()}")
    if steps.steps[-1][0] in ("toList", "next", "iterate"):
        steps.steps.pop()
    w = Runner(graph).run(steps)
    return w.df.select(*w.columns) if w.columns else w.df.select(F.col("_v").alias("value"))


def mutate(graph: PropertyGraph, text: str) -> PropertyGraph:
    """The graph after addV('L').property(k, v).., addE('T').from(id).to(id).property(..), ..property(k, v) or ..drop()."""
    steps = Parser(text.strip().rstrip(";")).traversal().steps
    tail = [s for s in steps if s[0] == "property"]
    props = {a[-2]: a[-1] for _, a in tail}
    listed = ", ".join(f"{k}: ${k}" for k in props)
    if steps[0][0] == "addV":
        return graph.execute(f"CREATE (n:{steps[0][1][0]} {{{listed}}})", **props).graph
    made = next((s for s in steps if s[0] == "addE"), None)
    if made:
        ends = {n: a[0] for n, a in steps if n in ("from", "from_", "to")}
        start = [s for s in steps[: steps.index(made)]]
        source = ends.get("from", ends.get("from_", Steps(start) if start else None))
        ids = {k: _one_id(graph, x) for k, x in (("a", source), ("b", ends.get("to")))}
        return graph.execute(f"MATCH (x), (y) WHERE id(x) = $_a AND id(y) = $_b CREATE (x)-[:{made[1][0]} {{{listed}}}]->(y)", _a=ids["a"], _b=ids["b"], **props).graph
    head = Steps([s for s in steps if s[0] not in ("property", "drop", "iterate")])
    w = Runner(graph).run(head)
    ids = w.df.select(F.col("_v").alias("id")).distinct()
    tables = graph.nodes if w.kind == "node" else graph.edges
    if any(s[0] == "drop" for s in steps):
        nodes = {n: df.join(ids, "id", "left_anti") for n, df in graph.nodes.items()} if w.kind == "node" else dict(graph.nodes)
        if w.kind == "edge":
            return graph.with_tables(nodes, {t: df.join(ids, "id", "left_anti") for t, df in graph.edges.items()})
        edges = {t: df.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*df.columns) for t, df in graph.edges.items()}
        return graph.with_tables(nodes, edges)
    hit = ids.withColumn("_hit", F.lit(True))
    changed = {}
    for name, df in tables.items():
        joined = df.join(hit, "id", "left")
        for k, v in props.items():
            joined = joined.withColumn(k, F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(k) if k in df.columns else F.lit(None)))
        changed[name] = joined.drop("_hit").select(*df.columns, *[k for k in props if k not in df.columns])
    return graph.with_tables(changed) if w.kind == "node" else graph.with_tables(None, changed)


def _one_id(graph: PropertyGraph, x: Any) -> int:
    if isinstance(x, int):
        return x
    found = Runner(graph).run(x).df.select("_v").limit(2).collect()
    if len(found) != 1:
        raise GremlinProblem("an end of an edge must be one node")
    return found[0][0]
