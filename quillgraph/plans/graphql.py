"""GraphQL queries and mutations over a property graph.

A root field is a node label, a nested field with a selection an edge type that is followed outwards, any other field a property. Arguments are filters: `key: value`, and
with a suffix _gt, _gte, _lt, _lte, _ne, _in, _contains, _starts_with or _ends_with; orderBy, limit/first and skip/offset order and cut. One column `result` holds a struct for
each root node; what is nested is a list of structs, made by one aggregation per edge type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph

TOKEN = re.compile(r'[\s,]+|#[^\n]*|(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<var>\$\w+)|(?P<op>\.\.\.|[{}()\[\]:!=@])')
SUFFIXES = {
    "_gte": lambda c, v: c >= v, "_gt": lambda c, v: c > v, "_lte": lambda c, v: c <= v, "_lt": lambda c, v: c < v, "_ne": lambda c, v: c != v, "_in": lambda c, v: c.isin(v),
    "_contains": lambda c, v: c.contains(v), "_starts_with": lambda c, v: c.startswith(v), "_ends_with": lambda c, v: c.endswith(v),
}
PAGING = {"limit", "first", "skip", "offset", "orderby", "order"}


class GraphqlProblem(ValueError):
    """A text that isn't a GraphQL request, or one that the graph can't answer."""


@dataclass
class Selection:
    name: str
    alias: str
    args: dict[str, Any] = field(default_factory=dict)
    fields: list[Selection] = field(default_factory=list)


class Parser:
    def __init__(self, text: str, variables: dict[str, Any]):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise GraphqlProblem(f"unexpected character at {at}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.tokens.append(("end", ""))
        self.at, self.variables, self.fragments = 0, variables, {}

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, text: str) -> bool:
        if self.tokens[self.at][1] == text and self.tokens[self.at][0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def request(self) -> tuple[str, list[Selection]]:
        found = None
        kinds = []
        while self.tokens[self.at][0] != "end":
            kind = "query"
            if self.take("fragment"):
                name = self.next()[1]
                self.take("on")
                self.next()
                self.fragments[name] = self.selections()
                continue
            if self.tokens[self.at][0] == "name":
                kind = self.next()[1]
                if self.tokens[self.at][0] == "name":
                    self.next()
                if self.take("("):
                    while not self.take(")"):
                        if self.tokens[self.at][0] == "var" and self.tokens[self.at + 1][1] == ":":
                            var = self.next()[1][1:]
                            self.next()
                            while self.tokens[self.at][0] in ("name",) or self.tokens[self.at][1] in ("[", "]", "!"):
                                self.next()
                            if self.take("="):
                                self.variables.setdefault(var, self.value())
                        else:
                            self.next()
            kinds.append(kind)
            found = (kind, self.selections())
        if found is None:
            raise GraphqlProblem("an empty request")
        if found[0] == "subscription":
            raise GraphqlProblem("subscriptions aren't supported")
        return found

    def selections(self) -> list[Selection]:
        if not self.take("{"):
            raise GraphqlProblem("a selection is asked for")
        out: list[Selection] = []
        while not self.take("}"):
            if self.take("..."):
                if self.take("on"):
                    self.next()
                    out += self.selections()
                else:
                    out.append(Selection("...", self.next()[1]))
                continue
            kind, name = self.next()
            if kind != "name":
                raise GraphqlProblem(f"unexpected {name or 'end'}")
            alias = name
            if self.take(":"):
                name = self.next()[1]
            args = {}
            if self.take("("):
                while not self.take(")"):
                    key = self.next()[1]
                    self.take(":")
                    args[key] = self.value()
            out.append(Selection(name, alias, args, self.selections() if self.tokens[self.at][1] == "{" else []))
        return out

    def value(self) -> Any:
        kind, text = self.next()
        if kind == "str":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
        if kind == "num":
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "var":
            return self.variables.get(text[1:])
        if text == "[":
            out = []
            while not self.take("]"):
                out.append(self.value())
            return out
        if text == "{":
            made = {}
            while not self.take("}"):
                key = self.next()[1]
                self.take(":")
                made[key] = self.value()
            return made
        return {"true": True, "false": False, "null": None}.get(text, text)


def spread(fields: list[Selection], fragments: dict[str, list[Selection]]) -> list[Selection]:
    out = []
    for f in fields:
        if f.name == "...":
            if f.alias not in fragments:
                raise GraphqlProblem(f"unknown fragment {f.alias}")
            out += spread(fragments[f.alias], fragments)
        else:
            out.append(Selection(f.name, f.alias, f.args, spread(f.fields, fragments)))
    return out


def condition(columns: list[str], key: str, value: Any) -> Column:
    if key in columns:
        return F.col(key).isNull() if value is None else F.col(key) == value
    for suffix, test in SUFFIXES.items():
        if key.endswith(suffix) and key[: -len(suffix)] in columns:
            return test(F.col(key[: -len(suffix)]), value)
    raise GraphqlProblem(f"no property {key}")


def _label(graph: PropertyGraph, name: str) -> str:
    low = name.lower()
    for label in graph.nodes:
        if label.lower() in (low, low.removesuffix("s")):
            return label
    raise GraphqlProblem(f"no label {name}")


def _filtered(df: DataFrame, args: dict[str, Any]) -> DataFrame:
    given = {**{k: v for k, v in args.items() if k not in ("filter", "where")}, **(args.get("filter") or {}), **(args.get("where") or {})}
    for key, value in given.items():
        if key.lower() not in PAGING:
            df = df.where(condition(df.columns, key, value))
    return df


def _order(args: dict[str, Any]) -> list[tuple[str, bool]]:
    """(property, whether it falls) of orderBy."""
    low = {k.lower(): v for k, v in args.items()}
    order = low.get("orderby", low.get("order"))
    pairs = order.items() if isinstance(order, dict) else [(order, "ASC")] if order else []
    return [(k, str(d).upper() == "DESC") for k, d in pairs]


def _paged(df: DataFrame, args: dict[str, Any]) -> DataFrame:
    low = {k.lower(): v for k, v in args.items()}
    if _order(args):
        df = df.orderBy(*[F.col(k).desc() if down else F.col(k) for k, down in _order(args)])
    if low.get("skip", low.get("offset")):
        df = df.offset(low.get("skip", low.get("offset")))
    n = low.get("limit", low.get("first"))
    return df if n is None else df.limit(n)


def _resolved(graph: PropertyGraph, df: DataFrame, fields: list[Selection], keep: list[str] | None = None) -> DataFrame:
    """(id, result): a struct of the fields of each node of df; with columns of df to keep, under names _o0, _o1, ..."""
    kept = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(keep or [])]
    made: dict[str, Column] = {}
    for f in fields:
        if not f.fields:
            if f.name == "__typename":
                made[f.alias] = F.get("labels", F.lit(0))
            else:
                made[f.alias] = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string")
            continue
        types = [t for t in graph.edges if t.lower() == f.name.lower()]
        if not types:
            raise GraphqlProblem(f"no edge type {f.name}")
        edges = graph.edge_scan(types).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
        wanted = {x.name for x in f.fields if not x.fields} | {k for k in f.args}
        ends = graph.ends.get(types[0])
        label = [ends[1]] if ends else [n for n, t in graph.nodes.items() if any(w in t.columns or any(w.endswith(s) and w[: -len(s)] in t.columns for s in SUFFIXES) for w in wanted)] or list(graph.nodes)
        targets = graph.node_scan(("label", label[0])) if len(label) == 1 else graph.node_scan(None)
        inner = _resolved(graph, _filtered(targets, f.args), f.fields).withColumnRenamed("id", "_dst").withColumnRenamed("result", "_item")
        low = {k.lower(): v for k, v in f.args.items()}
        listed = edges.join(inner, "_dst").groupBy("_src").agg(F.sort_array(F.collect_list("_item")).alias(f"_n_{f.alias}"))
        df = df.join(listed, F.col("id") == F.col("_src"), "left").drop("_src")
        items = F.coalesce(F.col(f"_n_{f.alias}"), F.array().cast(listed.schema[f"_n_{f.alias}"].dataType))
        first, n = low.get("skip", low.get("offset", 0)), low.get("limit", low.get("first"))
        made[f.alias] = items if n is None and not first else F.slice(items, first + 1, n if n is not None else 2**30)
    return df.select("id", F.struct(*[c.alias(a) for a, c in made.items()]).alias("result"), *kept)


def query(graph: PropertyGraph, text: str, variables: dict[str, Any] | None = None) -> DataFrame:
    """(field, result as JSON) for each node of each root field; a request with one root field has its fields as columns."""
    parser = Parser(text, dict(variables or {}))
    kind, fields = parser.request()
    if kind == "mutation":
        raise GraphqlProblem("a mutation changes the graph: use mutate()")
    roots = []
    for f in spread(fields, parser.fragments):
        nodes = _filtered(graph.node_scan(("label", _label(graph, f.name))), f.args)
        order = _order(f.args)
        found = _resolved(graph, _paged(nodes, f.args), f.fields, [k for k, _ in order])
        if order:  # joins of what is nested don't keep the order
            found = found.orderBy(*[F.col(f"_o{i}").desc() if down else F.col(f"_o{i}") for i, (_, down) in enumerate(order)])
        roots.append((f, found))
    if len(roots) == 1:
        return roots[0][1].select("result.*")
    out = None
    for f, df in roots:
        part = df.select(F.lit(f.alias).alias("field"), F.to_json("result").alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


def mutate(graph: PropertyGraph, text: str, variables: dict[str, Any] | None = None) -> PropertyGraph:
    """The graph after mutations createLabel(props), updateLabel(id, props) and deleteLabel(id), in their order."""
    parser = Parser(text, dict(variables or {}))
    kind, fields = parser.request()
    if kind != "mutation":
        raise GraphqlProblem("not a mutation")
    for f in fields:
        m = re.match(r"(create|update|delete)(\w+)$", f.name)
        if not m:
            raise GraphqlProblem(f"unknown mutation {f.name}")
        verb, args = m[1], {**{k: v for k, v in f.args.items() if k not in ("input", "data")}, **(f.args.get("input") or {}), **(f.args.get("data") or {})}
        label = m[2] if verb == "create" else _label(graph, m[2])
        if verb == "create":
            props = ", ".join(f"{k}: ${k}" for k in args)
            graph = graph.execute(f"CREATE (n:{label} {{{props}}})", **args).graph
        else:
            if "id" not in args:
                raise GraphqlProblem(f"{f.name} needs an id")
            change = "DETACH DELETE n" if verb == "delete" else "SET " + ", ".join(f"n.{k} = ${k}" for k in args if k != "id")
            graph = graph.execute(f"MATCH (n:{label}) WHERE id(n) = $id {change}", **args).graph
    return graph
