"""SPARQL 1.1 over a table of triples.

A term is a struct (v: text, t: 'iri', 'bnode', 'literal' or a datatype, l: language or null). A solution is a row with a column for each variable; an unbound
variable is null. Basic patterns become equi-joins of filtered scans, so Catalyst orders and prunes them. Variables that are bound in all rows of both sides are join
keys; those that may be unbound (after OPTIONAL or UNION) are compatible if equal or null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import Rounds

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<var>[?$]\w+)
    |(?P<num>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:\w+)
    |(?P<pname>[A-Za-z][\w.-]*?:[\w.%-]*|:[\w.%-]*)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[-{}()\[\].;,*/|^!?+=<>])""",
    re.VERBOSE | re.DOTALL,
)
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
TERM = "struct<v:string,t:string,l:string>"
TRIPLE_SCHEMA = "s string, p string, o string, o_type string, o_lang string, g string"
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
#: Column of the hops of a path, for which no variable can stand.
ENDS = ("_from", "_to")


class SparqlProblem(ValueError):
    """A text that isn't SPARQL, or a form that isn't supported."""


@dataclass
class Rows:
    """Solutions: kinds tells 'term' columns from native 'value' ones; maybe holds the variables that can be unbound."""

    df: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)


def term(v: Column, t: Column | str, l: Column | None = None) -> Column:
    return F.struct(v.alias("v"), (F.lit(t) if isinstance(t, str) else t).alias("t"), (l if l is not None else F.lit(None).cast("string")).alias("l"))


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlProblem(f"unexpected character at {at}: {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.tokens.append(("end", ""))
        self.at, self.prefixes, self.base, self.fresh = 0, {}, "", 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def word(self, *words: str) -> bool:
        if self.kind() == "name" and self.peek().upper() in words:
            self.at += 1
            return True
        return False

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        return self.kind(ahead) == "name" and self.peek(ahead).upper() in words

    def take(self, *ops: str) -> str | None:
        if self.kind() == "op" and self.peek() in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not (self.take(text) or self.word(text)):
            raise SparqlProblem(f"expected {text}, found {self.peek() or 'the end'}")

    def new_var(self) -> str:
        self.fresh += 1
        return f"_b{self.fresh}"

    # -- statements
    def prologue(self) -> None:
        while self.is_word("PREFIX", "BASE"):
            if self.word("BASE"):
                self.base = self.iri()
            else:
                self.word("PREFIX")
                name = self.peek().rstrip(":")
                self.at += 1
                self.prefixes[name] = self.iri()

    def statement(self) -> tuple:
        self.prologue()
        if self.is_word("SELECT"):
            out = self.select()
        elif self.word("ASK"):
            self.word("WHERE")
            out = ("ask", self.group())
        elif self.word("CONSTRUCT"):
            template = self.template() if self.peek() == "{" else None
            self.need("WHERE")
            where = self.group()
            out = ("construct", template or [x[1] for x in where if x[0] == "triple"], where, self.modifiers())
        elif self.word("DESCRIBE"):
            what = []
            while self.kind() in ("iri", "pname", "var"):
                what.append(self.term())
            out = ("describe", what, self.group() if self.word("WHERE") or self.peek() == "{" else [])
        else:
            out = ("update", self.updates())
        if self.kind() != "end":
            raise SparqlProblem(f"unexpected {self.peek()}")
        return out

    def select(self) -> tuple:
        self.need("SELECT")
        distinct = self.word("DISTINCT") or self.word("REDUCED")
        items: list = []
        while True:
            if self.take("*"):
                items = ["*"]
            elif self.kind() == "var":
                items.append((self.var(), None))
            elif self.take("("):
                e = self.expr()
                self.need("AS")
                items.append((self.var(), e))
                self.need(")")
            else:
                break
        self.word("WHERE")
        return ("select", distinct, items, self.group(), self.modifiers())

    def modifiers(self) -> dict[str, Any]:
        out: dict[str, Any] = {"group": None, "having": [], "order": [], "limit": None, "offset": None, "values": None}
        if self.word("GROUP"):
            self.need("BY")
            out["group"] = []
            while self.kind() == "var" or self.peek() == "(" or (self.kind() == "name" and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES")):
                if self.take("("):
                    e = self.expr()
                    out["group"].append((e, self.var() if self.word("AS") else None))
                    self.need(")")
                else:
                    e = self.expr()
                    out["group"].append((e, e[1] if e[0] == "var" else None))
        if self.word("HAVING"):
            while self.peek() == "(":
                out["having"].append(self.primary())
        if self.word("ORDER"):
            self.need("BY")
            while self.kind() == "var" or self.peek() == "(" or (self.kind() == "name" and not self.is_word("LIMIT", "OFFSET", "VALUES")):
                down = self.word("DESC")
                if not down:
                    self.word("ASC")
                out["order"].append((self.primary(), down))
        while self.is_word("LIMIT", "OFFSET"):
            key = self.peek().lower()
            self.at += 1
            out[key] = int(self.peek())
            self.at += 1
        if self.word("VALUES"):
            out["values"] = self.values()
        return out

    def updates(self) -> list[tuple]:
        out = []
        while self.kind() != "end":
            self.prologue()
            if self.kind() == "end":
                break
            out.append(self.update())
            if not self.take(";"):
                break
        return out

    def update(self) -> tuple:
        if self.word("INSERT"):
            if self.word("DATA"):
                return ("insert data", self.template())
            template = self.template()
            self.need("WHERE")
            return ("modify", [], template, self.group())
        if self.word("DELETE"):
            if self.word("DATA"):
                return ("delete data", self.template())
            if self.word("WHERE"):
                group = self.group()
                return ("modify", [x[1] for x in group if x[0] == "triple"], [], group)
            delete, insert = self.template(), []
            if self.word("INSERT"):
                insert = self.template()
            self.need("WHERE")
            return ("modify", delete, insert, self.group())
        for verb in ("CLEAR", "DROP", "CREATE"):
            if self.word(verb):
                self.word("SILENT")
                return (verb.lower(), self.graph_name())
        for verb in ("COPY", "MOVE", "ADD"):
            if self.word(verb):
                self.word("SILENT")
                source = self.graph_name()
                self.need("TO")
                return (verb.lower(), source, self.graph_name())
        raise SparqlProblem(f"unexpected {self.peek()}")

    def graph_name(self) -> str | None:
        """IRI of a graph; None: the default graph; 'NAMED' and 'ALL' as they are."""
        if self.word("DEFAULT"):
            return None
        for x in ("NAMED", "ALL"):
            if self.word(x):
                return x
        self.word("GRAPH")
        return self.iri()

    def template(self) -> list[tuple]:
        """Triples (s, p, o, graph)."""
        self.need("{")
        out: list[tuple] = []
        while not self.take("}"):
            if self.word("GRAPH"):
                g = self.term()
                out += [(*t[:3], g) for t in self.template()]
            else:
                found: list = []
                self.triples(found)
                out += [x[1] for x in found]
            self.take(".")
        return out

    # -- patterns
    def group(self) -> list[tuple]:
        self.need("{")
        out: list[tuple] = []
        if self.is_word("SELECT"):
            out.append(("sub", self.select()))
            self.need("}")
            return out
        while not self.take("}"):
            if self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("GRAPH"):
                out.append(("graph", self.term(), self.group()))
            elif self.word("SERVICE"):
                raise SparqlProblem("SERVICE asks another endpoint, which isn't supported")
            elif self.word("FILTER"):
                out.append(("filter", self.primary()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                out.append(("bind", self.var(), e))
                self.need(")")
            elif self.word("VALUES"):
                out.append(("values", self.values()))
            elif self.peek() == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            else:
                self.triples(out)
            self.take(".")
        return out

    def values(self) -> tuple:
        if self.kind() == "var":
            names, single = [self.var()], True
        else:
            self.need("(")
            names, single = [], False
            while not self.take(")"):
                names.append(self.var())
        self.need("{")
        rows = []
        while not self.take("}"):
            if single:
                rows.append([self.data_term()])
            else:
                self.need("(")
                rows.append([self.data_term() for _ in names])
                self.need(")")
        return names, rows

    def data_term(self) -> tuple | None:
        return None if self.word("UNDEF") else self.term()

    def triples(self, out: list[tuple]) -> None:
        s = self.node(out)
        while True:
            p = self.path()
            while True:
                out.append(("triple", (s, p, self.node(out), None)))
                if not self.take(","):
                    break
            while self.take(";"):
                pass
            if self.peek() in (".", "}", "]") or self.is_word("OPTIONAL", "FILTER", "MINUS", "BIND", "VALUES", "GRAPH", "UNION", "SERVICE") or self.peek() == "{":
                return

    def node(self, out: list[tuple]) -> tuple:
        if self.take("["):
            me = ("var", self.new_var())
            if self.peek() != "]":
                while True:
                    p = self.path()
                    while True:
                        out.append(("triple", (me, p, self.node(out), None)))
                        if not self.take(","):
                            break
                    if not self.take(";"):
                        break
            self.need("]")
            return me
        return self.term()

    def path(self) -> tuple:
        left = self.path_seq()
        while self.take("|"):
            left = ("alt", left, self.path_seq())
        return left

    def path_seq(self) -> tuple:
        left = self.path_step()
        while self.take("/"):
            left = ("seq", left, self.path_step())
        return left

    def path_step(self) -> tuple:
        back = bool(self.take("^"))
        if self.take("!"):
            names = []
            if self.take("("):
                while not self.take(")"):
                    names.append((bool(self.take("^")), self.predicate()))
                    self.take("|")
            else:
                names.append((bool(self.take("^")), self.predicate()))
            e: tuple = ("not", names)
        elif self.take("("):
            e = self.path()
            self.need(")")
        elif self.kind() == "var":
            return ("var", self.var())
        else:
            e = ("iri", self.predicate())
        if self.peek() in ("*", "+", "?") and self.kind() == "op":
            e = ({"*": "star", "+": "plus", "?": "opt"}[self.take("*", "+", "?")], e)
        return ("inv", e) if back else e

    def predicate(self) -> str:
        if self.kind() == "name" and self.peek() == "a":
            self.at += 1
            return RDF_TYPE
        return self.iri()

    # -- terms
    def var(self) -> str:
        if self.kind() != "var":
            raise SparqlProblem(f"expected a variable, found {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1][1][1:]

    def iri(self) -> str:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "iri":
            return text[1:-1] if re.match(r"<[A-Za-z][\w+.-]*:", text) else self.base + text[1:-1]
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix in self.prefixes:
                dots = len(local) - len(local.rstrip("."))
                if dots:  # a full stop ends the triple, not the name
                    self.at -= 1
                    self.tokens[self.at : self.at + 1] = [("pname", text.rstrip(".")), ("op", ".")]
                    return self.iri()
                return self.prefixes[prefix] + local
            raise SparqlProblem(f"unknown prefix {prefix}:")
        raise SparqlProblem(f"expected an IRI, found {text or 'the end'}")

    def term(self) -> tuple:
        kind, text = self.tokens[self.at]
        if kind == "var":
            return ("var", self.var())
        if kind in ("iri", "pname"):
            return ("term", self.iri(), "iri", None)
        self.at += 1
        if kind == "bnode":
            return ("var", "_n" + text[2:])
        if kind == "num":
            return ("term", text, XSD + ("integer" if re.fullmatch(r"[+-]?\d+", text) else "double" if "e" in text.lower() else "decimal"), None)
        if kind == "name" and text.lower() in ("true", "false"):
            return ("term", text.lower(), XSD + "boolean", None)
        if kind == "str":
            body = text[3:-3] if text.startswith('"""') else text[1:-1]
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
            if self.kind() == "lang":
                self.at += 1
                return ("term", body, "literal", self.tokens[self.at - 1][1][1:])
            return ("term", body, self.iri() if self.take("^^") else "literal", None)
        raise SparqlProblem(f"expected a term, found {text or 'the end'}")

    # -- expressions
    def expr(self) -> tuple:
        left = self.conj()
        while self.take("||"):
            left = ("or", left, self.conj())
        return left

    def conj(self) -> tuple:
        left = self.relation()
        while self.take("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.additive()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            return ("cmp", op, left, self.additive())
        no = self.is_word("NOT") and self.is_word("IN", ahead=1)
        if no:
            self.at += 1
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.expr())
                self.take(",")
            return ("not", ("in", left, items)) if no else ("in", left, items)
        return left

    def additive(self) -> tuple:
        left = self.multiplicative()
        while True:
            if op := self.take("+", "-"):
                left = ("math", op, left, self.multiplicative())
            elif self.kind() == "num" and self.peek()[0] in "+-":  # 1 -2 is a difference
                left = ("math", "+", left, self.multiplicative())
            else:
                return left

    def multiplicative(self) -> tuple:
        left = self.unary()
        while op := self.take("*", "/"):
            left = ("math", op, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("math", "-", ("term", "0", XSD + "integer", None), self.unary())
        self.take("+")
        return self.primary()

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.is_word("NOT") and self.is_word("EXISTS", ahead=1):
            self.at += 2
            return ("not", ("exists", self.group()))
        if self.word("EXISTS"):
            return ("exists", self.group())
        if self.kind() in ("iri", "pname") and self.peek(1) == "(":
            return ("call", "CAST:" + self.iri().rsplit("#", 1)[-1], self.arguments()[0], False, None)
        if self.kind() == "name" and self.peek(1) == "(":
            name = self.peek().upper()
            self.at += 1
            args, distinct, sep = self.arguments()
            return ("agg" if name in AGGREGATES else "call", name, args, distinct, sep)
        return self.term()

    def arguments(self) -> tuple[list, bool, str | None]:
        self.need("(")
        distinct, args, sep = self.word("DISTINCT"), [], None
        while not self.take(")"):
            if self.take("*"):
                args.append(("star",))
            elif self.word("SEPARATOR"):
                self.need("=")
                sep = self.term()[1]
            else:
                args.append(self.expr())
            self.take(",", ";")
        return args, distinct, sep


def variables(x: Any, out: set[str] | None = None) -> set[str]:
    out = set() if out is None else out
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
        out.add(x[1])
    elif isinstance(x, (tuple, list)):
        for y in x:
            variables(y, out)
    return out


class Builder:
    def __init__(self, store: TripleStore):
        self.store, self.spark = store, store.spark
        self.rounds: Rounds | None = None

    # -- joins
    def join(self, a: Rows, b: Rows, how: str = "inner", extra: Any = None) -> Rows:
        """Compatible solutions; extra: a condition on both sides that belongs to an optional part."""
        shared = [v for v in a.kinds if v in b.kinds]
        right = b.df.select(*[F.col(f"`{v}`").alias(f"_r_{v}") for v in b.kinds])
        conditions = []
        for v in shared:
            x, y = F.col(f"`{v}`"), F.col(f"`_r_{v}`")
            conditions.append(x == y if v not in a.maybe | b.maybe else (x == y) | x.isNull() | y.isNull())
        kinds = {**a.kinds, **{v: k for v, k in b.kinds.items() if v not in a.kinds}}
        if extra is not None:
            both = Rows(a.df, {**a.kinds, **{f"_r_{v}": k for v, k in b.kinds.items()}})
            renamed = {v: f"_r_{v}" for v in b.kinds if v not in a.kinds}
            conditions.append(Expressions(self, both, renamed).truth(extra))
        on = reduce(lambda x, y: x & y, conditions) if conditions else None
        if how in ("left_semi", "left_anti"):
            return Rows(a.df.join(right, on if on is not None else F.lit(True), how), dict(a.kinds), set(a.maybe))
        if on is None:
            df = a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        else:
            df = a.df.join(right, on, how)
        columns = []
        for v in kinds:
            if v in shared and v in a.maybe:
                columns.append(F.coalesce(F.col(f"`{v}`"), F.col(f"`_r_{v}`")).alias(v))
            else:
                columns.append(F.col(f"`{v}`") if v in a.kinds else F.col(f"`_r_{v}`").alias(v))
        maybe = a.maybe | {v for v in b.maybe if v not in a.kinds}
        if how == "left":
            maybe |= {v for v in b.kinds if v not in a.kinds}
        else:
            maybe -= {v for v in shared if v not in b.maybe or v not in a.maybe}
        return Rows(df.select(*columns), kinds, maybe)

    def unit(self) -> Rows:
        return Rows(self.spark.range(1).select())

    # -- patterns
    def group(self, parts: list[tuple], graph: Any = None) -> Rows:
        out: Rows | None = None
        filters = []
        for part in parts:
            kind = part[0]
            if kind == "triple":
                found = self.triple(*part[1][:3], graph=graph)
                out = found if out is None else self.join(out, found)
            elif kind == "filter":
                filters.append(part[1])
            elif kind == "optional":
                inner = [x for x in part[1] if x[0] != "filter"]
                conditions = [x[1] for x in part[1] if x[0] == "filter"]
                simple = [c for c in conditions if not _has_exists(c)]
                right = self.group([*inner, *[("filter", c) for c in conditions if _has_exists(c)]], graph)
                extra = reduce(lambda a, b: ("and", a, b), simple) if simple else None
                out = self.join(out or self.unit(), right, "left", extra)
            elif kind == "minus":
                right = self.group(part[1], graph)
                if out is not None and set(out.kinds) & set(right.kinds):
                    out = self.minus(out, right)
            elif kind == "union":
                found = self.union([self.group(g, graph) for g in part[1]])
                out = found if out is None else self.join(out, found)
            elif kind == "graph":
                found = self.group(part[2], part[1])
                out = found if out is None else self.join(out, found)
            elif kind == "sub":
                found = self.select(*part[1][1:], graph=graph)
                out = found if out is None else self.join(out, found)
            elif kind == "values":
                found = self.values(*part[1])
                out = found if out is None else self.join(out, found)
            elif kind == "bind":
                out = out or self.unit()
                c, k = Expressions(self, out).value(part[2])
                out = Rows(out.df.withColumn(part[1], c), {**out.kinds, part[1]: k}, out.maybe | {part[1]})
        out = out or self.unit()
        for f in filters:
            out = self.filter(out, f, graph)
        return out

    def filter(self, rows: Rows, e: tuple, graph: Any = None) -> Rows:
        if e[0] == "and":
            return self.filter(self.filter(rows, e[1], graph), e[2], graph)
        negated = e[0] == "not" and e[1][0] == "exists"
        if e[0] == "exists" or negated:
            # Conditions inside may speak of outer variables: they are judged on the joined rows.
            parts = e[1][1] if negated else e[1]
            inner = self.group([x for x in parts if x[0] != "filter"], graph)
            conditions = [x[1] for x in parts if x[0] == "filter"]
            outer = [c for c in conditions if variables(c) - set(inner.kinds)]
            for c in conditions:
                if c not in outer:
                    inner = self.filter(inner, c, graph)
            extra = reduce(lambda a, b: ("and", a, b), outer) if outer else None
            return self.join(rows, inner, "left_anti" if negated else "left_semi", extra)
        return Rows(rows.df.where(Expressions(self, rows).truth(e)), rows.kinds, rows.maybe)

    def minus(self, a: Rows, b: Rows) -> Rows:
        shared = [v for v in a.kinds if v in b.kinds]
        certain = [v for v in shared if v not in a.maybe | b.maybe]
        right = b.df.select(*[F.col(f"`{v}`").alias(f"_r_{v}") for v in shared]).distinct()
        same = [F.col(f"`{v}`") == F.col(f"`_r_{v}`") for v in certain]
        loose = [(F.col(f"`{v}`"), F.col(f"`_r_{v}`")) for v in shared if v not in certain]
        same += [(x == y) | x.isNull() | y.isNull() for x, y in loose]
        if not certain:  # at least one variable must be bound on both sides
            same.append(reduce(lambda p, q: p | q, [x.isNotNull() & y.isNotNull() for x, y in loose]))
        return Rows(a.df.join(right, reduce(lambda p, q: p & q, same), "left_anti"), a.kinds, a.maybe)

    def union(self, parts: list[Rows]) -> Rows:
        kinds: dict[str, str] = {}
        for p in parts:
            for v, k in p.kinds.items():
                kinds[v] = k if kinds.get(v, k) == k else "term"
        frames = []
        for p in parts:
            cols = []
            for v, k in kinds.items():
                if v not in p.kinds:
                    cols.append(F.lit(None).cast(TERM if k == "term" else next(q.df.schema[v].dataType for q in parts if v in q.kinds)).alias(v))
                else:
                    cols.append((as_term(F.col(f"`{v}`"), p.df.schema[v].dataType.simpleString()) if k == "term" and p.kinds[v] != "term" else F.col(f"`{v}`")).alias(v))
            frames.append(p.df.select(*cols))
        maybe = {v for v in kinds if any(v not in p.kinds or v in p.maybe for p in parts)}
        return Rows(reduce(lambda x, y: x.unionByName(y), frames), kinds, maybe)

    def values(self, names: list[str], rows: list[list]) -> Rows:
        data = [tuple(None if x is None else (x[1], x[2], x[3]) for x in r) for r in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` {TERM}" for n in names))
        return Rows(df, dict.fromkeys(names, "term"), {n for i, n in enumerate(names) if any(r[i] is None for r in rows)})

    def triple(self, s: tuple, p: tuple, o: tuple, graph: Any = None) -> Rows:
        scan = self.store.scan(graph)
        binds: list[tuple[Column, tuple]] = []
        if p[0] == "var":
            df = scan.select(subject().alias("_from"), object_().alias("_to"), term(F.col("p"), "iri").alias("_p"), "g")
            binds.append((F.col("_p"), p))
        elif p[0] == "iri":
            df = scan.where(F.col("p") == p[1])
            if s[0] == "term":
                df = df.where(F.col("s") == s[1])
            if o[0] == "term":
                df = df.where(F.col("o") == o[1])
            df = df.select(subject().alias("_from"), object_().alias("_to"), "g")
        else:
            df = self.path(p, scan, s, o).withColumn("g", F.lit(None).cast("string"))
        binds += [(F.col("_from"), s), (F.col("_to"), o)]
        if isinstance(graph, tuple) and graph[0] == "var":
            binds.append((term(F.col("g"), "iri"), graph))
        columns: dict[str, Column] = {}
        for c, t in binds:
            if t[0] == "term":
                df = df.where(c == literal(t))
            elif t[1] in columns:
                df = df.where(c == columns[t[1]])
            else:
                columns[t[1]] = c
        return Rows(df.select(*[c.alias(v) for v, c in columns.items()]), dict.fromkeys(columns, "term"))

    # -- property paths: (_from, _to)
    def path(self, p: tuple, scan: DataFrame, s: tuple, o: tuple) -> DataFrame:
        hop = lambda e: self.path(e, scan, ("any",), ("any",))
        match p:
            case ("iri", name):
                return scan.where(F.col("p") == name).select(subject().alias("_from"), object_().alias("_to"))
            case ("inv", e):
                return hop(e).select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))
            case ("seq", a, b):
                left, right = hop(a).withColumnRenamed("_to", "_mid"), hop(b).select(F.col("_from").alias("_mid"), "_to")
                return left.join(right, "_mid").select("_from", "_to")
            case ("alt", a, b):
                return hop(a).unionByName(hop(b))
            case ("not", names):
                ahead, back = [n for inv, n in names if not inv], [n for inv, n in names if inv]
                out = scan.where(~F.col("p").isin(*ahead)).select(subject().alias("_from"), object_().alias("_to")) if ahead else None
                if back:
                    b = scan.where(~F.col("p").isin(*back)).select(object_().alias("_from"), subject().alias("_to"))
                    out = b if out is None else out.unionByName(b)
                return out
            case ("opt", e):
                return self.zero(scan, s, o).unionByName(hop(e)).distinct()
            case ("plus", e):
                return self.closure(hop(e), s, o)
            case ("star", e):
                return self.zero(scan, s, o).unionByName(self.closure(hop(e), s, o)).distinct()
        raise SparqlProblem(f"not a path: {p}")

    def zero(self, scan: DataFrame, s: tuple, o: tuple) -> DataFrame:
        """Paths of no hop: a term to itself; all terms of the graph unless an end is given."""
        given = s if s[0] == "term" else o if o[0] == "term" else None
        if given:
            return self.spark.range(1).select(literal(given).alias("_from"), literal(given).alias("_to"))
        terms = scan.select(subject().alias("_from")).unionByName(scan.select(object_().alias("_from"))).distinct()
        return terms.withColumn("_to", F.col("_from"))

    def closure(self, step: DataFrame, s: tuple, o: tuple) -> DataFrame:
        """Pairs that one or more hops connect, each once. From a given end only what it reaches is followed; rounds stop when nothing new is reached."""
        self.rounds = self.rounds or Rounds(self.spark)
        if s[0] != "term" and o[0] == "term":
            back = self.closure(step.select(F.col("_to").alias("_from"), F.col("_from").alias("_to")), o, s)
            return back.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))
        step = self.rounds.keep(step.distinct())
        start = step.where(F.col("_from") == literal(s)) if s[0] == "term" else step
        seen = frontier = self.rounds.keep(start)
        while True:
            further = frontier.select("_from", F.col("_to").alias("_mid")).join(step.select(F.col("_from").alias("_mid"), "_to"), "_mid").select("_from", "_to").distinct()
            frontier = self.rounds.keep(further.join(seen, ["_from", "_to"], "left_anti"))
            if frontier.isEmpty():
                return seen
            seen = self.rounds.keep(seen.unionByName(frontier))

    # -- solutions
    def select(self, distinct: bool, items: list, where: list, mods: dict, graph: Any = None) -> Rows:
        rows = self.group(where, graph)
        if mods["values"]:
            rows = self.join(rows, self.values(*mods["values"]))
        grouped = mods["group"] is not None or any(e is not None and _has_aggregate(e) for _, e in [x for x in items if x != "*"])
        if grouped:
            rows, swap = self.aggregate(rows, mods, items)
            items = [(v, swap(e) if e is not None else None) for v, e in items]
            mods = {**mods, "order": [(swap(e), d) for e, d in mods["order"]]}
        for v, e in [x for x in items if x != "*"]:
            if e is not None:
                c, k = Expressions(self, rows).value(e)
                rows = Rows(rows.df.withColumn(v, c), {**rows.kinds, v: k}, rows.maybe | {v})
        names = [v for v in rows.kinds if not v.startswith("_")] if items == ["*"] else [v for v, _ in items]
        kinds, maybe = {v: rows.kinds.get(v, "term") for v in names}, {v for v in names if v in rows.maybe or v not in rows.kinds}
        shown = [F.col(f"`{v}`") if v in rows.kinds else F.lit(None).cast(TERM).alias(v) for v in names]
        if distinct and not variables([e for e, _ in mods["order"]]) <= set(names):
            raise SparqlProblem("with DISTINCT only what is selected can order the rows")
        if distinct:  # before the order, which it would undo
            rows = Rows(rows.df.select(*shown).distinct(), kinds, maybe)
            shown = [F.col(f"`{v}`") for v in names]
        if mods["order"]:
            keys = []
            for e, down in mods["order"]:
                for c in Expressions(self, rows).order(e):
                    keys.append(c.desc_nulls_last() if down else c.asc_nulls_first())
            rows = Rows(rows.df.orderBy(*keys), rows.kinds, rows.maybe)
        df = rows.df.select(*shown)
        if mods["offset"]:
            df = df.offset(mods["offset"])
        if mods["limit"] is not None:
            df = df.limit(mods["limit"])
        return Rows(df, kinds, maybe)

    def aggregate(self, rows: Rows, mods: dict, items: list) -> tuple[Rows, Any]:
        x, by, kinds, maybe = Expressions(self, rows), [], {}, set()
        named: dict[str, tuple] = {}
        for i, (e, alias) in enumerate(mods["group"] or []):
            c, k = x.value(e)
            name = alias or f"_g{i}"
            by.append(c.alias(name))
            kinds[name], named[repr(e)] = k, ("var", name)
            if e[0] != "var" or e[1] in rows.maybe:
                maybe.add(name)
        columns: dict[str, Column] = {}

        def swap(e: Any) -> Any:
            if isinstance(e, tuple) and repr(e) in named:
                return named[repr(e)]
            if isinstance(e, tuple) and e and e[0] == "agg":
                name = f"_a{len(columns)}"
                columns[name] = x.aggregate(e)
                named[repr(e)] = ("var", name)
                return ("var", name)
            if isinstance(e, tuple):
                return tuple(swap(y) for y in e)
            return [swap(y) for y in e] if isinstance(e, list) else e

        for _, e in items:
            swap(e)
        having = [swap(e) for e in mods["having"]]
        for e, _ in mods["order"]:
            swap(e)
        if columns:
            df = rows.df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])
        else:
            df = rows.df.select(*by).distinct()
        kinds |= {n: "term" if df.schema[n].dataType.simpleString() == TERM.replace(" ", "") else "value" for n in columns}
        out = Rows(df, kinds, maybe | set(columns))
        for e in having:
            out = self.filter(out, e)
        return out, swap

    def answer(self, rows: Rows) -> DataFrame:
        """Terms as their texts, values as they are."""
        return rows.df.select(*[(F.col(f"`{v}`.v") if k == "term" else F.col(f"`{v}`")).alias(v) for v, k in rows.kinds.items()])

    def instantiated(self, rows: Rows, template: list[tuple]) -> DataFrame:
        """Triples of a template for each solution; those with an unbound part are left out. A blank node of the template is new for each solution."""
        frames = []
        row = F.md5(F.to_json(F.struct(*[F.col(f"`{v}`") for v in rows.kinds]))) if rows.kinds else F.lit("0")
        for s, p, o, g in template:
            def at(t: Any) -> Column:
                if t is None:
                    return F.lit(None).cast(TERM)
                if t[0] == "term":
                    return literal(t)
                if t[1] in rows.kinds:
                    c = F.col(f"`{t[1]}`")
                    return c if rows.kinds[t[1]] == "term" else as_term(c, rows.df.schema[t[1]].dataType.simpleString())
                return term(F.concat(F.lit(f"_:{t[1]}"), row), "bnode")

            path = ("term", p[1], "iri", None) if p[0] == "iri" else p
            parts = rows.df.select(at(s).alias("s"), at(path).alias("p"), at(o).alias("o"), at(g).alias("g"))
            frames.append(parts.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select(
                F.col("s.v").alias("s"), F.col("p.v").alias("p"), F.col("o.v").alias("o"), F.col("o.t").alias("o_type"), F.col("o.l").alias("o_lang"), F.col("g.v").alias("g")
            ))
        if not frames:
            return self.spark.createDataFrame([], TRIPLE_SCHEMA)
        return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def subject() -> Column:
    return term(F.col("s"), F.when(F.col("s").startswith("_:"), F.lit("bnode")).otherwise(F.lit("iri")))


def object_() -> Column:
    return term(F.col("o"), F.col("o_type"), F.col("o_lang"))


def literal(t: tuple) -> Column:
    return term(F.lit(t[1]), t[2], F.lit(t[3]).cast("string"))


def as_term(c: Column, kind: str) -> Column:
    """A native value as a literal."""
    name = {"bigint": "integer", "int": "integer", "double": "double", "boolean": "boolean", "string": None}.get(kind, "decimal")
    if kind.startswith("struct"):
        return c
    return F.when(c.isNotNull(), term(c.cast("string"), "literal" if name is None else XSD + name))


def _has_exists(e: Any) -> bool:
    return isinstance(e, (tuple, list)) and ((len(e) > 0 and e[0] == "exists") or any(_has_exists(x) for x in e))


def _has_aggregate(e: Any) -> bool:
    return isinstance(e, (tuple, list)) and ((len(e) > 0 and e[0] == "agg") or any(_has_aggregate(x) for x in e))


class Expressions:
    """Expressions over solutions. An error (a cast that fails, an unbound variable) is null."""

    def __init__(self, builder: Builder, rows: Rows, renamed: dict[str, str] | None = None):
        self.b, self.rows, self.renamed = builder, rows, renamed or {}

    def value(self, e: tuple) -> tuple[Column, str]:
        """(column, 'term' or 'value')."""
        if e[0] == "var":
            v = self.renamed.get(e[1], e[1])
            if v not in self.rows.kinds:
                return F.lit(None).cast(TERM), "term"
            return F.col(f"`{v}`"), self.rows.kinds[v]
        if e[0] == "term":
            return literal(e), "term"
        if e[0] == "call" and e[1] in ("IRI", "URI"):
            return term(self.text(e[2][0]), "iri"), "term"
        if e[0] == "call" and e[1] == "STRLANG":
            return term(self.text(e[2][0]), "literal", self.text(e[2][1])), "term"
        if e[0] == "call" and e[1] == "STRDT":
            return term(self.text(e[2][0]), self.text(e[2][1])), "term"
        if e[0] == "call" and e[1] in ("IF", "COALESCE"):
            args = e[2][1:] if e[1] == "IF" else e[2]
            found = [self.value(a) for a in args]
            if all(k == "term" for _, k in found):
                cols, kind = [c for c, _ in found], "term"
            elif all(self.numeric(a) for a in args):
                cols, kind = [self.number(a) for a in args], "value"
            else:
                cols, kind = [self.text(a) for a in args], "value"
            return (F.when(self.truth(e[2][0]), cols[0]).otherwise(cols[1]) if e[1] == "IF" else F.coalesce(*cols)), kind
        return self.native(e), "value"

    def numeric(self, e: tuple) -> bool:
        """Whether an expression can only be a number."""
        if e[0] == "term":
            return e[2] in (XSD + "integer", XSD + "decimal", XSD + "double")
        if e[0] == "var":
            v = self.renamed.get(e[1], e[1])
            return self.rows.kinds.get(v) == "value" and self.rows.df.schema[v].dataType.simpleString() in ("bigint", "double", "int")
        return e[0] == "math" or (e[0] == "call" and e[1] in (
            "ABS", "CEIL", "FLOOR", "ROUND", "STRLEN", "YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS", "RAND", "CAST:integer", "CAST:double", "CAST:decimal"))

    def text(self, e: tuple) -> Column:
        c, k = self.value(e)
        return c.getField("v") if k == "term" else c.cast("string")

    def number(self, e: tuple) -> Column:
        if e[0] == "term" and self.numeric(e):
            return F.lit(float(e[1]))
        c, k = self.value(e)
        return c.getField("v").try_cast("double") if k == "term" else c.cast("double")

    def truth(self, e: tuple) -> Column:
        if e[0] in ("and", "or", "not", "cmp", "in") or (e[0] == "call" and e[1] in BOOLEAN):
            return self.native(e)
        c, k = self.value(e)
        if k == "term":
            return F.when(c.getField("t") == XSD + "boolean", c.getField("v") == "true").otherwise(F.coalesce(c.getField("v").try_cast("double") != 0, F.length(c.getField("v")) > 0))
        return c if self.rows.df.select(c.alias("x")).schema[0].dataType.simpleString() == "boolean" else c.cast("double") != 0

    def order(self, e: tuple) -> list[Column]:
        """Numbers by value, then texts."""
        c, k = self.value(e)
        return [c.getField("v").try_cast("double"), c.getField("v")] if k == "term" else [c]

    def native(self, e: tuple) -> Column:
        kind = e[0]
        if kind in ("var", "term"):
            return self.value(e)[0]
        if kind == "and":
            return self.truth(e[1]) & self.truth(e[2])
        if kind == "or":
            return self.truth(e[1]) | self.truth(e[2])
        if kind == "not":
            return ~self.truth(e[1])
        if kind == "cmp":
            return self.compare(*e[1:])
        if kind == "in":
            return reduce(lambda a, b: a | b, [self.compare("=", e[1], x) for x in e[2]]) if e[2] else F.lit(False)
        if kind == "math":
            a, b = self.number(e[2]), self.number(e[3])
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]]
        if kind == "call":
            return self.call(e[1], e[2])
        raise SparqlProblem(f"{kind} can't stand here")

    def compare(self, op: str, left: tuple, right: tuple) -> Column:
        make = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op]
        if self.numeric(left) or self.numeric(right):
            return make(self.number(left), self.number(right))
        (a, ka), (b, kb) = self.value(left), self.value(right)
        if ka == kb == "term":
            iri = (left[0] == "term" and left[2] == "iri") or (right[0] == "term" and right[2] == "iri")
            if op in ("=", "!=") and (iri or left[0] == "term" or right[0] == "term"):
                return make(a, b)
            x, y = self.number(left), self.number(right)
            texts = make(a, b) if op in ("=", "!=") else make(a.getField("v"), b.getField("v"))
            return F.when(x.isNotNull() & y.isNotNull(), make(x, y)).otherwise(texts)
        return make(self.text(left), self.text(right))

    def call(self, name: str, args: list) -> Column:
        if name == "BOUND":
            return self.value(args[0])[0].isNotNull()
        if name in FUNCTIONS:
            return FUNCTIONS[name](*[self.text(a) for a in args])
        if name in NUMBERS:
            return NUMBERS[name](*[self.number(a) for a in args])
        if name in TERMS:
            return TERMS[name](*[as_term(c, self.rows.df.select(c.alias("x")).schema[0].dataType.simpleString()) if k != "term" else c for c, k in map(self.value, args)])
        if name in ("REGEX", "REPLACE"):
            flags = args[-1][1] if len(args) == (3 if name == "REGEX" else 4) else ""
            pattern = F.concat(F.lit(f"(?{flags})" if flags else ""), self.text(args[1]))
            return F.rlike(self.text(args[0]), pattern) if name == "REGEX" else F.regexp_replace(self.text(args[0]), pattern, self.text(args[2]))
        if name == "SUBSTR":
            s, at = self.text(args[0]), self.number(args[1]).cast("int")
            return F.substring(s, at, self.number(args[2]).cast("int")) if len(args) == 3 else F.substring(s, at, F.length(s))
        if name == "RAND":
            return F.rand()
        if name == "NOW":
            return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        if name in ("UUID", "STRUUID"):
            return F.concat(F.lit("urn:uuid:" if name == "UUID" else ""), F.expr("uuid()"))
        raise SparqlProblem(f"unknown function {name}")

    def aggregate(self, e: tuple) -> Column:
        _, name, args, distinct, sep = e
        if name == "COUNT":
            if args[0] == ("star",):
                return F.count_distinct(F.struct(*[F.col(f"`{v}`") for v in self.rows.kinds])) if distinct else F.count(F.lit(1))
            c = self.value(args[0])[0]
            return F.count_distinct(c) if distinct else F.count(c)
        if name in ("SUM", "AVG"):
            c = self.number(args[0])
            if name == "SUM":
                return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0.0))
            return F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)
        if name in ("MIN", "MAX"):
            c, k = self.value(args[0])
            if k != "term":
                return F.min(c) if name == "MIN" else F.max(c)
            f = F.min if name == "MIN" else F.max  # numbers by value; the struct keeps the term
            return f(F.when(c.isNotNull(), F.struct(c.getField("v").try_cast("double").alias("n"), c.getField("v").alias("v"), c.alias("c")))).getField("c")
        if name == "SAMPLE":
            return F.min(self.value(args[0])[0])
        c = self.text(args[0])
        return F.array_join(F.sort_array(F.collect_set(c) if distinct else F.collect_list(c)), sep if sep is not None else " ")


BOOLEAN = {"BOUND", "REGEX", "STRSTARTS", "STRENDS", "CONTAINS", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC", "SAMETERM", "LANGMATCHES"}
FUNCTIONS = {
    "STR": lambda x: x, "UCASE": F.upper, "LCASE": F.lower, "STRLEN": lambda x: F.char_length(x).cast("long"), "CONCAT": F.concat,
    "STRSTARTS": lambda a, b: a.startswith(b), "STRENDS": lambda a, b: a.endswith(b), "CONTAINS": lambda a, b: a.contains(b),
    "STRBEFORE": lambda a, b: F.when(F.call_function("instr", a, b) > 0, F.substring(a, F.lit(1), F.call_function("instr", a, b) - 1)).otherwise(""),
    "STRAFTER": lambda a, b: F.when(F.call_function("instr", a, b) > 0, F.substring(a, F.call_function("instr", a, b) + F.length(b), F.length(a))).otherwise(""),
    "ENCODE_FOR_URI": lambda x: F.replace(F.call_function("url_encode", x), F.lit("+"), F.lit("%20")),
    "MD5": lambda x: F.md5(x.cast("binary")), "SHA1": lambda x: F.sha1(x.cast("binary")), "SHA256": lambda x: F.sha2(x.cast("binary"), 256),
    "SHA384": lambda x: F.sha2(x.cast("binary"), 384), "SHA512": lambda x: F.sha2(x.cast("binary"), 512),
    "YEAR": lambda x: F.year(x.try_cast("timestamp")).cast("long"), "MONTH": lambda x: F.month(x.try_cast("timestamp")).cast("long"),
    "DAY": lambda x: F.day(x.try_cast("timestamp")).cast("long"), "HOURS": lambda x: F.hour(x.try_cast("timestamp")).cast("long"),
    "MINUTES": lambda x: F.minute(x.try_cast("timestamp")).cast("long"), "SECONDS": lambda x: F.second(x.try_cast("timestamp")).cast("long"),
    "LANGMATCHES": lambda a, b: F.when(b == "*", F.length(a) > 0).otherwise(F.lower(a).startswith(F.lower(b))),
    "CAST:integer": lambda x: x.try_cast("double").cast("long"), "CAST:double": lambda x: x.try_cast("double"), "CAST:decimal": lambda x: x.try_cast("double"),
    "CAST:string": lambda x: x, "CAST:boolean": lambda x: x.try_cast("boolean"),
}
NUMBERS = {"ABS": F.abs, "CEIL": lambda x: F.ceil(x).cast("double"), "FLOOR": lambda x: F.floor(x).cast("double"), "ROUND": lambda x: F.floor(x + 0.5).cast("double")}
_is = lambda *kinds: lambda x: x.getField("t").isin(*kinds)
TERMS = {
    "LANG": lambda x: F.when(x.isNotNull(), F.coalesce(x.getField("l"), F.lit(""))),
    "DATATYPE": lambda x: F.when(x.getField("l").isNotNull(), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(x.getField("t") == "literal", F.lit(XSD + "string"))
    .when(~x.getField("t").isin("iri", "bnode"), x.getField("t")),
    "ISIRI": _is("iri"), "ISURI": _is("iri"), "ISBLANK": _is("bnode"), "ISLITERAL": lambda x: ~x.getField("t").isin("iri", "bnode"),
    "ISNUMERIC": _is(XSD + "integer", XSD + "decimal", XSD + "double"), "SAMETERM": lambda a, b: a == b,
}

@dataclass
class TripleStore:
    """Triples (s, p, o, o_type, o_lang, g); g is null in the default graph. Updates give a new store."""

    spark: SparkSession
    triples: DataFrame
    graphs: tuple[str, ...] = ()  # named graphs that were created and may be empty

    def scan(self, graph: Any = None) -> DataFrame:
        """Triples of the default graph, of a named one, or, for a variable, of all named ones."""
        if graph is None:
            return self.triples.where("g IS NULL")
        return self.triples.where(F.col("g") == graph[1]) if graph[0] == "term" else self.triples.where("g IS NOT NULL")

    def query(self, text: str) -> DataFrame:
        """SELECT: a column for each variable; ASK: one boolean `answer`; CONSTRUCT and DESCRIBE: triples."""
        tree, b = Parser(text).statement(), Builder(self)
        if tree[0] == "select":
            return b.answer(b.select(*tree[1:]))
        if tree[0] == "ask":
            return b.group(tree[1]).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if tree[0] == "construct":
            rows = b.group(tree[2])
            mods = tree[3]
            df = rows.df
            df = df.offset(mods["offset"]) if mods["offset"] else df
            df = df.limit(mods["limit"]) if mods["limit"] is not None else df
            return b.instantiated(Rows(df, rows.kinds, rows.maybe), tree[1])
        if tree[0] == "describe":
            rows = b.group(tree[2])
            asked = []
            for t in tree[1]:
                asked.append(rows.df.select(F.col(f"`{t[1]}`.v").alias("s")) if t[0] == "var" else self.spark.range(1).select(F.lit(t[1]).alias("s")))
            return self.triples.join(reduce(lambda x, y: x.unionByName(y), asked).distinct(), "s", "left_semi")
        raise SparqlProblem("an update changes the store: use update()")

    def update(self, text: str) -> TripleStore:
        tree = Parser(text).statement()
        if tree[0] != "update":
            raise SparqlProblem("not an update")
        out = self
        for step in tree[1]:
            out = out._updated(step)
        return out

    def _with(self, triples: DataFrame, graphs: tuple[str, ...] | None = None) -> TripleStore:
        return TripleStore(self.spark, triples, self.graphs if graphs is None else graphs)

    def _less(self, gone: DataFrame) -> DataFrame:
        keys = ["s", "p", "o", "o_type", "o_lang", "g"]
        old, new = self.triples.alias("a"), gone.alias("b")
        return old.join(new, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "left_anti")

    def _updated(self, step: tuple) -> TripleStore:
        b = Builder(self)
        kind = step[0]
        if kind in ("insert data", "delete data"):
            made = b.instantiated(b.unit(), step[1])
            return self._with(self.triples.unionByName(made).distinct() if kind == "insert data" else self._less(made))
        if kind == "modify":
            rows = b.group(step[3])
            # What goes and comes is computed once, from the store as it was, and is small beside the store.
            rounds = Rounds(self.spark)
            gone, new = (rounds.keep(b.instantiated(rows, t)) for t in step[1:3])
            left = self._less(gone) if step[1] else self.triples
            return self._with(left.unionByName(new).distinct() if step[2] else left)
        if kind == "create":
            return self._with(self.triples, tuple(dict.fromkeys([*self.graphs, step[1]])))
        inside = lambda g: F.col("g").isNull() if g is None else F.col("g").isNotNull() if g == "NAMED" else F.lit(True) if g == "ALL" else F.col("g").eqNullSafe(F.lit(g))
        if kind in ("clear", "drop"):
            return self._with(self.triples.where(~inside(step[1])), tuple(x for x in self.graphs if kind == "clear" or x != step[1]))
        source, target = step[1:]
        if source == target:
            return self
        moved = self.triples.where(inside(source)).withColumn("g", F.lit(target).cast("string"))
        rest = self.triples if kind == "add" else self.triples.where(~inside(target))
        if kind == "move":
            rest = rest.where(~inside(source))
        return self._with(rest.unionByName(moved).distinct())
