"""Parser for the pattern language: Cypher and the GQL forms of the same clauses.

The result is a tree of small tuples; the first item of an expression names its kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?(?!\.\d))
    |(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")
    |(?P<tick>`[^`]+`)
    |(?P<param>\$\w+)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op><>|<=|>=|=~|\|\||\+=|\.\.|[-+*/%^=<>()\[\]{}.,:;|!&?])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CLAUSES = {
    "MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "FOR", "LET", "FILTER", "CALL", "UNION", "EXCEPT", "INTERSECT",
    "OTHERWISE", "ORDER", "SKIP", "OFFSET", "LIMIT", "YIELD", "CREATE", "INSERT", "SET", "REMOVE", "DELETE", "DETACH", "MERGE", "NEXT",
    "LOAD", "FINISH", "HAVING", "FOREACH",
}


class SyntaxProblem(ValueError):
    """A text that isn't a query of the language."""


@dataclass
class NodePattern:
    var: str
    labels: Any = None  # label expression or None
    props: dict[str, Any] = field(default_factory=dict)
    where: Any = None


@dataclass
class EdgePattern:
    var: str
    types: list[str]
    direction: str  # out, in, both
    low: int | None = None  # None: exactly one hop
    high: int | None = None
    props: dict[str, Any] = field(default_factory=dict)
    where: Any = None


@dataclass
class GroupPattern:
    """A quantified path in parentheses; it stands in a path where an edge can."""

    var: str
    inner: Any  # path pattern
    where: Any
    low: int
    high: int | None
    props: dict[str, Any] = field(default_factory=dict)


@dataclass
class PathPattern:
    items: list  # node, edge, node, ...
    var: str | None = None
    mode: str = "WALK"
    shortest: str | None = None  # one, all
    others: list = field(default_factory=list)  # further alternatives
    every: bool = False  # alternatives keep repeated rows


@dataclass
class Query:
    clauses: list


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character at {at}: {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    return [*out, ("end", "")]


def unquoted(s: str) -> str:
    body = s[1:-1].replace("''", "'") if s[0] == "'" else s[1:-1]
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), body)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.fresh = tokens(text), 0, 0

    # -- tokens
    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        return self.kind(ahead) == "name" and self.peek(ahead).upper() in words

    def take(self, *texts: str) -> str | None:
        if self.kind() == "op" and self.peek() in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.take(text) or self.word(text)):
            raise SyntaxProblem(f"expected {text}, found {self.peek() or 'the end'}")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind == "tick":
            text = text[1:-1]
        elif kind != "name":
            raise SyntaxProblem(f"expected a name, found {text or 'the end'}")
        self.at += 1
        return text

    def new_name(self) -> str:
        self.fresh += 1
        return f"_anon{self.fresh}"

    # -- statements
    def statement(self) -> Any:
        left: Any = self.query()
        while True:
            op = next((w for w in ("UNION", "EXCEPT", "INTERSECT", "OTHERWISE", "NEXT") if self.word(w)), None)
            if op is None:
                break
            every = self.word("ALL")
            self.word("DISTINCT")
            left = (op.lower(), every, left, self.query())
        self.take(";")
        if self.kind() != "end":
            raise SyntaxProblem(f"unexpected {self.peek()}")
        return left

    def query(self, closing: str = "") -> Query:
        clauses = []
        while self.kind() != "end" and not (closing and self.peek() == closing) and self.peek() != ";":
            if self.is_word("UNION", "EXCEPT", "INTERSECT", "OTHERWISE", "NEXT"):
                break
            clauses.append(self.clause())
        return Query(clauses)

    def clause(self) -> tuple:
        if self.word("OPTIONAL"):
            if self.word("CALL"):
                return self.call(optional=True)
            self.need("MATCH")
            return ("match", True, *self.match_body())
        if self.word("MATCH"):
            return ("match", False, *self.match_body())
        if self.word("WHERE", "FILTER", "HAVING"):
            self.word("WHERE")
            return ("filter", self.expr())
        if self.word("UNWIND"):
            e = self.expr()
            self.need("AS")
            return ("unwind", self.name(), e, None, 0)
        if self.word("FOR"):
            var = self.name()
            self.need("IN")
            e, ordinal, base = self.expr(), None, 1
            if self.word("WITH"):
                base = 1 if self.word("ORDINALITY") else 0
                if not base:
                    self.need("OFFSET")
                ordinal = self.name()
            return ("unwind", var, e, ordinal, base)
        if self.word("LET"):
            items = []
            while True:
                name = self.name()
                self.need("=")
                items.append((self.expr(), name))
                if not self.take(","):
                    return ("let", items)
        if self.word("WITH"):
            return ("project", False, *self.projection())
        if self.word("RETURN"):
            return ("project", True, *self.projection())
        if self.word("FINISH"):
            return ("finish",)
        if self.is_word("ORDER", "SKIP", "OFFSET", "LIMIT"):
            return ("page", *self.paging())
        if self.word("CALL"):
            return self.call(optional=False)
        if self.word("CREATE", "INSERT"):
            return ("create", self.patterns())
        if self.word("MERGE"):
            patterns, on = self.patterns(), {"create": [], "match": []}
            while self.word("ON"):
                when = "create" if self.word("CREATE") else "match" if self.word("MATCH") else self.need("MATCH")
                self.need("SET")
                on[when] = self.assignments()
            return ("merge", patterns, on["create"], on["match"])
        if self.word("SET"):
            return ("set", self.assignments())
        if self.word("REMOVE"):
            items = []
            while True:
                var = self.name()
                items.append(("label", var, self.name()) if self.take(":") else (self.need("."), "prop", var, self.name())[1:])
                if not self.take(","):
                    return ("remove", items)
        if self.is_word("DELETE", "DETACH"):
            detach = self.word("DETACH")
            self.need("DELETE")
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            return ("delete", detach, names)
        if self.word("FOREACH"):
            self.need("(")
            var = self.name()
            self.need("IN")
            source = self.expr()
            self.need("|")
            inner = []
            while not self.take(")"):
                inner.append(self.clause())
            return ("foreach", var, source, inner)
        if self.word("LOAD"):
            kind = "csv" if self.word("CSV") else "data" if self.word("DATA") else self.need("CSV")
            headers = False
            if self.word("WITH"):
                self.need("HEADERS")
                headers = True
            self.need("FROM")
            path = self.expr()
            if self.word("WITH"):
                self.need("HEADERS")
                headers = True
            self.need("AS")
            var, sep = self.name(), ","
            if self.word("FIELDTERMINATOR"):
                sep = unquoted(self.tokens[self.at][1])
                self.at += 1
            return ("load", kind, headers, path, var, sep)
        raise SyntaxProblem(f"unexpected {self.peek()}")

    def call(self, optional: bool) -> tuple:
        scope = None
        if self.take("("):
            scope = []
            while not self.take(")"):
                scope.append(self.name())
                self.take(",")
        if self.take("{"):
            if scope is None and self.is_word("WITH"):
                # the old form: the first WITH names what is imported
                at = self.at
                self.at += 1
                scope = [self.name()]
                while self.take(","):
                    scope.append(self.name())
                if not self.is_word(*CLAUSES):
                    self.at, scope = at, []
            inner = self.query("}")
            self.need("}")
            return ("subquery", optional, scope, inner)
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        args: list = []
        if self.take("("):
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
        yields = []
        if self.word("YIELD"):
            while True:
                col = self.name()
                yields.append((col, self.name() if self.word("AS") else col))
                if not self.take(","):
                    break
        return ("procedure", name, args, yields)

    def projection(self) -> tuple:
        distinct = self.word("DISTINCT")
        items: list = []
        if self.take("*"):
            items.append(("star",))
            self.take(",")
        while not (self.is_word(*CLAUSES, "GROUP") or self.kind() == "end" or self.peek() in ("}", ";")):
            start = self.at
            e = self.expr()
            alias = self.name() if self.word("AS") else None
            if alias is None:
                alias = e[1] if e[0] == "var" else "".join(
                    t if k != "name" or i == 0 else t for i, (k, t) in enumerate(self.tokens[start : self.at])
                )
            items.append((e, alias))
            if not self.take(","):
                break
        group = None
        if self.word("GROUP"):
            self.need("BY")
            group = [self.expr()]
            while self.take(","):
                group.append(self.expr())
        where = self.expr() if self.word("WHERE", "HAVING") else None
        page = self.paging()
        if where is None and self.is_word("WHERE"):
            self.at += 1
            where = self.expr()
        return distinct, items, group, where, page

    def paging(self) -> tuple:
        order, skip, limit = [], None, None
        if self.word("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                down = self.word("DESC", "DESCENDING")
                if not down:
                    self.word("ASC", "ASCENDING")
                nulls = None
                if self.word("NULLS"):
                    nulls = "first" if self.word("FIRST") else "last"
                    if nulls == "last":
                        self.need("LAST")
                order.append((e, down, nulls))
                if not self.take(","):
                    break
        while self.is_word("SKIP", "OFFSET", "LIMIT"):
            if self.word("SKIP", "OFFSET"):
                skip = self.expr()
            else:
                self.need("LIMIT")
                limit = self.expr()
        return order, skip, limit

    def assignments(self) -> list:
        out = []
        while True:
            var = self.name()
            if self.take(":"):
                out.append(("label", var, self.name()))
            elif self.take("."):
                prop = self.name()
                self.need("=")
                out.append(("prop", var, prop, self.expr()))
            else:
                merge = bool(self.take("+="))
                if not merge:
                    self.need("=")
                out.append(("map", var, merge, self.expr()))
            if not self.take(","):
                return out

    # -- patterns
    def match_body(self) -> tuple:
        mode = None
        if self.word("DIFFERENT"):
            self.word("EDGES", "RELATIONSHIPS")
            mode = "TRAIL"
        elif self.word("REPEATABLE"):
            self.word("ELEMENTS")
        patterns = self.patterns(mode or "WALK")
        where = self.expr() if self.word("WHERE") else None
        return patterns, where

    def patterns(self, mode: str = "WALK") -> list[PathPattern]:
        out = [self.path(mode)]
        while self.take(","):
            out.append(self.path(mode))
        return out

    def path(self, mode: str = "WALK") -> PathPattern:
        var = None
        if self.kind() == "name" and self.peek(1) == "=":
            var = self.name()
            self.take("=")
        shortest = None
        if self.is_word("SHORTESTPATH", "ALLSHORTESTPATHS"):
            shortest = "one" if self.word("SHORTESTPATH") else (self.name(), "all")[1]
            self.need("(")
            inner = self.path(mode)
            self.need(")")
            inner.var, inner.shortest = var, shortest
            return inner
        if self.word("ALL"):
            if self.word("SHORTEST"):
                shortest = "all"
        elif self.word("ANY"):
            shortest = "one" if self.word("SHORTEST") else None
        elif self.word("SHORTEST"):
            if self.kind() == "num":
                self.at += 1
            shortest = "one"
        for m in ("WALK", "TRAIL", "SIMPLE", "ACYCLIC"):
            if self.word(m):
                mode = m
        self.word("PATH", "PATHS")
        items: list = [] if self.group_ahead() else [self.node()]
        while True:
            if self.group_ahead():
                items += [*([] if items else [NodePattern(self.new_name())]), self.group(mode)]
                items.append(NodePattern(self.new_name()) if self.peek() != "(" or self.group_ahead() else self.node())
            elif self.peek() in ("-", "<"):
                items += [self.edge(), self.node()]
            else:
                break
        out = PathPattern(items, var, mode, shortest)
        if self.peek() == "|" and self.kind() == "op" and (self.peek(1) == "(" or (self.peek(1), self.peek(2), self.peek(3)) == ("+", "|", "(")):
            self.take("|")
            if self.take("+"):
                self.take("|")
                out.every = True
            other = self.path(mode)
            out.others, out.every = [other, *other.others], out.every or other.every
            other.others = []
        return out

    def group_ahead(self) -> bool:
        return self.peek() == "(" and self.peek(1) == "(" and self.kind(1) == "op"

    def group(self, mode: str) -> GroupPattern:
        self.need("(")
        inner = self.path(mode)
        where = self.expr() if self.word("WHERE") else None
        self.need(")")
        low = high = 1
        if self.take("{"):
            low, high = 0, None
            if self.kind() == "num":
                low = high = int(self.number())
            if self.take(","):
                high = int(self.number()) if self.kind() == "num" else None
            self.need("}")
        elif self.take("+"):
            low, high = 1, None
        elif self.take("*"):
            low, high = 0, None
        elif self.take("?"):
            low, high = 0, 1
        return GroupPattern(self.new_name(), inner, where, low, high)

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.kind() in ("name", "tick") and not self.is_word("WHERE", "IS") else self.new_name()
        labels = self.label_expr() if self.take(":") or self.word("IS") else None
        props = self.prop_map() if self.peek() == "{" else {}
        where = self.expr() if self.word("WHERE") else None
        self.need(")")
        return NodePattern(var, labels, props, where)

    def label_expr(self) -> Any:
        left = self.label_and()
        while self.take("|"):
            self.take(":")
            left = ("or", left, self.label_and())
        return left

    def label_and(self) -> Any:
        left = self.label_not()
        while self.take("&", ":"):
            left = ("and", left, self.label_not())
        return left

    def label_not(self) -> Any:
        if self.take("!"):
            return ("not", self.label_not())
        if self.take("("):
            e = self.label_expr()
            self.need(")")
            return e
        return ("any",) if self.take("%") else ("label", self.name())

    def edge(self) -> EdgePattern:
        left = bool(self.take("<"))
        self.need("-")
        var, types, low, high, props, where = self.new_name(), [], None, None, {}, None
        if self.take("["):
            if self.kind() in ("name", "tick") and not self.is_word("WHERE"):
                var = self.name()
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                low, high = self.hops()
            if self.peek() == "{":
                props = self.prop_map()
            if self.word("WHERE"):
                where = self.expr()
            self.need("]")
        self.need("-")
        right = bool(self.take(">"))
        if self.take("{"):
            low, high = 0, None
            if self.kind() == "num":
                low = high = int(self.number())
            if self.take(","):
                high = int(self.number()) if self.kind() == "num" else None
            self.need("}")
        elif self.take("+"):
            low = 1
        elif self.peek() == "*" and self.peek(1) != ")":
            self.take("*")
            low = 0
        direction = "both" if left == right else "in" if left else "out"
        return EdgePattern(var, types, direction, low, high, props, where)

    def hops(self) -> tuple[int, int | None]:
        low = int(self.number()) if self.kind() == "num" else None
        if self.take(".."):
            high = int(self.number()) if self.kind() == "num" else None
            return (1 if low is None else low), high
        return (1, None) if low is None else (low, low)

    def number(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def prop_map(self) -> dict[str, Any]:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            self.take(",")
        return out

    # -- expressions
    def expr(self) -> tuple:
        left = self.xor()
        while self.word("OR"):
            left = ("or", left, self.xor())
        return left

    def xor(self) -> tuple:
        left = self.conj()
        while self.word("XOR"):
            left = ("bin", "xor", left, self.conj())
        return left

    def conj(self) -> tuple:
        left = self.negation()
        while self.word("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.additive()
        parts: list = []
        while True:
            if op := self.take("=", "<>", "<", ">", "<=", ">=", "=~"):
                right = self.additive()
                parts.append(("bin", op, left, right))
                left = right
                continue
            whole = parts[-1] if parts else left
            if self.word("IS"):
                no = self.word("NOT")
                if self.word("NULL"):
                    whole = ("isnull", whole, no)
                elif self.word("TYPED"):
                    whole = ("typed", whole, self.name())
                else:
                    self.need(":") if self.peek() == ":" else self.word("LABELED")
                    whole = ("haslabel", whole, self.label_expr())
                    whole = ("not", whole) if no else whole
            elif self.word("IN"):
                whole = ("in", whole, self.additive())
            elif self.word("STARTS"):
                self.need("WITH")
                whole = ("bin", "starts", whole, self.additive())
            elif self.word("ENDS"):
                self.need("WITH")
                whole = ("bin", "ends", whole, self.additive())
            elif self.word("CONTAINS"):
                whole = ("bin", "contains", whole, self.additive())
            elif self.word("LIKE"):
                whole = ("bin", "like", whole, self.additive())
            else:
                break
            if parts:
                parts[-1] = whole
            else:
                left = whole
        out = parts[0] if parts else left
        for p in parts[1:]:
            out = ("and", out, p)
        return out

    def additive(self) -> tuple:
        left = self.multiplicative()
        while op := self.take("+", "-", "||"):
            left = ("bin", op, left, self.multiplicative())
        return left

    def multiplicative(self) -> tuple:
        left = self.power()
        while op := self.take("*", "/", "%"):
            left = ("bin", op, left, self.power())
        return left

    def power(self) -> tuple:
        left = self.unary()
        return ("bin", "^", left, self.power()) if self.take("^") else left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        self.take("+")
        return self.postfix(self.atom())

    def postfix(self, e: tuple) -> tuple:
        while True:
            if self.kind() == "op" and self.peek() == "." and self.kind(1) in ("name", "tick"):
                self.at += 1
                e = ("prop", e, self.name())
            elif self.peek() == "[" and self.kind() == "op":
                self.at += 1
                low = None if self.peek() == ".." else self.expr()
                if self.take(".."):
                    high = None if self.peek() == "]" else self.expr()
                    e = ("slice", e, low, high)
                else:
                    e = ("index", e, low)
                self.need("]")
            elif self.peek() == "{" and e[0] == "var" and self.kind() == "op":
                e = self.map_projection(e)
            elif self.peek() == ":" and e[0] == "var" and self.kind() == "op" and self.kind(1) == "name":
                self.at += 1
                e = ("haslabel", e, self.label_expr())
            else:
                return e

    def map_projection(self, e: tuple) -> tuple:
        self.need("{")
        items = []
        while not self.take("}"):
            if self.take("."):
                if self.take("*"):
                    items.append(("all",))
                else:
                    key = self.name()
                    items.append(("item", key, ("prop", e, key)))
            else:
                key = self.name()
                self.need(":")
                items.append(("item", key, self.expr()))
            self.take(",")
        return ("mapproj", e, items)

    def pattern_ahead(self) -> bool:
        """Whether what starts here with a parenthesis is a pattern: a node that an arrow follows."""
        at, depth = self.at, 0
        while at < len(self.tokens) - 1:
            text = self.tokens[at][1]
            depth += (text == "(") - (text == ")")
            at += 1
            if not depth:
                break
        rest = "".join(t for _, t in self.tokens[at : at + 3])
        inner = self.tokens[self.at + 1 : at - 1]
        plain = all(k in ("name", "tick", "num", "str", "param") or t in ":{},|&!%-" for k, t in inner)
        return plain and (rest.startswith(("-[", "<-", "-->", "--(")) )

    def atom(self) -> tuple:
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return ("lit", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "str":
            self.at += 1
            return ("lit", unquoted(text))
        if kind == "param":
            self.at += 1
            return ("param", text[1:])
        if self.peek() == "(" and self.pattern_ahead():
            return ("exists", Query([("match", False, [self.path()], None)]))
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            return self.list_like()
        if self.peek() == "{":
            return ("map", self.prop_map())
        if kind == "tick":
            return ("var", self.name())
        if kind != "name":
            raise SyntaxProblem(f"unexpected {text or 'the end'}")
        up = text.upper()
        if up in ("TRUE", "FALSE", "NULL") and self.peek(1) != "(":
            self.at += 1
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[up])
        if up == "CASE":
            return self.case()
        if up in ("EXISTS", "COUNT", "VALUE") and self.peek(1) == "{":
            self.at += 2
            if self.is_word("MATCH"):
                inner = self.query("}")
            else:
                inner = Query([("match", False, self.patterns(), self.expr() if self.word("WHERE") else None)])
            self.need("}")
            return ({"EXISTS": "exists", "COUNT": "countsub", "VALUE": "valuesub"}[up], inner)
        if self.peek(1) == "(":
            return self.function()
        if self.peek(1) == "." and self.kind(1) == "op":
            # a dotted function name: a.b.c( ... )
            ahead = 1
            while self.peek(ahead) == "." and self.kind(ahead + 1) == "name":
                ahead += 2
            if self.peek(ahead) == "(" and ahead > 1 and self.peek(ahead - 1).lower() in ("similarity",):
                return ("var", self.name())
        return ("var", self.name())

    def list_like(self) -> tuple:
        if self.peek() == "(" and self.pattern_ahead():
            pattern = self.path()
            where = self.expr() if self.word("WHERE") else None
            self.need("|")
            e = self.expr()
            self.need("]")
            return ("patcomp", Query([("match", False, [pattern], where)]), e)
        if self.kind() == "name" and self.is_word("IN", ahead=1):
            var = self.name()
            self.need("IN")
            source = self.expr()
            where = self.expr() if self.word("WHERE") else None
            e = self.expr() if self.take("|") else None
            self.need("]")
            return ("listcomp", var, source, where, e)
        items = []
        while not self.take("]"):
            items.append(self.expr())
            self.take(",")
        return ("list", items)

    def case(self) -> tuple:
        self.need("CASE")
        operand = None if self.is_word("WHEN") else self.expr()
        whens, other = [], None
        while self.word("WHEN"):
            w = self.expr()
            self.need("THEN")
            whens.append((w, self.expr()))
        if self.word("ELSE"):
            other = self.expr()
        self.need("END")
        return ("case", operand, whens, other)

    def function(self) -> tuple:
        name = self.name().lower()
        self.need("(")
        if name in ("all", "any", "none", "single") and self.is_word("IN", ahead=1):
            var = self.name()
            self.need("IN")
            source = self.expr()
            self.need("WHERE")
            e = self.expr()
            self.need(")")
            return ("quantifier", name, var, source, e)
        if name == "reduce":
            acc = self.name()
            self.need("=")
            start = self.expr()
            self.need(",")
            var = self.name()
            self.need("IN")
            source = self.expr()
            self.need("|")
            e = self.expr()
            self.need(")")
            return ("reduce", acc, start, var, source, e)
        if name == "cast":
            e = self.expr()
            self.need("AS")
            kind = self.name()
            self.need(")")
            return ("cast", e, kind.upper())
        if name == "exists" and self.peek() == "(" and self.pattern_ahead():
            inner = Query([("match", False, [self.path()], None)])
            self.need(")")
            return ("exists", inner)
        if self.take("*"):
            self.need(")")
            return ("func", name, [("star",)], False)
        distinct = self.word("DISTINCT")
        args = []
        while not self.take(")"):
            args.append(self.expr())
            self.take(",")
        return ("func", name, args, distinct)


def parse(text: str) -> Any:
    """Tree of a statement; ("explain" or "profile", tree) if it is only to be explained or also measured."""
    m = re.match(r"\s*(EXPLAIN|PROFILE)\b", text, flags=re.IGNORECASE)
    tree = Parser(text[m.end() :] if m else text).statement()
    return (m[1].lower(), tree) if m else tree
