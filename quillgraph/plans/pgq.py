"""SQL/PGQ: CREATE PROPERTY GRAPH, and SELECT .. FROM GRAPH_TABLE (MATCH .. COLUMNS (..)).

Each GRAPH_TABLE becomes a DataFrame of the pattern language under a temporary name; all the rest of the statement is Spark SQL's, with joins, grouping and windows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import GraphCatalog, PropertyGraph, node_table
from .parser import SyntaxProblem, tokens


def closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at `at`; quoted texts are passed over."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
    raise SyntaxProblem("a parenthesis isn't closed")


def split_top(text: str) -> list[str]:
    """Parts between commas that stand outside of parentheses and quotes."""
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def graph_table(graph: PropertyGraph, inner: str, params: dict) -> DataFrame:
    """Rows of the inside of GRAPH_TABLE ( ). A column without a name has that of its property."""
    m = re.search(r"\bCOLUMNS\s*\(", inner, re.IGNORECASE)
    if not m or not re.match(r"\s*(\w+\s*,?\s+)?MATCH\b", inner, re.IGNORECASE):
        raise SyntaxProblem("GRAPH_TABLE (MATCH .. COLUMNS (..)) is asked for")
    end = closing(inner, m.end() - 1)
    items = []
    for part in split_top(inner[m.end() : end]):
        if not re.search(r"\bAS\s+[\w`]+\s*$", part, re.IGNORECASE):
            part += f" AS {tokens(part)[-2][1]}"
        items.append(part)
    match = inner[: m.start()]
    match = match[re.search(r"\bMATCH\b", match, re.IGNORECASE).start() :]
    return graph.query(f"{match} RETURN {', '.join(items)}", **params)


def sql(graph: PropertyGraph | GraphCatalog, text: str, **params: object) -> DataFrame:
    """Rows of a SELECT with any number of GRAPH_TABLEs, or the status of CREATE PROPERTY GRAPH (which asks for a catalog)."""
    if re.match(r"\s*CREATE\s+PROPERTY\s+GRAPH\b", text, re.IGNORECASE):
        if not isinstance(graph, GraphCatalog):
            raise SyntaxProblem("CREATE PROPERTY GRAPH asks for a catalog")
        return create_property_graph(graph, text)
    spark: SparkSession = graph.spark
    if call := re.match(r"\s*CALL\b", text, re.IGNORECASE):
        return _named(graph, None).query(text[call.start() :], **params)
    while m := re.search(r"\bGRAPH_TABLE\s*\(", text, re.IGNORECASE):
        end = closing(text, m.end() - 1)
        inner = text[m.end() : end]
        named = re.match(r"\s*(\w+)\s*,?\s+MATCH\b", inner, re.IGNORECASE)
        view = "graph_table_" + uuid.uuid4().hex
        graph_table(_named(graph, named[1] if named else None), inner, params).createOrReplaceTempView(view)
        text = text[: m.start()] + view + text[end + 1 :]
    return spark.sql(text)


def _named(graph: PropertyGraph | GraphCatalog, name: str | None) -> PropertyGraph:
    if isinstance(graph, PropertyGraph):
        return graph
    wanted = name or graph.current
    found = next((g for n, g in graph.graphs.items() if n.lower() == str(wanted).lower()), None)
    if found is None:
        raise SyntaxProblem(f"no graph {wanted}")
    return found


def create_property_graph(catalog: GraphCatalog, text: str) -> DataFrame:
    """Register a graph over tables or views of the session of the same names.

    A node table names its key by PRIMARY KEY; an edge table its ends by the first two columns with REFERENCES. Other columns are properties, but for `id`, which is the id. Ids of nodes are made of the
    table's place and the key, so equal keys of different tables stay apart.
    """
    head = re.match(r"\s*CREATE\s+PROPERTY\s+GRAPH\s+(\w+)", text, re.IGNORECASE)
    parts: dict[str, list[tuple[str, list[str]]]] = {"NODE": [], "EDGE": []}
    for m in re.finditer(r"\b(NODE|VERTEX|EDGE)\s+TABLES\s*\(", text, re.IGNORECASE):
        end = closing(text, m.end() - 1)
        for table in split_top(text[m.end() : end]):
            name, _, rest = table.partition("(")
            parts["EDGE" if m[1].upper() == "EDGE" else "NODE"].append((name.strip(), split_top(rest.rstrip()[:-1])))
    if not head or not parts["NODE"]:
        raise SyntaxProblem("CREATE PROPERTY GRAPH name NODE TABLES (..) is asked for")
    spark, nodes, edges, place = catalog.spark, {}, {}, {}
    key_of = {}
    for i, (name, columns) in enumerate(parts["NODE"]):
        key = next((c.split()[0] for c in columns if re.search(r"PRIMARY\s+KEY", c, re.IGNORECASE)), columns[0].split()[0])
        names = [c.split()[0] for c in columns]
        place[name.lower()], key_of[name.lower()] = i, key
        nodes[name] = node_table(spark.table(name).select(*names), name, _global_id(i, F.col(key)), **({c: c for c in names if c not in ("id", "labels")} or {"key": F.col(key)}))
    for i, (name, columns) in enumerate(parts["EDGE"]):
        ends = [(c.split()[0], m[1].lower()) for c in columns if (m := re.search(r"REFERENCES\s+(\w+)", c, re.IGNORECASE))]
        if len(ends) < 2 or any(t not in place for _, t in ends[:2]):
            raise SyntaxProblem(f"edge table {name} needs two REFERENCES to node tables")
        key = next((c.split()[0] for c in columns if re.search(r"PRIMARY\s+KEY", c, re.IGNORECASE)), None)
        names = [c.split()[0] for c in columns]
        (src, a), (dst, b) = ends[:2]
        df = spark.table(name)
        own = _global_id(i, F.col(key)) if key else F.xxhash64(*names)
        edges[name] = df.select(
            own.alias("id"), _global_id(place[a], F.col(src)).alias("src"), _global_id(place[b], F.col(dst)).alias("dst"), F.lit(name).alias("type"),
            *[F.col(c) for c in names if c not in (src, dst, "id", "src", "dst", "type")],
        )
    catalog.create(head[1], PropertyGraph(spark, nodes, edges), replace_=True)
    return spark.createDataFrame([(f"Property graph '{head[1]}' created ({len(nodes)} node tables, {len(edges)} edge tables)",)], "status string")


def _global_id(place: int, key):
    return key.cast("long") + F.lit(place * 1_000_000_000_000)
