"""Line dedup by a log-template tree, in DataFrame operations only.

A line is parsed down a tree of fixed depth: number of tokens, then its leading tokens, then a template. Tokens with a digit
are variable fields from the start. Lines of a leaf (same count, same leading tokens) that agree in at least `min_fixed` of
their tokens form a cluster; a cluster of more than `max_children` distinct lines is one template, and its other positions are
variable fields. All other lines keep the template they had, so lines of other clusters and the size of the leaf don't matter.
A template that occurs in at least `min_docs` documents recurs: its lines stay in the document with the smallest id and are
dropped from all others.

Clusters: a line's signature is as many of its tokens as have to agree, those that most distinct lines of the leaf have at
the same place; constants of a template stand in all its lines, its variable tokens in fewer. Lines with one signature
agree by construction. Then a group of equal signatures joins the largest group that shares one of its signature tokens and
agrees with it in enough tokens, unless that one joins another itself; this takes in lines in which a constant was edited.
No two lines of a leaf are compared but each group with one group for each of its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

SPACE = r"[ \t\x0b\x0c\r]+"
FIELD = "<*>"


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    max_children: int = 8
    min_fixed: float = 0.6
    min_docs: int = 2


def _two_hashes(*parts: Column) -> Column:
    """128 bits, so that different templates of a large corpus stay apart."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h"), F.xxhash64(F.lit(2), *parts).alias("g"))


def masked(line: Column) -> Column:
    """A line with one space between tokens and tokens with a digit turned into a field; '' if it has no token."""
    trimmed = F.trim(F.when(line.rlike(r"[\t\x0b\x0c\r]|  "), F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return F.when(trimmed.rlike("[0-9]"), F.regexp_replace(trimmed, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(trimmed)


def parsed_lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """One row for each line with a token: row_id, doc_id, line_no, leaf, template, n_tokens, masked. docs has row_id, doc_id, lines; (doc_id, row_id) tells
    documents apart."""
    numbered = docs.select(
        "row_id", "doc_id", F.posexplode(F.transform("lines", masked)).alias("line_no", "masked")
    ).where("masked <> ''")
    n_tokens = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    return numbered.select(
        "row_id", "doc_id", "line_no",
        _two_hashes(n_tokens, F.substring_index("masked", " ", tree.depth)).alias("leaf"),
        _two_hashes(F.col("masked")).alias("template"),
        n_tokens.alias("n_tokens"), "masked",
    )


def _documents(forms: DataFrame, key: list[str]) -> DataFrame:
    """Documents of each key, each counted once, and the smallest id. Counted before the shuffles: a key that a third of
    the documents have is one row from each task."""
    return forms.select(*key, "doc_id", "row_id").distinct().groupBy(*key).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


#: So many leaves, 16 bytes each, are broadcast to their lines; more are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000


def clustered(forms: DataFrame, tree: Tree) -> DataFrame:
    """(template, general) of the forms (leaf, template, masked, n_tokens) whose cluster has more than max_children of them."""
    enough = F.ceil(F.col("n_tokens") * tree.min_fixed - 1e-9)
    tokens = forms.select("leaf", "template", "n_tokens", F.posexplode(F.split("masked", " ")).alias("pos", "token")).where(F.col("pos") >= tree.depth)
    common = tokens.groupBy("leaf", "pos", "token").agg(F.count("*").alias("n"))
    ranked = tokens.join(common, ["leaf", "pos", "token"]).groupBy("template", "n_tokens").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "token"))).alias("ranked")
    )
    picked = F.slice("ranked", F.lit(1), F.greatest(enough - tree.depth, F.lit(0)).cast("int"))
    signed = forms.join(
        ranked.select("template", F.transform(picked, lambda t: F.struct(t.pos.alias("pos"), t.token.alias("token"))).alias("picked")), "template"
    ).withColumn("group", _two_hashes(F.col("leaf"), F.to_json("picked")))
    signed = written(signed, "line-signatures")

    groups = signed.groupBy("leaf", "group", "n_tokens").agg(
        F.count("*").alias("n"), F.min(F.struct("template", "masked", "picked")).alias("one")
    ).select("leaf", "group", "n_tokens", "n", "one.masked", "one.picked")
    groups = written(groups, "line-groups")
    keys = groups.select("leaf", "group", "n", F.explode("picked").alias("key"))
    leaders = keys.groupBy("leaf", "key").agg(F.max(F.struct("n", "group")).alias("leader"))
    pairs = keys.join(leaders, ["leaf", "key"]).where(F.col("group") != F.col("leader.group")).select("group", "leader").distinct()
    side = lambda c, text: groups.select(F.col("group").alias(c), F.split("masked", " ").alias(text), F.col("n_tokens").alias("n_" + text))
    alike = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same))
    joins = (
        pairs.select("group", "leader", F.col("leader.group").alias("to")).join(side("group", "a"), "group").join(side("to", "b"), "to")
        .where(alike >= F.ceil(F.col("n_a") * tree.min_fixed - 1e-9)).select("group", "leader", "to")
    )
    joins = written(joins, "line-joins")
    best = joins.join(joins.select(F.col("group").alias("to")).distinct(), "to", "left_anti").groupBy("group").agg(F.max("leader").alias("leader"))
    home = groups.join(best, "group", "left").select("group", "n", F.coalesce("leader.group", "group").alias("general"))
    large = home.groupBy("general").agg(F.sum("n").alias("n")).where(F.col("n") > tree.max_children)
    return signed.select("template", "group").join(home.select("group", "general").join(large.select("general"), "general"), "group").select("template", "general")


def recurring(lines: DataFrame, tree: Tree) -> DataFrame:
    """(template, first_doc) of the lines' recurring templates; template as it was before clusters were found.

    The text of a line is only read where its leaf may have clusters.
    """
    counted = written(_documents(lines, ["leaf", "template"]), "line-templates")
    # Leaves with so many templates that there may be a cluster; only for these the tokens are looked at.
    mixed = written(
        counted.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("n_docs").alias("docs"))
        .where((F.col("n") > tree.max_children) & (F.col("docs") >= tree.min_docs)).select("leaf"), "line-leaves",
    )
    few = mixed.count() <= BROADCAST_LEAVES
    forms = written(
        lines.join(F.broadcast(mixed) if few else mixed, "leaf", "left_semi").select("leaf", "template", "masked", "n_tokens").dropDuplicates(["template"]),
        "line-forms",
    )
    general = written(clustered(forms, tree), "line-general")
    discard(forms)
    discard(mixed)

    of_forms = lines.select("template", "row_id", "doc_id").join(general, "template")
    joint = _documents(of_forms, ["general"]).where(F.col("n_docs") >= tree.min_docs)
    alone = counted.where(F.col("n_docs") >= tree.min_docs).join(general.select("template"), "template", "left_anti")
    return general.join(joint, "general").select("template", "first_doc").unionByName(alone.select("template", "first_doc"))


def drop_recurring_lines(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:  # noqa: B008
    """Rows of docs (doc_id, text, ...) with text less its recurring lines, plus n_lines and n_dropped (long).

    Lines are split at \\n; a line without a token is neither counted nor judged, and goes only where other lines of its
    text go. Null and empty texts have no lines and come back as they are. A text that loses all its lines comes back
    empty. Rows with equal id and text count as one document; all rows with the id in which a template stays keep it; a template
    that only rows without an id have stays in all of them. Other columns pass through; those named n_lines or n_dropped
    are replaced. An empty table gives an empty result.
    """
    split = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest"),
        F.col("doc_id"),
        F.xxhash64("text").alias("row_id"),
        F.split("text", "\n", -1).alias("lines"),
    )
    lines = written(parsed_lines(split, tree), "lines")
    drops = written(
        lines.select("row_id", "doc_id", "line_no", "template").join(recurring(lines, tree), "template")
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("row_id").alias("_row")).agg(F.collect_set("line_no").alias("drops")), "line-drops",
    )
    discard(lines)
    has_token = lambda x: x.rlike(r"[^ \t\x0b\x0c\r]")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    left = F.filter(F.transform(stay, lambda i: F.get(F.col("lines"), i)), has_token)
    # The lists of lines are packed so well in files that Spark would take them for small.
    return split.join(drops.hint("merge"), (F.col("row_id") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        *[F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.array_join(F.when(F.col("drops").isNull(), F.col("lines")).otherwise(left), "\n").alias("text"),
        F.coalesce(F.size(F.filter("lines", has_token)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
