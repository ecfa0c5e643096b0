"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. Targets: all words are shared out by weight; a source gets at most `cap` times its own words, what is over is shared
   again among the others. That is a water level: source i gets min(weight_i * level, cap * size_i).
2. Blocks of equally many words are apportioned to the sources: quotient target / (2 j + 1) for a source's j-th block, the
   highest quotients win. So each source has an integer quota of blocks.
3. A source is dealt into shards of about `shard_docs` documents. If the quota exceeds the source's own blocks, every
   block is taken as often as it goes in whole; the rest is apportioned to the shards by the same rule.
4. In each shard documents lie one after the other in seeded order and are cut into blocks; the blocks with the lowest
   seeded hashes fill the shard's quota. A document's share is what it has of the blocks taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null. One pass over the text: a word ends where a white space follows it or the text does."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def seeded(*parts: Column, seed: int) -> Column:
    """A hash that any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def targets(sources: DataFrame, cap: int) -> DataFrame:
    """Add target to (rank, size, weight): one row for each source.

    Sources are ordered by the level at which they are full; the level that holds is found among them by running sums.
    The table has one row for each source, which is all that meets in one task.
    """
    whole = Window.partitionBy()
    filling = Window.orderBy(F.col("cap_at"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("full", cap * F.col("size")).withColumn("cap_at", F.col("full") / F.col("weight"))
    levels = (
        ranked.withColumn("total", F.sum("size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("full_before", F.coalesce(F.sum("full").over(filling), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(filling), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    # The first source that isn't full at its own level sets the level; all before it are full.
    open_ = F.min(F.when(F.col("level") <= F.col("cap_at"), F.struct("cap_at", "rank", "level"))).over(whole)
    return (
        levels.withColumn("open", open_)
        .withColumn("target", F.when(F.col("open").isNull(), F.col("full").cast("double")).otherwise(
            F.least(F.col("full").cast("double"), F.col("weight") * F.col("open.level"))))
        .select("rank", "source", "size", "n_docs", "weight", "total", "target")
    )


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str, quota: str, most: str) -> DataFrame:
    """Add quota: seats of each group shared among its rows by Sainte-Lague, no row above `most`.

    With a divisor d a row has floor(weight / d + 1/2) seats. The divisors sum / (seats + n/2) and sum / (seats - n/2), n being the number of rows, give at least and at most all
    seats, so a row's seats lie between the two and only the seats in between, about one a row, are ranked by quotient, ties by key. Rows
    that reach `most` at the first divisor are set aside and the others share what they leave; three times, as a row that takes a share of that may reach `most` itself.
    """
    over = Window.partitionBy(*group)
    w, s, top = F.col(weight).cast("double"), F.col(seats), F.col(most)
    n = F.sum(F.when(w > 0, 1).otherwise(0)).over(over)
    low = F.floor(F.coalesce(F.try_divide(w * (s - n / 2), F.sum(w).over(over)), F.lit(0.0)) + 0.5 - 1e-9)
    base = rows.withColumn("_sure", F.greatest(F.lit(0), F.least(low, top)).cast("long")).withColumn("_full", F.lit(False))
    for _ in range(3):
        free = ~F.col("_full") & (w > 0)
        left = s - F.coalesce(F.sum(F.when(F.col("_full"), top)).over(over), F.lit(0))
        share = F.try_divide(w * (left + F.sum(F.when(free, 1).otherwise(0)).over(over) / 2), F.sum(F.when(free, w)).over(over))
        base = base.withColumn("_up", F.floor(F.coalesce(share, F.lit(0.0)) + 0.5 + 1e-9).cast("long"))
        base = base.withColumn("_full", F.col("_full") | (F.col("_up") > top))
    base = base.withColumn("_up", F.when(F.col("_full"), top).otherwise(F.least("_up", top)).cast("long"))
    base = base.withColumn("_left", s - F.sum("_sure").over(over)).drop("_full")
    seat = base.where((w > 0) & (F.col("_up") > F.col("_sure"))).select(
        *group, key, "_left", weight, F.explode(F.sequence(F.col("_sure"), F.col("_up") - 1)).alias("_j")
    )
    by_quotient = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_j") + 1)).desc(), F.col(key), F.col("_j"))
    won = seat.withColumn("_n", F.row_number().over(by_quotient)).where(F.col("_n") <= F.col("_left"))
    extra = won.groupBy(*group, key).agg(F.count("*").alias("_extra"))
    return base.join(extra, [*group, key], "left").withColumn(quota, F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_sure", "_up", "_left", "_extra")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), cap: int = 3, shard_docs: int = 4096, seed: int = 17) -> DataFrame:
    """For each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, times, ranges, text_hash.

    Sources are weighted by `cycle`, repeated over their names by code point, the null source last. size is the number of
    words; taken is how many of them the mix has, repeats counted, at most cap * size: all words `times` times, and those of
    `ranges` (begin, n) once more. Empty and null texts have size 0
    and nothing taken; repeated rows are documents of their own; an empty table gives an empty result. Blocks have one
    65,536th of all words, 1 at least and 1,024 at most. Other columns of docs are not read. The same rows give the same
    mix, in any order and partitioning: rows are told apart by id, size and text hash.
    """
    sized = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("text_hash"),
        ),
        "mix-sizes",
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(cycle) + 1).cast("int")))
    )
    plan = targets(sources, cap).withColumn(
        "block", F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.col("total") / 65536))).cast("long")
    )
    plan = (
        plan.withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy()) / F.col("block") + 0.5).cast("long"))
        .withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
        .withColumn("most", F.floor(cap * F.ceil(F.col("size") / F.col("block"))).cast("long"))
        .withColumn("all", F.lit(0))
    )
    plan = written(
        apportion(plan, ["all"], "rank", "target", "seats", "quota", "most").select(
            "rank", "source", F.col("size").alias("source_size"), "target", "block", "shards", "quota"
        ),
        "mix-plan",
    )

    placed = (
        sized.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("lot", seeded(F.col("doc_id"), F.col("size"), seed=seed))
        .withColumn("shard", F.pmod(F.conv(F.substring("lot", 1, 8), 16, 10).cast("long"), F.col("shards")))
        .drop("plan_source", "shards")
    )
    lie = Window.partitionBy("rank", "shard").orderBy("lot", "doc_id", "size", "text_hash")
    laid = placed.withColumn("place", F.row_number().over(lie)).withColumn(
        "start", F.sum("size").over(lie.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    laid = written(laid, "mix-laid")

    shards = (
        laid.groupBy("rank", "shard", "block", "quota").agg(F.sum("size").alias("words"))
        .withColumn("blocks", F.ceil(F.col("words") / F.col("block")).cast("long"))
        .withColumn("own", F.sum("blocks").over(Window.partitionBy("rank")))
        .withColumn("times", F.when(F.col("own") > 0, F.least(F.floor(F.col("quota") / F.col("own")), F.lit(cap))).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("times") < cap, F.col("quota") - F.col("times") * F.col("own")).otherwise(0).cast("long"))
    )
    shards = written(
        apportion(shards, ["rank"], "shard", "blocks", "rest", "extra", "blocks").select(
            "rank", "shard", "blocks", "times", "extra"
        ),
        "mix-shards",
    )
    # Blocks that a document touches; whoever touches it first speaks for the block.
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    touched = (
        laid.where("size > 0")
        .select("rank", "shard", "place", "start", "size", "block", F.explode(F.sequence(first, last)).alias("k"))
        .withColumn("begins", F.greatest(F.col("start"), F.col("k") * F.col("block")))
        .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("k") + 1) * F.col("block")) - F.col("begins"))
        .withColumn("speaks", F.col("begins") == F.col("k") * F.col("block"))
    )
    draw = Window.partitionBy("rank", "shard").orderBy(seeded(F.col("rank"), F.col("shard"), F.col("k"), seed=seed), "k")
    chosen = (
        touched.where("speaks").select("rank", "shard", "k").withColumn("drawn", F.row_number().over(draw))
        .join(shards.select("rank", "shard", "extra"), ["rank", "shard"])
        .where(F.col("drawn") <= F.col("extra")).select("rank", "shard", "k")
    )
    range_ = F.struct((F.col("begins") - F.col("start")).alias("begin"), F.col("words").alias("n"))
    # Both sides have a row for each document or block, more than the files behind them tell.
    once = touched.join(chosen.hint("merge"), ["rank", "shard", "k"]).groupBy("rank", "shard", "place").agg(
        F.sum("words").alias("once"), F.sort_array(F.collect_list(range_)).alias("ranges")
    )
    return (
        laid.join(shards.select("rank", "shard", "times"), ["rank", "shard"])
        .join(once.hint("merge"), ["rank", "shard", "place"], "left")
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("size") * F.col("times") + F.coalesce("once", F.lit(0))).cast("long").alias("taken"),
            F.when(F.col("size") > 0, F.col("times")).otherwise(0).cast("long").alias("times"), "ranges", "text_hash",
        )
    )


def mixed_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """What a mix takes, as rows of docs: each document as often as it is taken whole, and once more with the words of the
    ranges taken beyond that, joined by one space. n_chars is that of the text."""
    one = docs.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"])
    plan = mixed.where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash2"), "times", "ranges")
    found = one.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_hash2")))
    words = F.regexp_extract_all("text", F.lit(f"({WORDS})"), 1)
    part = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(F.col("_words"), (r.begin + 1).cast("int"), r.n.cast("int")))), " ")
    parts = found.where("ranges IS NOT NULL").withColumn("_words", words).withColumn("text", part)
    whole = found.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    both = whole.select(*docs.columns).unionByName(parts.select(*docs.columns))
    return both.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else both
