import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import bpe, common, neardup, quality, templates
from quillgraph.llm.common import StableHashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == COLUMNS
        assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == sizes[3] and all(r.ids_sha256 for r in last.collect())


def test_quality_stage_is_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        q = quality.report(r.text, quality.Rules(), StableHashes())
        if q[-2]:
            want[r.doc_id] = q[-1]
    assert {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == want
    assert templates.Tree().min_docs > 1


def test_stages_on_nulls_repeats_and_no_rows(spark):
    good = "This is a plain sentence about a garden. It has flowers and trees, and a path to the river and the sea."
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (None, good + " Once more.", "en", None, 1), (4, "x " * 5000 + ".", "en", "b", 2)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            n = out.count()
            assert docs.isEmpty() <= (n == 0)
            assert name == "tokenize" or out.columns == COLUMNS
    kept = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, kind), "")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # texts are judged once


def test_tokenize_stage_has_one_worker_a_task(spark):
    texts = ["Plain words, twice: plain words.", None, "", "Plain words, twice: plain words.", "\u00e9\u4e16\U0001f600 \n\t x" * 500]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.tokenize(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # a second node is a second worker with a codec of its own
    own = bpe.codec(corpus_pipeline.RANKS, corpus_pipeline.public_tokenizers.PATTERN)
    want = []
    for i, t in enumerate(texts):
        ids, raw = own.encode(t or ""), (t or "").encode()
        want.append((i, "a", len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert sorted(map(tuple, out.collect())) == want


def test_sizes_guessed_from_files_broadcast_nothing(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(threshold)
    last_plan = lambda: spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    try:
        spark.conf.set(threshold, "200000")
        few = common.written(spark.range(1000).withColumn("n", F.lit(100)), "few")
        exploded = few.select("id", F.explode(F.sequence(F.lit(1), "n")).alias("key"))  # some kB in the file, 100,000 rows here
        counts = spark.range(40_000).select((F.col("id") % 200 + 1).cast("int").alias("key"), (F.col("id") % 97).alias("x")).distinct()
        joined = common.written(exploded.join(counts, "key").groupBy("key").count(), "joined")
        assert "BroadcastExchange" not in last_plan() and joined.count() == 100
        small = common.written(exploded.join(spark.range(5).select(F.col("id").cast("int").alias("key")).distinct(), "key"), "small")
        assert "BroadcastExchange" in last_plan() and small.count() == 4000  # as measured
        assert spark.conf.get(threshold) == "200000"
        docs = spark.createDataFrame([(1, "one line\ntwo lines"), (2, "one line")], "doc_id long, text string")
        for out in (templates.drop_recurring_lines(docs), neardup.near_duplicates(docs)):
            assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, was)
