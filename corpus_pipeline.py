"""The corpus pipeline: quality rules, line dedup, near dedup, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. An empty table gives an empty result in all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, mixing, neardup, quality, templates
from quillgraph.llm.common import tune, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars being that of the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, less the lines that fail. Null and empty texts go; repeated rows are judged alike."""
    tune(spark)
    judged = docs.withColumn("_report", quality.quality_report(F.col("text"))).where("_report.kept")
    return with_text(judged.withColumn("text", F.col("_report.clean_text")), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their recurring lines; a document of which all lines stand in earlier documents goes. Null and empty texts stay as they are; rows with equal id and text are
    one document."""
    left = templates.drop_recurring_lines(docs)
    return with_text(left.where("NOT (n_dropped > 0 AND text = '')"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. Texts without words, null ones too, and rows without an id stay; repeated rows of an id
    stay or go together."""
    tune(spark)
    goes = neardup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_goes")).distinct()
    return docs.join(goes, F.col("doc_id") == F.col("_goes"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken whole, and once more the words taken beyond that. Texts without words are never taken; the null source is one of
    the sources; repeated rows are one row of the pool with the shares of all of them."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as a digest, and that of the bytes they decode to. Null counts as empty; repeated rows give equal rows."""
    tune(spark)
    both = docs.select("doc_id", "source", bpe.round_trip(F.col("text"), RANKS, public_tokenizers.PATTERN).alias("_both"))
    return both.select(
        "doc_id",
        "source",
        F.floor(F.octet_length("_both.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_both.ids", 256).alias("ids_sha256"),
        F.sha2("_both.decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: SQL expresses neither the merges of the tokenizer nor the line rules; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
