"""Queries opN_<name> of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, idfiles, mixing, neardup, phrases, quality, templates, toxicity, warc
from .common import default_partitions, shared_folder, tune, written
from .oracles import ORACLES  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id", bpe.encode(F.col("text"), RANKS, public_tokenizers.PATTERN).alias("ids"))
    both = ids.withColumn("decoded", bpe.decode(F.col("ids"), RANKS, public_tokenizers.PATTERN))
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality.quality_report(F.col("text")).alias("r")).select(
        "doc_id", *[f"r.{c}" for c in quality.REPORT.names if c != "clean_text"]
    )


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.grade(docs, toxicity.train(docs, labels))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact.DigestIndex(spark, shared_folder(spark, "digest-index"), default_partitions(spark))
    result = exact.dedup(docs, index)
    index.drop()
    return result.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Plan(words=3, percent=85))


CODING = idfiles.Coding(public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = written(idfiles.write_files(docs, shared_folder(spark, "ids"), CODING), "id-list")
    return idfiles.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("times", "ranges", "text_hash")


def op10_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    packages = written(warc.write_packages(pages, shared_folder(spark, "warc")), "warc-list")
    return warc.read_packages(packages.repartition(default_partitions(spark)), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_quality_rules,
        op3_repeated_phrases,
        op4_toxicity,
        op5_exact_dedup,
        op6_line_templates,
        op7_minhash_near_dedup,
        op8_id_files,
        op9_mix_sources,
        op10_warc_packages,
    )
}
