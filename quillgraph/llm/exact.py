"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row for each distinct text. A batch of new rows is first
reduced to one row for each digest; that is anti-joined against the index by a sort-merge join which reads the index
bucket by bucket, without a shuffle of it; what is new is appended.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, written

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch BIGINT"


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of a text in UTF-8 without the characters [\\x20\\x09-\\x0D]. Null counts as the empty text."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WORD_SPACE, ""), 256))


@dataclass
class DigestIndex:
    """A digest index at a path; every session that opens the path sees the same rows."""

    spark: SparkSession
    path: str
    buckets: int

    def __post_init__(self) -> None:
        self.table = "digest_index_" + re.sub(r"\W", "_", self.path)[-60:].lower()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")  # an external table: the files stay
        self.spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def by_path(self) -> DataFrame:
        """The index without its buckets, for joins with many rows of one digest: then Spark deals out both sides and can split a hot digest."""
        return self.spark.read.schema(INDEX_COLUMNS).parquet(self.path)

    def add(self, groups: DataFrame, batch: int) -> None:
        """Append those groups (digest, keep_id, group_size; digests distinct) that the index lacks."""
        new = groups.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")
        new.select("digest", "keep_id", "group_size", F.lit(batch).cast("long").alias("batch")).write.insertInto(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each digest of (doc_id, digest, length): the id of the longest text, the smallest id on ties, and the number of rows.

    Aggregated before the shuffle, so a digest that a third of the rows share arrives as one row from each task. A null id
    ranks after all others.
    """
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("least"), "doc_id"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), "group_size"
    )


def dedup(docs: DataFrame, index: DigestIndex, batch: int = 0) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, digest, keep_id, group_size, kept, is_new.

    Of equal texts the row with the most characters, then the smallest doc_id stays; if the index knew the text from an
    earlier batch, none of this batch stays and keep_id is the earlier row's. Texts are equal if they are identical
    without [\\x20\\x09-\\x0D]; null is equal to empty. A row whose id is null can stay only if no other row of its group has
    an id. group_size counts the rows of the batch that brought the text. Repeated rows with the id that stays are all marked as kept. Empty input gives an empty result and leaves the
    index as it is. Other columns of docs are not read.
    """
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_digest(F.col("text")).alias("digest"),
            F.coalesce(F.char_length("text"), F.lit(0)).alias("length"),
        ),
        "digests",
    )
    index.add(groups_of(rows), batch)
    known = index.by_path()
    return rows.select("doc_id", "digest").join(known, "digest").select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("kept"),
        (F.col("batch") == batch).alias("is_new"),
    )
