"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: A row of text may hold 100 kB and more, so Arrow batches are kept short.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> SparkSession:
    """Short Arrow batches: the memory of a Python worker is bounded by BATCH_ROWS whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where none is named, /tmp/checkpoints is set and used by a local master; on a cluster that would be another folder on each machine: an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and base.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = default.rstrip("/") + base if not default.startswith("file:") else "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage with a copy that survives lost executors, and is read more than once without being
    computed again.
    """
    path = shared_folder(df.sparkSession, name)
    with measured_broadcasts(df.sparkSession):
        df.write.parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within this, a side of a join is broadcast only by the size that its shuffle had, or by a hint.

    Sizes known before the run are those of files, so that of a table of few, well packed or exploded rows may be a small part of what would come to the driver.
    """
    planned, run = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    was, was_run = spark.conf.get(planned), spark.conf.get(run, None)
    spark.conf.set(run, was_run if was_run is not None else was)
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        spark.conf.set(planned, was)
        spark.conf.set(run, was_run) if was_run is not None else spark.conf.unset(run)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from written(), once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs, which it does when the JVM has collected their handles."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class StableHashes(dict):
    """64-bit hash of each word, kept for words seen before; emptied when it is full, so its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=64)
def multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """One 64-bit hash for each k consecutive words, in order; empty if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed, out = mix(hashes), np.zeros(n, np.uint64)
    for j, m in enumerate(multipliers(k, seed)):
        out += mixed[j : n + j] * m
    return mix(out)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
