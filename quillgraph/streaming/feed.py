"""Change feeds: micro-batches of change events, subscriptions to them, and counters that decay.

An event has the columns node (long), kind (string), label (string) and ts (timestamp), and amount where it matters. A batch is what one trigger takes: limited by files.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = logging.getLogger(__name__)


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100, kind: str = "parquet") -> DataFrame:
    """Events of the files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def subscribed(events: DataFrame, kinds: Iterable[str] = (), labels: Iterable[str] = (), node: int | None = None) -> DataFrame:
    """Events of these kinds, labels and this node; what isn't given isn't asked."""
    kinds, labels = list(kinds), list(labels)
    out = events.where(F.col("kind").isin(*kinds)) if kinds else events
    out = out.where(F.col("label").isin(*labels)) if labels else out
    return out if node is None else out.where(F.col("node") == node)


def listen(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], Any]], checkpoint: str, once: bool = False, seconds: float = 0.05) -> StreamingQuery:
    """Give each batch to every handler. A handler that fails is logged and doesn't keep the others, or the feed, from going on.

    once: take what is there and stop. Else a batch is started every `seconds`.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for name, handle in handlers.items():
            try:
                handle(kept, number)
            except Exception:
                LOG.exception("handler %s failed on batch %s", name, number)
        kept.unpersist()

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


COUNTER = "node long, value double, ts double"


def decayed_counters(events: DataFrame, half_life: float, most: float | None = None) -> DataFrame:
    """(node, value, ts): a counter for each node, updated with each batch: its value fades from event to event, each adds its amount, and it never exceeds `most`.

    One small state (value, time) is kept for a node. Events of a batch are taken in order of time; one that is older than the state counts as if it came now, faded
    by its age.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(frames)).sort_values(["t", "amount"])
        for t, amount in zip(rows["t"], rows["amount"], strict=True):
            if last is None or t >= last:
                value = (value * 2.0 ** (-(t - last) / half_life) if last is not None else 0.0) + amount
                last = t
            else:
                value += amount * 2.0 ** (-(last - t) / half_life)
            value = min(value, most) if most is not None else value
        state.update((float(value), float(last)))
        yield pd.DataFrame({"node": [key[0]], "value": [float(value)], "ts": [float(last)]})

    timed = events.select("node", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("amount").cast("double").alias("amount"))
    timed = timed.select("node", (F.col("us") / 1e6).alias("t"), "amount")
    return timed.groupBy("node").applyInPandasWithState(update, COUNTER, "value double, ts double", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, kind, n): events by time of event; what comes later than `late` behind the newest event is left out, as the watermark says."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))


def collected(query: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, write its rows below a shared folder and read them back, with the number of the batch in `batch`."""
    spark = query.sparkSession
    running = query.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(T.StructType([*query.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
