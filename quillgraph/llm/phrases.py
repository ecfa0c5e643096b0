"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is `window` consecutive words of one document. A word goes if it is covered by a window whose word sequence also
starts earlier (smaller doc_id, or same document and earlier start).

1. Anchors. In each window the anchor with the smallest hash is picked (an anchor: ANCHOR consecutive words). Equal windows
   pick the same anchor at the same place, so only anchors that occur twice can lie in recurring windows. Anchors
   are counted over all documents.
2. Segments. Around each recurring anchor the words of all windows that picked it are cut out: a segment. Equal windows
   meet in segments of one anchor, so anchors are the shards' keys. A shard holds many anchors with few segments; an anchor with
   more than SPLIT segments is dealt by salt into several groups.
3. Automata. In each group, windows that occur twice in segments that differ are confirmed on their words and compiled into an automaton; words are
   mapped to single characters for it. All segments are streamed through it, equal ones once, which locates every occurrence. All but the
   first occurrence in a group are later ones.
4. For anchors dealt into several groups, the first occurrences of each group are compared by window across the groups: counted
   before the shuffle, so no group has to hold a hot passage whole.
5. The later windows of each document are put together, and its words are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import StableHashes, default_partitions, discard, gram_hashes, written

ANCHOR = 8
#: Segments of one anchor in a group, and segments of all anchors in a shard, on average.
SPLIT, SHARD = 1024, 2048
#: First character that stands for a word; 0x110000 less this is more than a shard's words.
FIRST_CHAR = 0x100


@dataclass(frozen=True)
class Passages:
    window: int = 20


def picked_anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor that windows pick; the leftmost of equal hashes."""
    grams = gram_hashes(hashes, ANCHOR, seed=31)
    width = window - ANCHOR + 1
    n = len(grams) - width + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    # Upper half of the hash, then the place: the least of these in a window is its anchor. The least of `width` is made
    # from those of 1, 2, 4, ... neighbours.
    least, reach = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[width - reach : n + width - reach])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    ends = np.r_[starts[1:], n] - 1
    return grams[place[starts]], place[starts], starts, ends


def anchor_lists(text: Column, window: int) -> Column:
    """Distinct anchor hashes of a text, each with how often windows pick it (at most 2 are told apart)."""
    kind = T.ArrayType(T.StructType([T.StructField("anchor", T.LongType()), T.StructField("n", T.IntegerType())]))

    @F.arrow_udf(kind)
    def anchors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = StableHashes()
        for batch in batches:
            offsets, all_, counts = [0], [], []
            for t in batch.to_pylist():
                found, n = np.unique(picked_anchors(hashes.of((t or "").encode().split()), window)[0], return_counts=True)
                all_.append(found.view(np.int64))
                counts.append(n)
                offsets.append(offsets[-1] + len(found))
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(all_), pa.int64()), pa.array(np.concatenate(counts).astype(np.int32), pa.int32())], ["anchor", "n"]
            )
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return anchors(text)


SEGMENT = T.ArrayType(T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("words", T.BinaryType()),
]))


def segments(text: Column, anchors: Column, window: int) -> Column:
    """Segments of a text around the given anchors (anchor, parts): the words of all windows that picked the anchor, and where they start."""
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("parts", pa.int64()), ("start", pa.int64()), ("words", pa.binary())]))

    @F.arrow_udf(SEGMENT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = StableHashes()
        for texts, wanted in batches:
            out = []
            for t, own in zip(texts.to_pylist(), wanted.to_pylist(), strict=True):
                words = (t or "").encode().split()
                anchor, _, first, last = picked_anchors(hashes.of(words), window)
                keys = anchor.view(np.int64)
                parts = {x["anchor"]: x["parts"] for x in own}
                hit = [i for i, k in enumerate(keys.tolist()) if k in parts]
                out.append([
                    {"anchor": k, "parts": parts[k], "start": a, "words": b" ".join(words[a : b + window])}
                    for k, a, b in zip(keys[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True)
                ])
            yield pa.array(out, kind)

    return cut(text, anchors)


FOUND = "doc_id long, start long, n int, key binary"


def recurring_windows(texts: list[str], window: int) -> set[str]:
    """Windows that stand twice or more in texts of one character a word: found by a hash, confirmed on the characters."""
    if not texts:
        return set()
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64)
    hashes = gram_hashes(codes, window, seed=37)
    lengths = np.array([len(t) for t in texts])
    inside = np.zeros(len(codes) + 1, np.int8)  # places where a window begins and ends in one text
    begins = np.cumsum(lengths) - lengths
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + np.maximum(lengths - window + 1, 0), -1)
    places = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int64) > 0)
    order = places[np.argsort(hashes[places], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    seen: set[str] = set()
    twice: set[str] = set()
    for at in np.flatnonzero(again).tolist():
        w = whole[at : at + window]
        (twice if w in seen else seen).add(w)
    return twice


def locate(table: pa.Table, window: int) -> pa.Table:
    """All occurrences of the recurring windows of one group of segments, by an automaton.

    In: doc_id, start, words, split. Out: runs of n later windows from a start (key null), and, for segments of anchors that are
    split over several groups, each first window with a 128-bit key of its words. Equal segments are streamed once: all windows of the
    second and further ones are later. So the automaton holds the windows that stand twice in what is streamed.
    """
    doc_ids, starts = table["doc_id"].to_numpy(), table["start"].to_numpy()
    words, split = table["words"].to_pylist(), table["split"].to_pylist()
    order = np.lexsort((starts, doc_ids)).tolist()
    places: dict[bytes, list[int]] = {}  # in order of their first occurrences
    for i in order:
        places.setdefault(words[i], []).append(i)
    doc_ids, starts = doc_ids.tolist(), starts.tolist()
    letters: dict[bytes, str] = {}
    texts = []
    for text in places:
        own = text.split(b" ")
        for w in own:
            if w not in letters:
                code = FIRST_CHAR + len(letters)
                letters[w] = chr(code if code < 0xD800 else code + 0x800)  # surrogates are no characters
        texts.append("".join(map(letters.__getitem__, own)))
    twice = recurring_windows(texts, window)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, w in enumerate(twice):
        automaton.add_word(w, n)
    if twice:
        automaton.make_automaton()
    first: list[tuple[int, int] | None] = [None] * len(twice)
    at_doc: list[int] = []
    at_start: list[int] = []
    at_n: list[int] = []
    firsts: list[tuple[int, int, bytes]] = []

    def later(doc: int, start: int, n: int) -> None:
        at_doc.append(doc)
        at_start.append(start)
        at_n.append(n)

    for (text, own), s in zip(places.items(), texts, strict=True):
        doc, start = doc_ids[own[0]], starts[own[0]]
        hits = []
        for end, n in automaton.iter(s) if twice else ():
            at = end - window + 1
            if first[n] is None:
                first[n] = (doc, start + at)
            elif first[n] != (doc, start + at):  # a repeated row of the same document is the same occurrence
                hits.append(at)
        run = 0
        for k, at in enumerate(hits):
            if k + 1 == len(hits) or hits[k + 1] != at + 1:
                later(doc, start + hits[run], k - run + 1)
                run = k + 1
        if split[own[0]]:
            taken, parts = set(hits), text.split(b" ")
            for at in range(len(s) - window + 1):
                if at not in taken:
                    firsts.append((doc, start + at, xxhash.xxh3_128_digest(b" ".join(parts[at : at + window]))))
        n = len(s) - window + 1
        for i in own[1:]:
            if doc_ids[i] != doc or starts[i] != start:
                later(doc_ids[i], starts[i], n)
    return pa.table({
        "doc_id": pa.array(at_doc + [x[0] for x in firsts], pa.int64()),
        "start": pa.array(at_start + [x[1] for x in firsts], pa.int64()),
        "n": pa.array(at_n + [1] * len(firsts), pa.int32()),
        "key": pa.array([None] * len(at_doc) + [x[2] for x in firsts], pa.binary()),
    })


CLEANED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()),
])


def without_windows(text: Column, runs: Column, window: int) -> Column:
    """Number of words, number of words covered by the windows of runs (start, n), and the other words, joined by spaces."""
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    @F.arrow_udf(CLEANED)
    def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for t, own in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                words = (t or "").encode().split()
                if not own:
                    out.append({"n_words": len(words), "n_removed": 0, "text": b" ".join(words).decode()})
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                begins = np.array([r["start"] for r in own], np.int64)
                ends = begins + np.array([r["n"] for r in own], np.int64) - 1 + window
                np.add.at(edge, np.minimum(begins, len(words)), 1)
                np.add.at(edge, np.minimum(ends, len(words)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                stay = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append({"n_words": len(words), "n_removed": int(gone.sum()), "text": b" ".join(stay).decode()})
            yield pa.array(out, kind)

    return clean(text, runs)


def remove_repeats(docs: DataFrame, passages: Passages = Passages()) -> DataFrame:  # noqa: B008
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed, text (the words that stay, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; windows are judged on the input, not on what is left. Null and empty texts have
    no words. A row whose id is null comes back whole and is no one's earlier occurrence. Rows repeated with one id
    are one document: a copy of a row is no earlier occurrence, and rows of one id with different texts are all cut where any of them was. Texts with fewer words than a window
    come back whole. An empty table gives an empty result. Other columns of docs are not read.
    """
    window, spark = passages.window, docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lists = written(rows.where("doc_id IS NOT NULL").select("doc_id", anchor_lists(F.col("text"), window).alias("anchors")), "anchor-lists")
    own = lists.select("doc_id", F.explode("anchors").alias("a")).select("doc_id", "a.anchor", "a.n")
    parts = F.ceil(F.col("n") / SPLIT).cast("long")
    counts = written(own.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").withColumn("parts", parts), "anchors")
    wanted = written(
        own.select("doc_id", "anchor").join(counts.select("anchor", "parts"), "anchor")
        .groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "parts")).alias("anchors")), "anchored",
    )
    discard(lists)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(default_partitions(spark), -(-total // SHARD))
    cut = (
        rows.join(wanted, "doc_id").select("doc_id", F.explode(segments(F.col("text"), F.col("anchors"), window)).alias("s"))
        .select("doc_id", "s.anchor", "s.parts", "s.start", "s.words")
    )
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.col("parts"))
    grouped = cut.select(
        "doc_id", "start", "words", (F.col("parts") > 1).alias("split"), F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).alias("shard")
    )
    found = written(grouped.groupBy("shard").applyInArrow(lambda t: locate(t, window), FOUND), "found")

    firsts = found.where("key IS NOT NULL").select("key", F.struct("doc_id", "start").alias("at"))
    leading = firsts.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = firsts.join(leading, "key").where("at <> first").select("at.doc_id", "at.start", F.lit(1).cast("int").alias("n"))
    runs = found.where("key IS NULL").select("doc_id", "start", "n").unionByName(across)
    lists = written(runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs")
    return rows.join(lists, "doc_id", "left").select("doc_id", without_windows(F.col("text"), F.col("runs"), window).alias("c")).select(
        "doc_id", "c.n_words", "c.n_removed", "c.text"
    )
