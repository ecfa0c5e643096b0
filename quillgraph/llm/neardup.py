"""MinHash near-duplicate groups by a multi-index Hamming join.

1. Each text becomes a set of word shingles and a signature of VALUES b-bit MinHash values. Texts with equal sets form one
   class; from here on only the first of each class takes part.
2. Two sets of the asked similarity differ in at most D signature values, except with the probability Plan.miss. A
   signature is cut into m chunks; with m (r + 1) > D, two signatures within D have a chunk with at most r = 1 errors. So
   every chunk is indexed m times less one value: for each value left out, one key of the rest. Two signatures within D
   share a key, whatever they are.
3. A key's hub is its smallest id. Each set is first held against one hub, that of most of its keys, so n sets make fewer than n pairs.
   Pairs within D and of fitting sizes are confirmed on the full sets, and components are formed.
4. Where a key still has members of several components, these are compared by signature in blocks; of the pairs within D only
   a forest is kept, which says what belongs to one cluster. A pair is looked at only at the first key that the two signatures
   share, and of keys with the same members only the first is compared, so a pair comes out once. The full sets of a cluster are then brought together in
   blocks, all pairs of different components in them are counted as a product of incidence matrices, and only a forest of
   the links comes out. So no link is lost. Rows that come out of blocks are in proportion to the members; what goes into them is not: a key of
   n members is read ceil(n / BLOCK) times, a cluster of b bytes of sets ceil(b / UNIT_BYTES) times, and the comparisons within grow with the square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import StableHashes, default_partitions, discard, gram_hashes, mix, multipliers, written
from .components import connected_components

VALUES, BITS = 64, 16
#: Further values, of 8 bits, that are only compared: all VALUES + MORE of them tell a pair's similarity apart more sharply.
MORE = 192
WIDTH = 2 * VALUES + MORE
#: Members of a key, sets of a cluster and bytes of these sets that are compared in one task, at most about twice as many.
BLOCK, SETS, UNIT_BYTES = 4096, 2048, 32_000_000
#: So many ids, 8 bytes each, are broadcast to the texts that belong to them; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Plan:
    """percent: the least similarity, 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    miss: float = 1e-6

    def _most(self, values: int) -> int:
        """The least D with P(more than D of so many values differ) <= miss at the least similarity."""
        p, tail, d = 1 - self.percent / 100, 1.0, -1
        while tail > self.miss:
            d += 1
            tail -= math.comb(values, d) * p**d * (1 - p) ** (values - d)
        return d

    @property
    def distance(self) -> int:
        """D for the indexed values."""
        return self._most(VALUES)

    @property
    def total_distance(self) -> int:
        """D for all values."""
        return self._most(VALUES + MORE)

    @property
    def chunks(self) -> list[np.ndarray]:
        return np.array_split(np.arange(VALUES), self.distance // 2 + 1)


_XOR, _MUL = multipliers(VALUES + MORE, 101), multipliers(VALUES + MORE, 102)


def shingle_set(text: str, k: int, hashes: StableHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased; one for the whole of a shorter text."""
    words = text.encode().lower().split()  # bytes: only ASCII letters and white space count
    n = len(words)
    return np.unique(gram_hashes(hashes.of(words), min(k, n))) if n else np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> bytes:
    """VALUES values of 16 bits, then MORE values of 8 bits."""
    least = np.full(VALUES + MORE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):  # in slices, so that the matrix stays small
        least = np.minimum(least, ((grams[None, at : at + 512] ^ _XOR[:, None]) * _MUL[:, None]).min(1))
    values = mix(least)
    return (values[:VALUES] & np.uint64(0xFFFF)).astype("<u2").tobytes() + (values[VALUES:] & np.uint64(0xFF)).astype("u1").tobytes()


def values_of(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(indexed values, further values) of signatures, one a row."""
    raw = np.frombuffer(b"".join(signatures), "u1").reshape(-1, WIDTH)
    return np.ascontiguousarray(raw[:, : 2 * VALUES]).view("<u2"), raw[:, 2 * VALUES :]


PROFILE = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("signature", T.BinaryType()),
])
_PROFILE_ARROW = pa.struct([("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])


def profiles(text: Column, k: int) -> Column:
    @F.arrow_udf(PROFILE)
    def profile(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = StableHashes()
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                grams = shingle_set(t or "", k, hashes)
                own = len(grams) > 0
                rows.append({
                    "n_shingles": len(grams),
                    "set_key": xxhash.xxh3_128_digest(grams.tobytes()) if own else None,
                    "signature": signature(grams) if own else None,
                })
            yield pa.array(rows, _PROFILE_ARROW)

    return profile(text)


def full_sets(text: Column, k: int) -> Column:
    @F.arrow_udf(T.BinaryType())
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = StableHashes()
        for batch in batches:
            yield pa.array([shingle_set(t or "", k, hashes).tobytes() for t in batch.to_pylist()], pa.binary())

    return sets(text)


def chunk_keys(signature_: Column, plan: Plan) -> Column:
    """All keys of a signature: for each value, in order, a key of the rest of its chunk. The last six bits are the place of the value left out."""
    chunks = plan.chunks

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, tags = multipliers(VALUES, 103), multipliers(VALUES, 104)
        for batch in batches:
            rows = batch.to_pylist()
            table = values_of(rows)[0].astype(np.uint64)
            terms = mix(table + np.arange(VALUES, dtype=np.uint64) * np.uint64(1 << 20)) * weights
            out = np.empty((len(rows), VALUES), np.int64)
            for chunk in chunks:
                whole = terms[:, chunk].sum(1, dtype=np.uint64)
                for j in chunk:
                    out[:, j] = (mix(whole - terms[:, j] + tags[j]) & ~np.uint64(VALUES - 1) | np.uint64(j)).view(np.int64)
            flat = pa.array(out.reshape(-1), pa.int64())
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * VALUES, pa.int32()), flat)

    return keys(signature_)


def first_shared(differ: np.ndarray, chunks: list[np.ndarray]) -> np.ndarray:
    """Place left out by the first key that two signatures share, for each row of a table of the values that differ; VALUES if they share none."""
    first = np.full(len(differ), VALUES)
    for chunk in reversed(chunks):
        own = differ[:, chunk]
        n = own.sum(1)
        first = np.where(n == 0, chunk[0], np.where(n == 1, chunk[own.argmax(1)], first))
    return first


def close_signatures(a: Column, b: Column, plan: Plan) -> Column:
    """Whether two signatures are within both distances."""

    @F.arrow_udf(T.BooleanType())
    def close(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            (x, x2), (y, y2) = values_of(left.to_pylist()), values_of(right.to_pylist())
            near, more = (x != y).sum(1), (x2 != y2).sum(1)
            yield pa.array((near <= plan.distance) & (near + more <= plan.total_distance), pa.bool_())

    return close(a, b)


def common_members(a: Column, b: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def common(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                both = np.concatenate([np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)])
                both.sort()
                out.append(int((both[1:] == both[:-1]).sum()))
            yield pa.array(out, pa.int64())

    return common(a, b)


def within_distance(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of classes whose signatures are within D and whose sizes allow the similarity."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    fitting = joined.where(100 * F.least("n_a", "n_b") >= plan.percent * F.greatest("n_a", "n_b"))
    return fitting.where(close_signatures(F.col("s_a"), F.col("s_b"), plan)).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, linked) for pairs of ids, on the full sets of their texts. A text moves only if a pair needs it."""
    needed = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "needed")
    sets = written(texts_of(docs, needed).select("node", full_sets(F.col("text"), plan.words).alias("members")), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}"))
    counted = pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", common_members(F.col("m_a"), F.col("m_b")).alias("both"),
        F.floor((F.octet_length("m_a") + F.octet_length("m_b")) / 8).alias("sum"),
    )
    links = written(
        counted.select("a", "b", (100 * F.col("both") >= plan.percent * (F.col("sum") - F.col("both"))).alias("linked")), "links"
    )
    discard(sets)
    discard(needed)
    return links


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text, ...) of the documents of a written table of nodes. Few nodes go to the texts; only if they are many, the texts are shuffled."""
    few = nodes.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return rows.join(F.broadcast(nodes) if few else nodes, "node")


UNIT_PAIRS = "a long, b long"


class Forest:
    """What belongs together of a block, by a label for each place. A join relabels in NumPy, and pairs inside a tree are
    skipped in NumPy too, so the steps in Python are as many as the tree edges, however many pairs there are."""

    def __init__(self, labels: np.ndarray):
        self.labels = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Join place i with the others; returns those with which a tree edge was made."""
        made = []
        while len(others := others[self.labels[others] != self.labels[i]]):
            made.append(int(others[0]))
            self.labels[self.labels == self.labels[others[0]]] = self.labels[i]
        return made


def candidate_forest(members: DataFrame, labels: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): what pairs within D, that share a key and lie in different components, connect. They are compared in blocks of keys that have several components; of each block
    the rows are a forest of stars, and a is the smallest id of its star."""
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Keys with the same members are told by two sums of hashes; of these the one that leaves out the first value stays. A pair's first
    # shared key is always among those that stay, as the pair shares all keys with these members.
    apart = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")).alias("y"),
    ).where("low <> high").groupBy("n", "x", "y").agg(F.min_by("key", F.col("key").bitwiseAND(VALUES - 1)).alias("key")).select("key", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    units = (
        placed.join(apart, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .join(classes.select("node", F.col("n").alias("size"), "signature"), "node")
        .select(
            "key", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"),
            "block", "node", "size", "component", "signature",
        )
    )
    parts = default_partitions(members.sparkSession)
    dealt = units.repartition(parts, "key", "u", "v").sortWithinPartitions("key", "u", "v")
    near_most, all_most, percent, chunks = plan.distance, plan.total_distance, plan.percent, plan.chunks

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[dict]) -> list[tuple[int, int]]:
            u, v, place = rows[0]["u"], rows[0]["v"], rows[0]["key"] & (VALUES - 1)
            left = [r for r in rows if r["block"] == u]
            right = left if u == v else [r for r in rows if r["block"] == v]
            if not left or not right:
                return []
            both = left if u == v else left + right
            forest, shift = Forest(np.arange(len(both))), len(both) - len(right)
            table, more = values_of([r["signature"] for r in right])
            groups = np.array([r["component"] for r in right], np.int64)
            sizes = np.array([r["size"] for r in right], np.int64)
            for i, r in enumerate(left):
                from_ = i + 1 if u == v else 0
                fit = (groups[from_:] != r["component"]) & (
                    100 * np.minimum(sizes[from_:], r["size"]) >= percent * np.maximum(sizes[from_:], r["size"])
                )
                at = np.flatnonzero(fit) + from_
                if not len(at):
                    continue
                mine, mine2 = values_of([r["signature"]])
                differ = table[at] != mine
                near = differ.sum(1)
                close = np.flatnonzero(near <= near_most)
                close = close[near[close] + (more[at[close]] != mine2).sum(1) <= all_most]
                close = close[first_shared(differ[close], chunks) == place]
                forest.join(i, at[close] + shift)
            # Each tree as a star around its smallest id: trees of other keys around the same id then come out as the same rows.
            nodes = np.array([r["node"] for r in both], np.int64)
            order = np.lexsort((nodes, forest.labels))
            labels, nodes = forest.labels[order], nodes[order]
            root = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
            tree = np.repeat(nodes[root], np.diff(np.r_[root, len(nodes)]))
            apart_ = nodes != tree
            return list(zip(tree[apart_].tolist(), nodes[apart_].tolist(), strict=True))

        rows: list[dict] = []
        unit = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if (r["key"], r["u"], r["v"]) != unit:
                    if rows:
                        out += of(rows)
                    rows, unit = [], (r["key"], r["u"], r["v"])
                rows.append(r)
            yield _pair_batch(out)
        if rows:
            yield _pair_batch(of(rows))

    return dealt.mapInArrow(compare, UNIT_PAIRS).distinct()


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, as a product of incidence matrices."""
    of_a, of_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(of_a, of_b)
    sides = []
    for sets, flat in ((a, of_a), (b, of_b)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.minimum(np.searchsorted(shared, flat), max(len(shared) - 1, 0))
        sides.append((row, column, shared[column] == flat if len(shared) else np.zeros(len(flat), bool)))
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(shared), 16_384):  # in slices of the shingles, so that the matrices stay small
        x, y = (np.zeros((len(sets), min(16_384, len(shared) - at)), np.float32) for sets in (a, b))
        for matrix, (row, column, own) in ((x, sides[0]), (y, sides[1])):
            use = own & (column >= at) & (column < at + matrix.shape[1])
            matrix[row[use], column[use] - at] = 1
        out += x @ y.T
    return out


def in_slices(rows: list[dict], most_bytes: int = 4_000_000) -> Iterator[tuple[int, list[dict]]]:
    """(place of the first, rows) of runs of sets with at most so many bytes, or one set, and at most 256 sets."""
    at, held = 0, 0
    for i, r in enumerate(rows):
        if i > at and (held + len(r["members"]) > most_bytes or i - at == 256):
            yield at, rows[at:i]
            at, held = i, 0
        held += len(r["members"])
    if rows:
        yield at, rows[at:]


def links_in_clusters(forest: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): of each block of a cluster a forest of the links between its components, confirmed on the full sets."""
    spark = docs.sparkSession
    clusters = connected_components(forest)
    sizes = clusters.join(classes.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum(8 * F.col("n")).alias("bytes")).select(
        F.col("component").alias("cluster"), F.ceil(F.greatest(F.col("n") / SETS, F.col("bytes") / UNIT_BYTES)).cast("int").alias("blocks")
    )
    placed = clusters.select("node", F.col("component").alias("cluster")).join(sizes, "cluster").join(labels, "node", "left")
    placed = written(placed, "placed")
    rows = texts_of(docs, placed)
    sets = written(
        rows.select("cluster", "blocks", "node", F.coalesce("component", "node").alias("component"), full_sets(F.col("text"), plan.words).alias("members")),
        "cluster-sets",
    )
    units = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select("cluster", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", "node", "component", "members")
    dealt = units.repartition(default_partitions(spark), "cluster", "u", "v").sortWithinPartitions("cluster", "u", "v")
    percent = plan.percent

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[dict]) -> list[tuple[int, int]]:
            u, v = rows[0]["u"], rows[0]["v"]
            left = sorted((r for r in rows if r["block"] == u), key=lambda r: r["node"])
            right = left if u == v else sorted((r for r in rows if r["block"] == v), key=lambda r: r["node"])
            places, out = left if u == v else left + right, []
            forest, shift = Forest(np.array([r["component"] for r in places], np.int64)), len(places) - len(right)
            for i, a in in_slices(left):
                sets_a = [np.frombuffer(r["members"], np.uint64) for r in a]
                n_a = np.array([len(x) for x in sets_a])
                for j, b in in_slices(right):
                    if u == v and j < i:
                        continue
                    sets_b = [np.frombuffer(r["members"], np.uint64) for r in b]
                    n_b = np.array([len(x) for x in sets_b])
                    both = common_counts(sets_a, sets_b).astype(np.int64)
                    linked = 100 * both >= percent * (n_a[:, None] + n_b[None, :] - both)
                    for x in np.flatnonzero(linked.any(1)).tolist():
                        for y in forest.join(i + x, np.flatnonzero(linked[x]) + j + shift):
                            out.append((a[x]["node"], places[y]["node"]))
            return out

        held: list[dict] = []
        unit = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if (r["cluster"], r["u"], r["v"]) != unit:
                    if held:
                        out += of(held)
                    held, unit = [], (r["cluster"], r["u"], r["v"])
                held.append(r)
            yield _pair_batch(out)
        if held:
            yield _pair_batch(of(held))

    links = written(dealt.mapInArrow(confirm, UNIT_PAIRS).distinct(), "cluster-links")
    for done in (sets, placed):
        discard(done)
    return links


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that can be reached over links, itself included; kept: it is the row's own.
    Texts without a word, null ones too, have no shingles and are linked with nothing. A row whose id is null is linked
    with nothing: its component_id is null and it is kept. Repeated rows of one id are one document; if their texts
    differ, a link of either counts. An empty table gives an empty result. Other columns of docs are not read.
    """
    known = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), profiles(F.col("text"), plan.words).alias("p")).select(
            "doc_id", "p.n_shingles", "p.set_key", "p.signature"
        ),
        "profiles",
    )
    classes = written(
        known.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("signature").alias("signature")
        ),
        "classes",
    )
    keyed = classes.select("node", F.explode(chunk_keys(F.col("signature"), plan)).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(keyed.join(shared, "key").select("key", "node", "hub"), "members")

    # One hub for each node: the one it shares the most keys with. What other hubs would have joined, the forest joins.
    shares = members.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = shares.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("least"))).alias("best"))
    pairs = best.select((-F.col("best.least")).alias("a"), F.col("node").alias("b"))
    pairs = written(within_distance(pairs, classes, plan), "pairs")
    links = confirmed(pairs, docs, plan)
    discard(pairs)
    labels = connected_components(links.where("linked"))
    forest = written(candidate_forest(members.drop("hub"), labels, classes, plan), "forest")
    discard(members)
    if not forest.isEmpty():
        more = links_in_clusters(forest, labels, classes, docs, plan)
        discard(labels)
        labels = connected_components(links.where("linked").select("a", "b").unionByName(more))
        discard(more)
    discard(forest)
    discard(links)

    with_class = known.join(classes.select("set_key", "node").hint("merge"), "set_key", "left")
    return with_class.join(labels.hint("merge"), "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "node", "doc_id"), F.lit(True)).alias("kept"),
    )
