"""Token-id files by an adaptive context-mixing range coder.

Ids are cut into blocks of BLOCK ids. Each block starts from the same model and is coded on its own, with a CRC-32 of its ids, so a damaged or lost block costs no
other. Four distributions of the next id are mixed: how often ids stand in the file (order 0, a table in the file's head), the ids that the block had most
lately (order 0 as it goes on), those that came after the same id (order 1) and after the same two (order 2). A context keeps a few ids with counts; ids that
stay away lose theirs to new ones. The weights of the four depend on how much the contexts have seen; each set of weights learns, id by id, which of the four gave the id
its probability. The mixture is laid out over the vocabulary in order of ids, and a range coder codes the id's interval in it. All of it is integer arithmetic, but
for the weights, whose products and quotients are those of IEEE doubles and so the same everywhere. The blocks of a file are coded side by side, one id of each at a time, in
NumPy arrays.

File: MAGIC; header HEAD; documents (ids, whether they are null, lengths), compressed; the ids of the file with their frequencies, compressed; a table of the blocks; their 32-bit
words.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_partitions, written

MAGIC, HEAD = b"QCMR0003", struct.Struct("<IIQQIIII")
BLOCK, LANES = 4096, 1024
#: Ids in a file: its blocks fill all lanes once.
FILE_IDS = BLOCK * LANES
#: Bits of the context hash and ids a context keeps: orders 2 and 1, and the block's latest ids.
CONTEXTS = ((12, 2), (11, 4), (0, 8))
WIDTH = sum(k for _, k in CONTEXTS)
ROWS = (slice(0, 2), slice(2, 6), slice(6, 14))
#: An id and its count share 31 bits, the count above the id; so the least of a context's ids is the least number.
ID_BITS = 25
ID, UNIT = np.int32((1 << ID_BITS) - 1), np.int32(1 << ID_BITS)
GAIN, MOST = 2, 60
#: The mixture adds up to 2^MIX; the table of order 0 to 2^TABLE, and it never has less than a 64th of the mixture, so each of its ids has an interval.
MIX, TABLE = 28, 22
WHOLE, CUT, PART = np.uint64(1 << MIX), np.uint64(TABLE), 63 / 64 * (1 << MIX)
LOW32 = np.uint64(0xFFFFFFFF)
ONE, SHIFT, NARROW = np.uint64(1), np.uint64(32), np.uint64(1 << 32)
_SIGN, _ONE = np.int32(31), np.int32(1)
#: How much a context has seen, in four steps.
_STEPS = np.minimum((np.arange(8 * 64) + 3) >> 2, 3)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids that occur, in order; their frequencies, at least 1 each, which add up to 2^TABLE)."""
    n = np.bincount(ids)
    own = np.flatnonzero(n)
    n = n[own]
    if not len(own):
        return own.astype(np.uint32), n.astype(np.uint32)
    freq = 1 + np.floor(((1 << TABLE) - len(own)) * (n / n.sum())).astype(np.int64)
    freq[n.argmax()] += (1 << TABLE) - freq.sum()
    return own.astype(np.uint32), freq.astype(np.uint32)


class Model:
    """The models of many blocks, one a lane. Ids are places in the table of the file's ids. Masks are -1 or 0: a sign, shifted to all bits."""

    def __init__(self, lanes: int, freq: np.ndarray):
        self.upto = np.r_[0, np.cumsum(freq.astype(np.uint64))].astype(np.uint64)
        self.share = freq * (PART / (1 << TABLE))
        # ids that nobody has, each once in its context
        nobody = ID - np.arange(WIDTH, dtype=np.int32)
        # words of two ids: one for each context of order 2, then two for each of order 1
        words = nobody[:6].view(np.uint64)
        self.words = np.concatenate([np.full(lanes << CONTEXTS[0][0], words[0]), np.tile(words[1:], lanes << CONTEXTS[1][0])])
        self.base2 = np.arange(lanes) << CONTEXTS[0][0]
        self.base1 = (lanes << CONTEXTS[0][0]) + (np.arange(lanes) << CONTEXTS[1][0] + 1)
        # the ids of each lane's contexts at this time, a row for each place; those of the latest ids stay here
        self.all_kept = np.repeat(nobody[:, None], lanes, 1)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        # weights[distribution, lane and how much order 2 and order 1 have seen]: order 2, 1, latest, table
        start = np.array([[(0.0, 0.15, 0.35, 0.6)[a], (0.0, 0.1, 0.25, 0.4)[b] * (0.6, 0.5, 0.4, 0.3)[a], 0.05] for a in range(4) for b in range(4)])
        start = np.c_[start, 1 - start.sum(1)]
        self.weights = np.ascontiguousarray(np.tile(start, (lanes, 1)).T)
        self.pace = np.full(lanes * 16, 0.2)
        self.lane16 = np.arange(lanes) * 16

    def predict(self, n: int) -> None:
        """For the first n lanes: ids, their shares of the mixture, and rest, the table's share."""
        last, before = self.last[:n], self.before[:n]
        self.at = at = np.empty((3, n), np.int64)
        np.add(self.base2[:n], ((last * np.uint32(0x85EBCA6B)) ^ (before * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - CONTEXTS[0][0]), out=at[0])
        np.add(self.base1[:n], (last * np.uint32(0x9E3779B1)) >> np.uint32(32 - CONTEXTS[1][0]) << np.uint32(1), out=at[1])
        np.add(at[1], 1, out=at[2])
        self.kept = kept = self.all_kept[:, :n]
        kept[:6].reshape(3, 2, n)[...] = self.words.take(at).view(np.int32).reshape(3, n, 2).transpose(0, 2, 1)
        self.ids, seen = kept & ID, kept >> np.int32(ID_BITS)
        total = np.empty((3, n), np.int32)
        for i, rows in enumerate(ROWS):
            np.add.reduce(seen[rows], 0, np.int32, total[i])
        self.set = _STEPS.take(total[0]) * 4
        self.set += _STEPS.take(total[1])
        self.set += self.lane16[:n]
        self.w = self.weights.take(self.set, 1)
        # a whole unit for each count, so that the parts of a distribution can't add up to more than it has
        unit = (self.w[:3] * PART / np.maximum(total, 1)).astype(np.int32)
        self.shares = seen
        for i, rows in enumerate(ROWS):
            seen[rows] *= unit[i]
        total *= unit
        self.rest = WHOLE - (total[0] + total[1] + total[2]).astype(np.uint64)

    def interval(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, width) of an id for each lane."""
        apart = self.ids - token
        below = apart >> _SIGN
        apart -= _ONE
        apart >>= _SIGN
        apart ^= below
        self.hit = apart
        below &= self.shares
        own = apart & self.shares
        self.gave = np.empty((3, len(token)), np.int32)
        for i, rows in enumerate(ROWS):
            np.add.reduce(own[rows], 0, np.int32, self.gave[i])
        begin = (self.rest * self.upto[token]) >> CUT
        width = ((self.rest * self.upto[token + 1]) >> CUT) - begin
        width += (self.gave[0] + self.gave[1] + self.gave[2]).astype(np.uint64)
        begin += np.add.reduce(below, 0, np.int32).astype(np.uint64)
        return begin, width

    def update(self, n: int, token: np.ndarray) -> None:
        """After interval() of the same ids."""
        fresh = token + np.int32(GAIN) * UNIT
        for rows in ROWS:
            kept, hit = self.kept[rows], self.hit[rows]
            # Where no id is the token, the least loses a count; one that has none to lose gives way to the token.
            least = np.minimum.reduce(kept, 0)
            change = np.where(least < GAIN * UNIT, fresh - least, -UNIT)
            change &= ~np.bitwise_or.reduce(hit, 0)
            place = kept ^ least
            place -= _ONE
            place >>= _SIGN
            place &= change
            hit &= np.int32(GAIN) * UNIT
            place += hit
            kept += place
            high = np.flatnonzero(np.maximum.reduce(kept, 0) >= (MOST + 1) * UNIT)
            if len(high):
                some = kept[:, high]
                kept[:, high] = (some >> np.int32(ID_BITS + 1) << np.int32(ID_BITS)) | (some & ID)
        self.words[self.at] = np.ascontiguousarray(self.kept[:6].reshape(3, 2, n).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
        w, gave = self.w, np.empty((4, n))
        gave[:3] = self.gave
        np.multiply(w[3], self.share.take(token), out=gave[3])
        gave /= gave[0] + gave[1] + (gave[2] + gave[3])
        pace = self.pace.take(self.set)
        gave -= w
        gave *= pace
        w += gave
        np.maximum(w, 1e-4, out=w)
        w /= w[0] + w[1] + (w[2] + w[3])
        for row, values in zip(self.weights, w, strict=True):
            row[self.set] = values
        self.pace[self.set] = np.maximum(pace * 0.9, 0.02)
        self.before[:n] = self.last[:n]
        self.last[:n] = token


def _narrowed(low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Lanes whose range has become too narrow; their range is cut where the top word isn't settled."""
    at = np.flatnonzero(wide < NARROW)
    if len(at):
        a, w = low[at], wide[at]
        open_ = ((a ^ (a + w - ONE)) >> SHIFT) != 0
        w[open_] = NARROW - (a[open_] & LOW32)
        wide[at] = w
    return at


def encode_blocks(blocks: list[np.ndarray], freq: np.ndarray) -> list[np.ndarray]:
    """32-bit words of each block of places in the table. Blocks are of one length, but for the last, which may be shorter; none is empty."""
    lanes, longest = len(blocks), len(blocks[0])
    ids = np.zeros((longest, lanes), np.int32)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    short = len(blocks[-1])
    model = Model(lanes, freq)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    words, filled = np.zeros((lanes, longest // 2 + 8), np.uint32), np.zeros(lanes, np.int64)

    def put(at: np.ndarray, low: np.ndarray, wide: np.ndarray) -> None:
        nonlocal words
        if len(at):
            if filled[at].max() + 3 >= words.shape[1]:
                words = np.concatenate([words, np.zeros_like(words)], 1)
            words[at, filled[at]] = low[at] >> SHIFT
            filled[at] += 1
            low[at] <<= SHIFT
            wide[at] <<= SHIFT

    for t in range(longest):
        n = lanes if t < short else lanes - 1
        token = ids[t, :n]
        model.predict(n)
        begin, width = model.interval(token)
        l, w = low[:n], wide[:n]
        unit = w >> np.uint64(MIX)
        l += unit * begin
        np.multiply(unit, width, out=w)
        put(_narrowed(l, w), l, w)
        model.update(n, token)
    for _ in range(2):  # the rest of low
        put(np.arange(lanes), low, wide)
    return [words[i, : filled[i]].copy() for i in range(lanes)]


def decode_blocks(words: list[np.ndarray], lengths: list[int], freq: np.ndarray) -> list[np.ndarray]:
    lanes, longest, short = len(words), lengths[0], lengths[-1]
    model = Model(lanes, freq)
    table = np.zeros((lanes, max(map(len, words)) + 2), np.uint64)
    for i, w in enumerate(words):
        table[i, : len(w)] = w
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    code, taken = table[:, 0] << SHIFT | table[:, 1], np.full(lanes, 2, np.int64)
    limit = table.shape[1] - 1
    ids = np.zeros((longest, lanes), np.int32)
    place = np.repeat(np.arange(len(freq), dtype=np.int32), freq)  # in the table, for each unit of it
    upto, end, none = model.upto, np.int32(len(freq)), np.uint64((1 << TABLE) - 1)
    for t in range(longest):
        n = lanes if t < short else lanes - 1
        model.predict(n)
        l, w, c = low[:n], wide[:n], code[:n]
        unit = w >> np.uint64(MIX)
        point = np.minimum((c - l) // unit, WHOLE - ONE)
        # The kept ids in order, each with what kept ids have up to it and where it begins; row 0 stands before all.
        keyed = (np.minimum(model.ids, end).astype(np.uint64) << np.uint64(MIX)) | model.shares.astype(np.uint64)
        keyed.sort(0)
        name, sums = np.full((WIDTH + 1, n), -1, np.int64), np.zeros((WIDTH + 1, n), np.uint64)
        np.right_shift(keyed, np.uint64(MIX), out=name[1:], casting="unsafe")
        keyed &= WHOLE - ONE
        np.add.accumulate(keyed, 0, out=sums[1:])
        begin = ((model.rest * upto.take(name[1:])) >> CUT) + sums[:-1]
        last = (begin <= point).sum(0) * n + np.arange(n)
        before, kept = sums.take(last), name.take(last)
        # The point is in the last kept id that begins at or before it, or else in the table after that id.
        inside = point < ((model.rest * upto.take(np.minimum(kept + 1, end))) >> CUT) + before
        units = (((point - before + ONE) << CUT) - ONE) // model.rest
        token = np.where(inside, kept, place.take(np.minimum(units, none).astype(np.int64))).astype(np.int32)
        begin, width = model.interval(token)
        l += unit * begin
        np.multiply(unit, width, out=w)
        at = _narrowed(l, w)
        if len(at):
            c[at] = c[at] << SHIFT | table[at, np.minimum(taken[at], limit)]
            taken[at] += 1
            l[at] <<= SHIFT
            w[at] <<= SHIFT
        model.update(n, token)
        ids[t, :n] = token
    return [ids[:k, i].copy() for i, k in enumerate(lengths)]


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, size: int) -> bytes:
    """A file of the ids of documents; lengths add up to the number of ids, all below size."""
    if size > ID - WIDTH:
        raise ValueError(f"more than {ID - WIDTH} ids")
    own, freq = frequencies(ids)
    places = (np.cumsum(np.bincount(ids) > 0, dtype=np.int32) - _ONE)[ids]
    blocks = [places[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
    coded: list[np.ndarray] = []
    for at in range(0, len(blocks), LANES):
        coded += encode_blocks(blocks[at : at + LANES], freq)
    docs = zlib.compress(
        np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + np.array(lengths, "<i8").tobytes()
    )
    table = zlib.compress(np.diff(own.astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    out = [MAGIC, HEAD.pack(size, BLOCK, len(doc_ids), len(ids), len(docs), len(table), len(blocks), zlib.crc32(docs + table)), docs, table]
    crcs = [zlib.crc32(ids[at : at + BLOCK].astype("<u4").tobytes()) for at in range(0, len(ids), BLOCK)]
    out.append(np.array([(len(b), len(w), crc) for b, w, crc in zip(blocks, coded, crcs, strict=True)], "<u4").tobytes())
    return b"".join([*out, *(w.astype("<u4").tobytes() for w in coded)])


def read_file(data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """(ids of documents, their lengths, all token ids). A block that fails its checksum is an error that names it."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    _, _, n_docs, n_ids, n_packed, n_table, n_blocks, crc = HEAD.unpack_from(data, 8)
    at = 8 + HEAD.size
    if zlib.crc32(data[at : at + n_packed + n_table]) != crc:
        raise ValueError("the head is damaged")
    docs = zlib.decompress(data[at : at + n_packed])
    at += n_packed
    known = np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u4").reshape(2, -1)
    names, freq = np.cumsum(known[0], dtype=np.uint32), known[1]
    at += n_table
    keys, null = np.frombuffer(docs, "<i8", n_docs), docs[8 * n_docs : 9 * n_docs]
    lengths = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs).tolist()
    table = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    at += 12 * n_blocks
    words = np.split(np.frombuffer(data, "<u4", int(table[:, 1].sum()), at), np.cumsum(table[:, 1])[:-1]) if n_blocks else []
    out: list[np.ndarray] = []
    for i in range(0, n_blocks, LANES):
        out += [names[b] for b in decode_blocks(words[i : i + LANES], table[i : i + LANES, 0].tolist(), freq)]
    for i, (b, crc) in enumerate(zip(out, table[:, 2].tolist(), strict=True)):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    assert len(ids) == n_ids
    return [None if z else k for k, z in zip(keys.tolist(), null, strict=True)], lengths, ids


class Tokens:
    """Ids (uint32 bytes) of the stretches between ASCII white space, which the tokenizer never joins. Two generations of at most `limit` stretches are kept: what is met again moves to
    the young one, and when that is full the old one is forgotten. New ones are encoded SIDE by side, with a stretch between them that has one id of its own."""

    SIDE, BETWEEN = 64, "\x01"

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        between = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [(t or "").encode().split() for t in texts]
        wanted = {x for p in parts for x in p}
        if len(self.young) + len(wanted) > self.limit:
            self.old, self.young = self.young, {}
        new = []
        for x in wanted:
            if x not in self.young:
                found = self.old.get(x)
                if found is None:
                    new.append(x)
                else:
                    self.young[x] = found
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.young.update(zip(part, self.ids_of([x.decode() for x in part]), strict=True))
        return [b"".join(map(self.young.__getitem__, p)) for p in parts]


    def ids_of(self, stretches: list[str]) -> list[bytes]:
        """Those with BETWEEN in them, and runs that come apart into another number of stretches, are encoded one by one."""
        runs = [stretches[at : at + self.SIDE] for at in range(0, len(stretches), self.SIDE)]
        joined = [f" {self.BETWEEN} ".join(run) for run in runs]
        out: list[bytes] = []
        for run, text, e in zip(runs, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.between).tolist() if self.between is not None else []
            if len(ends) == len(run) - 1 == text.count(self.BETWEEN):
                data = ids.tobytes()
                out += [data[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)], strict=True)]
            else:
                out += [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
        return out


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


@dataclass(frozen=True)
class Coding:
    """path: a file of the tokenizers library. end_id is put after each document."""

    path: str
    vocabulary: int
    end_id: int


FILES = "part int, number int, path string, docs long, ids long, bytes long"


def write_files(docs: DataFrame, folder: str, coding: Coding) -> DataFrame:
    """Write the token ids of docs (doc_id, text) in ascending order of doc_id; returns one row for each file, in order of (part, number).

    Null and empty texts have the end id only. Rows without an id come first; repeated ids follow each other in the order of their
    texts. An empty table makes no file. Other columns are not read. A file holds about FILE_IDS ids, and a longer document whole.
    """
    parts = default_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([coding.end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        context, own = TaskContext.get(), tokens(coding.path)
        keys: list[int | None] = []
        pieces: list[bytes] = []
        held, number = 0, 0

        def close() -> tuple:
            data = file_bytes(keys, [len(p) // 4 for p in pieces], np.frombuffer(b"".join(pieces), "<u4"), coding.vocabulary)
            name = f"part-{context.partitionId():06d}-{number:05d}.qcm"
            hidden = f"{root}/.{name}.{context.taskAttemptId()}"
            with fs.open_output_stream(hidden) as out:
                out.write(data)
            fs.move(hidden, f"{root}/{name}")
            return context.partitionId(), number, f"{folder}/{name}", len(keys), held, len(data)

        for batch in batches:
            for key, ids in zip(batch["doc_id"].to_pylist(), own.encode(batch["text"].to_pylist()), strict=True):
                keys.append(key)
                pieces.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= FILE_IDS:
                    yield pa.RecordBatch.from_pylist([dict(zip(_FILE_NAMES, close(), strict=True))], _FILE_SCHEMA)
                    keys, pieces, held, number = [], [], 0, number + 1
        if keys:
            yield pa.RecordBatch.from_pylist([dict(zip(_FILE_NAMES, close(), strict=True))], _FILE_SCHEMA)

    return ordered.mapInArrow(write, FILES)


_FILE_NAMES = [x.split()[0] for x in FILES.split(", ")]
_FILE_SCHEMA = pa.schema([(n, k) for n, k in zip(_FILE_NAMES, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)])
RECORDS = "doc_id long, start long, n_tokens long, ids binary"
_RECORD_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_files(files: DataFrame) -> DataFrame:
    """Documents of the files of write_files: RECORDS; start counts the ids of all documents before, in all files; ids are little-endian unsigned 32-bit integers."""
    # Files are added up by part first: only one row for each part of the writing job meets in one task.
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("parts_before"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    own = files.select("part", "path", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("own_before"))
    placed = written(own.join(parts, F.col("part") == F.col("_part")).select("path", (F.col("own_before") + F.col("parts_before")).alias("before")), "id-files")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["before"].to_pylist(), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner) as f:
                    keys, lengths, ids = read_file(f.read())
                ends = np.cumsum(lengths).tolist()
                data = ids.astype("<u4").tobytes()
                for i in range(0, len(keys), 256):
                    k = slice(i, i + 256)
                    starts = [e - n for e, n in zip(ends[k], lengths[k], strict=True)]
                    cut = [data[4 * a : 4 * e] for a, e in zip(starts, ends[k], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[k], pa.int64()), pa.array([start + a for a in starts], pa.int64()), pa.array(lengths[k], pa.int64()), pa.array(cut, pa.binary())],
                        schema=_RECORD_SCHEMA,
                    )

    return placed.repartition(default_partitions(files.sparkSession)).mapInArrow(read, RECORDS)
