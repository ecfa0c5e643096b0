"""Byte-level BPE by longest match and backtracking.

The vocabulary is a rank file: token bytes in base64, a space, the rank, which is also the id. Pieces of text are found
by a pattern; each is encoded on its own. A piece's tokens are found without replaying merges: an Aho-Corasick automaton
over the vocabulary, with bytes mapped to Latin-1 characters, gives the longest token that starts at a byte. Tokens are
laid from left to right, and one is kept only if it is compatible with its left neighbour, that is, if the merges would
have left exactly these two tokens next to each other. If no token fits at a byte, that byte can't start a token, which
is remembered, and the last token gives way to its next shorter prefix. Every byte is given up at most once, so the time is
linear in the length of the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces of at most so many characters are remembered, at most so many of them.
MEMO_LENGTH, MEMO_SIZE = 48, 600_000
PAIR_MEMO = 1 << 19


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.lengths = [len(t) for t in self.tokens]
        self.widest = max(self.lengths)
        self.packed = [i.to_bytes(4, "little") for i in range(self.size)]
        self.find = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.by_letters = {token.decode("latin-1"): i for token, i in ranks.items()}
        for letters, i in self.by_letters.items():
            self.trie.add_word(letters, i)
        self.trie.make_automaton()
        self._prefixes()
        self._splits()
        self.memo: dict[str, bytes] = _Memo(self)
        self.pairs: dict[int, bool] = {}

    def _prefixes(self) -> None:
        """For each token the longest other token that it starts with, or -1."""
        self.prefix = [-1] * self.size
        for token, i in self.ids.items():
            for n in range(len(token) - 1, 0, -1):
                if (p := self.ids.get(token[:n])) is not None:
                    self.prefix[i] = p
                    break

    def _splits(self) -> None:
        """For each token the two tokens whose merge makes it; a token that no merge makes is its own two halves."""
        self.halves = [(i, i) for i in range(self.size)]
        self.merged: dict[int, int] = {}
        self.pairs = {}
        for i in sorted(self.ids.values()):
            token, left = self.tokens[i], self.prefix[i]
            while left >= 0:
                right = self.ids.get(token[self.lengths[left] :])
                if right is not None and left < i and right < i and self._stay_apart(left, right):
                    self.halves[i] = (left, right)
                    self.merged[left << 32 | right] = i
                    break
                left = self.prefix[left]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two neighbours as they are.

        The merges that made them are undone from the last, and at each moment the two tokens that then met at the border
        must not have had a merge of their own that comes earlier than the one undone last.
        """
        merged, halves, limit = self.merged, self.halves, 1 << 40
        while True:
            if merged.get(left << 32 | right, limit) < limit:
                return False
            # The later merge of the two is the one to undo next; at equal ranks, the right one.
            if left > right:
                limit, inner = left, halves[left][1]
                if inner == left:
                    limit, inner = right + 1, halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                inner = halves[right][0]
                if inner == right:
                    limit, inner = left, halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    limit, right = right + 1, inner

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(left, right)
        return known

    def _longest(self, letters: str, at: int) -> int:
        """The longest token that starts at a letter: the automaton says how far its trie goes on, the rest is a step back to a token."""
        ahead = letters[at : at + self.widest]
        n = self.trie.longest_prefix(ahead)
        while (token := self.by_letters.get(ahead[:n], -1)) < 0:
            if not n:
                raise ValueError("the vocabulary lacks a byte of this piece")
            n -= 1
        return token

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if not n:
            return []
        letters, lengths, longest = piece.decode("latin-1"), self.lengths, self._longest
        given_up, pairs, compatible = set(), self.pairs, self.compatible
        out: list[int] = []
        at, token, last = 0, longest(letters, 0), -1
        while True:
            after = at + lengths[token]
            if after not in given_up and (
                last < 0 or (known if (known := pairs.get(last << 32 | token)) is not None else compatible(last, token))
            ):
                out.append(token)
                if after == n:
                    return out
                at, last, token = after, token, longest(letters, after)
                continue
            token = self.prefix[token]
            while token < 0:
                given_up.add(at)
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte of this piece")
                out.pop()
                at -= lengths[last]
                token, last = self.prefix[last], out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    """Ids of pieces seen before; emptied when it is full. Long pieces are not kept."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(map(self.codec.packed.__getitem__, self.codec.encode_piece(piece.encode())))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each Python worker and vocabulary."""
    return BytePairCodec(read_ranks(path), pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Column of token ids (binary: little-endian unsigned 32-bit integers) of a text column.

    path names a rank file that every node has at the same place. Null is encoded as the empty text, which has no tokens.
    Texts of any length are encoded whole; equal texts get equal ids; other columns are not looked at.
    """

    @F.arrow_udf(T.BinaryType())
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.array([own.encode(t or "") for t in batch.to_pylist()], pa.binary())

    return encode_texts(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Column of the bytes that token ids stand for. Null gives null; ids outside the vocabulary are an error."""

    @F.arrow_udf(T.BinaryType())
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.array([None if x is None else own.decode(x) for x in batch.to_pylist()], pa.binary())

    return decode_ids(ids)


ROUND_TRIP = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
_ROUND_TRIP_ARROW = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Struct column ROUND_TRIP: the ids of encode and the bytes that decode makes of them, by one codec.

    encode and decode in one plan are two Python nodes, so each task has two workers with a codec each, and Spark keeps idle workers for the stages that follow. Here
    it is one. The column counts as nondeterministic, so that using both fields doesn't encode twice. Nulls, repeats and long texts are as in encode.
    """

    @F.arrow_udf(ROUND_TRIP)
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.to_pylist()]
            yield pa.array([{"ids": x, "decoded": own.decode(x)} for x in ids], _ROUND_TRIP_ARROW)

    return both.asNondeterministic()(text)
