"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encodings form a monoid under ``join``: a piece is halved recursively down to short leaves, leaves
are merged by rank, and neighbouring encodings are joined by re-encoding a window around their
boundary.  The window grows until its outermost tokens come out unchanged.  Then every adjacent pair
of the joined sequence is one that occurs in some encoding, and a sequence whose adjacent pairs all
do is itself the encoding of its bytes, so nothing outside the window can change.  Matches of the
pre-tokenizer pattern never merge with each other: above them, join is concatenation.
Decoding concatenates the tokens' bytes up a balanced tree.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.bpe_files import Chunks, token_ranks
from tagloom.llm.common import as_bytes, map_columns

#: Bytes of a leaf; the rank of pairs that are not listed.
LEAF, NONE = 24, 1 << 60


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left rank << 20 | right rank -> rank of the two tokens' bytes together."""
    if max(ranks.values()) >= 1 << 20:
        raise ValueError("more tokens than a pair key holds")
    get = ranks.get
    return {a << 20 | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None}


def merge(tokens: list[int], pairs: dict[int, int]) -> list[int]:
    """Lowest rank first, leftmost on ties, until no adjacent pair is listed."""
    n = len(tokens)
    if n > 64:
        return merge_long(tokens, pairs)
    get = pairs.get
    known = [get(a << 20 | b, NONE) for a, b in zip(tokens, tokens[1:])]
    while known and (low := min(known)) != NONE:
        i = known.index(low)
        tokens[i] = low
        del known[i], tokens[i + 1]
        if i < len(known):
            known[i] = get(low << 20 | tokens[i + 1], NONE)
        if i:
            known[i - 1] = get(tokens[i - 1] << 20 | low, NONE)
    return tokens


def merge_long(tokens: list[int], pairs: dict[int, int]) -> list[int]:
    """The same in n log n steps, for windows that had to grow (runs of one character)."""
    n, get = len(tokens), pairs.get
    heap = [r << 40 | i for i in range(n - 1) if (r := get(tokens[i] << 20 | tokens[i + 1])) is not None]
    heapify(heap)
    tokens, after, before = [*tokens, -1], list(range(1, n + 2)), list(range(-1, n))
    while heap:
        top = heappop(heap)
        i, made = top & (1 << 40) - 1, top >> 40
        j = after[i]
        if get(tokens[i] << 20 | tokens[j]) != made:
            continue
        tokens[i], tokens[j] = made, -1
        k = after[i] = after[j]
        before[k] = i
        if (r := get(made << 20 | tokens[k])) is not None:
            heappush(heap, r << 40 | i)
        h = before[i]
        if (r := get(tokens[h] << 20 | made)) is not None:
            heappush(heap, r << 40 | h)
    return [t for t in tokens if t >= 0]


class Codec:
    def __init__(self, path: str, leaf: int = LEAF):
        self.ranks, self.leaf = token_ranks(path), leaf
        self.pairs = pair_ranks(self.ranks)
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self.chunks = Chunks(lambda match: array("i", self.encode_match(match)).tobytes(), b"".join, 1 << 19)
        self.chunks.chunks.most >>= 1

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.leaf_of(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def leaf_of(self, piece: bytes) -> list[int]:
        return merge([self.of_byte[b] for b in piece], self.pairs)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes together.

        Either side's window doubles while the outermost token on that side is not the old one; a
        window that takes in a whole side needs no witness there.
        """
        a = b = 1
        while left and right:
            a, b = min(a, len(left)), min(b, len(right))
            made = self.leaf_of(self.decode(left[-a:] + right[:b]))
            ok_left = a == len(left) or made[0] == left[-a]
            ok_right = b == len(right) or made[-1] == right[b - 1]
            if ok_left and ok_right:
                return left[: len(left) - a] + made + right[b:]
            a, b = (a if ok_left else 2 * a), (b if ok_right else 2 * b)
        return left or right

    def encode_match(self, match: str) -> tuple[int, ...]:
        piece = match.encode()
        whole = self.ranks.get(piece)
        return tuple(self.tree(piece)) if whole is None else (whole,)

    def encode(self, text: str) -> np.ndarray:
        """The ids as 32-bit numbers; matches and chunks are remembered as such bytes and concatenated."""
        return np.frombuffer(b"".join(self.chunks.each(text)), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """Runs of 4,096 tokens are the leaves; pairs of neighbours are concatenated level by level."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with the array ``ids`` in place of the text.  A narrow map.

    Null and empty texts give an empty array; bytes that are not UTF-8 count as U+FFFD; repeated
    rows stay; columns of ``docs`` named like the output are replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(columns):
        code = codec(path)
        made = [code.encode(t.decode("utf-8", "replace")) for t in columns[0].to_pylist()]
        ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*made, np.zeros(0, np.int32)])))]

    sent = docs.withColumn("__bytes", as_bytes(docs, text))
    return map_columns(sent, ["__bytes"], T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), run, drop=("__bytes", text), rows=128)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``encoded`` with the binary column ``decoded`` in place of ``ids``; a null array gives no bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(columns):
        code, column = codec(path), columns[0]
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        ids, ends = column.flatten().to_numpy(), np.cumsum(sizes)
        return [[code.decode(ids[b - n : b].tolist()) for n, b in zip(sizes, ends)]]

    return map_columns(encoded, [ids], T.StructType([T.StructField(out, T.BinaryType())]), run, drop=(ids,), rows=128)


def ids_digest(ids: str = "ids") -> F.Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
