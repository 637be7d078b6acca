"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a doubly linked list; a heap holds its adjacent pairs by (rank,
position).  The lowest-rank, leftmost pair is merged until none is left.  The count is the number
of initial symbols minus the number of merges; no identifier is looked up or emitted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import or_

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.bpe_files import Chunks, merge_ranks
from tagloom.llm.common import as_bytes, map_columns

#: Bits of a heap entry, and each byte as the left one of a pair.
POSITION, SHIFTED = (1 << 40) - 1, [b << 20 for b in range(256)]

OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def number_merges(ranks: dict[tuple[bytes, bytes], int]) -> tuple[dict[int, int], list[int]]:
    """left << 20 | right -> rank, and rank -> result; symbols as numbers, bytes as they are."""
    number = {bytes([b]): b for b in range(256)}
    for left, right in ranks:
        number.setdefault(left + right, len(number))
    if len(number) > 1 << 20:
        raise ValueError("more symbols than a pair key holds")
    return {number[a] << 20 | number[b]: r for (a, b), r in ranks.items()}, [number[a + b] for a, b in ranks]


def count_symbols(piece: bytes, pairs: dict[int, int], result: list[int]) -> int:
    """Symbols that are left of ``piece`` when no listed pair is adjacent any more.

    A heap entry is rank << 40 | position; one whose pair is gone when it is popped is skipped.
    A dead symbol is -1, as is the one past the end: no key with them is in ``pairs``.
    """
    n = left = len(piece)
    get = pairs.get
    heap = [r << 40 | i for i, r in enumerate(map(get, map(or_, map(SHIFTED.__getitem__, piece), piece[1:]))) if r is not None]
    if not heap:
        return n
    heapify(heap)
    symbol, after, before = [*piece, -1], list(range(1, n + 2)), list(range(-1, n))
    while heap:
        top = heappop(heap)
        i = top & POSITION
        j = after[i]
        if get(symbol[i] << 20 | symbol[j]) != top >> 40:
            continue
        made = symbol[i] = result[top >> 40]
        symbol[j] = -1
        k = after[i] = after[j]
        before[k] = i
        left -= 1
        r = get(made << 20 | symbol[k])
        if r is not None:
            heappush(heap, r << 40 | i)
        h = before[i]
        r = get(symbol[h] << 20 | made)
        if r is not None:
            heappush(heap, r << 40 | h)
    return left


class Counter:
    """Counts whole texts as the library does: special strings are one token each.

    ``one`` counts the symbols of a pre-token; by the heap, if it is not given.  ``most``: pre-tokens
    and chunks that are remembered.
    """

    def __init__(self, path: str, one: Callable[[bytes], int] | None = None, most: int = 1 << 20):
        ranks, special = merge_ranks(path)
        if one is None:
            pairs, result = number_merges(ranks)
            one = lambda s: count_symbols(s, pairs, result)
        self.chunks = Chunks(lambda s: one(s.encode()), sum, most)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        return len(parts) - 1 + sum(sum(self.chunks.each(part)) for part in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` in place of the text.

    A narrow map: no shuffle, each text is read once.  Null and empty texts have 0 bytes and 0
    tokens; bytes that are not UTF-8 count as U+FFFD; repeated rows stay; columns of ``docs`` named
    like the outputs are replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(columns):
        count = counter(path)
        texts = columns[0].to_pylist()
        return [[len(t) for t in texts], [count(t.decode("utf-8", "replace")) for t in texts]]

    sent = docs.withColumn("__bytes", as_bytes(docs, text))
    return map_columns(sent, ["__bytes"], OUT, run, drop=("__bytes", text))


def with_limit(counted: DataFrame, limit: int = 1024) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
