"""Packing by optimal length buckets.

Documents are cut into pieces of at most ``most`` tokens.  Dynamic programming over the histogram of
all pieces chooses the bucket boundaries with the least padding; inside each bucket, batches of
pieces padded to its boundary are formed under a token budget.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.bpe_files import token_ranks
from tagloom.llm.common import as_bytes, gapless, map_columns
from tagloom.llm.token_counts import Counter
from tagloom.session import cut

MOST, BUCKETS, BUDGET, BIN_ROWS = 2048, 16, 65_536, 1 << 20


@lru_cache(maxsize=1)
def lengths_of() -> Counter:
    """Counts as ``count_tokens`` does, with the public library for each pre-token."""
    ranks = token_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Counter(public_tokenizers.path("byte_bpe_50k.json"), lambda s: len(library._encode_single_piece(s)), 1 << 18)


def with_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` in place of the text: the same numbers as ``count_tokens``.

    A narrow map.  Null and empty texts have 0 tokens; texts of any length are counted alike."""

    def run(columns):
        count = lengths_of()
        return [[count(t.decode("utf-8", "replace")) for t in columns[0].to_pylist()]]

    sent = docs.withColumn("__bytes", as_bytes(docs, text))
    schema = T.StructType([T.StructField("n_tokens", T.LongType())])
    return map_columns(sent, ["__bytes"], schema, run, drop=("__bytes", text))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` buckets that minimise the padding in all.

    cost(i, j): what the lengths i+1..j are padded by to reach length j.  One pass a bucket over all
    (i, j); of equal splits the one with the earliest cut.  Distinct lengths are bounded by the
    longest piece.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n, k = len(x), min(buckets, len(x))
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(c)))
    tokens = np.concatenate(([0], np.cumsum(c * x)))
    far = np.iinfo(np.int64).max // 4
    best = np.concatenate(([0], np.full(n, far)))
    cuts = []
    for _ in range(k):
        now, at = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = best[:j] + x[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            at[j] = int(np.argmin(total))
            now[j] = total[at[j]]
        cuts.append(at)
        best = now
    ends, j = [], n
    for at in reversed(cuts):
        if j <= 0:
            break
        ends.append(int(x[j - 1]))
        j = int(at[j])
    return ends[::-1]


def pieces(counted: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, piece, token_start and length of every piece; a document without tokens has one of length 0."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / most).cast("int") - 1, F.lit(0))
    cut_up = counted.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    return cut_up.select("doc_id", "piece", start.alias("token_start"), F.least(F.col("n") - start, F.lit(most)).cast("int").alias("length"))


def pack(counted: DataFrame, most: int = MOST, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 42) -> DataFrame:
    """Every piece with its bucket, the length it is padded to, its batch and its slot there.

    ``counted``: doc_id and n_tokens (null counts as 0).  A batch holds at most budget // padded
    pieces of one bucket, at least one; only the last of a bucket may be smaller.  A piece's place is drawn by
    its row, not by its id, so repeated rows and null ids are spread and packed like others; an empty input gives an empty output.  The histogram that comes
    to the driver has at most ``most`` + 1 rows.
    """
    if not 0 < most <= budget:
        raise ValueError("a piece has to fit into a batch")
    cut_up = cut(pieces(counted, most).withColumn("__m", F.monotonically_increasing_id()))
    histogram = cut_up.groupBy("length").count().collect()
    ends = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    rows = sum(r[1] for r in histogram)
    padded = F.array(*[F.lit(e) for e in ends]) if ends else F.array(F.lit(0))
    bucketed = cut_up.withColumn("bucket", F.size(F.filter(padded, lambda e: e < F.col("length")))).withColumn("padded", F.element_at(padded, F.col("bucket") + 1))
    key = lambda k: F.xxhash64(F.lit(seed * 8 + k), "__m")
    ranked = gapless(bucketed, "bucket", key, ["__m"], max(32, -(-rows // BIN_ROWS)), "at")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded", F.lit(1)))).cast("long")
    return ranked.select("doc_id", "piece", "token_start", "length", "bucket", "padded", F.floor(F.col("at") / room).alias("batch"), (F.col("at") % room).cast("int").alias("slot"))
