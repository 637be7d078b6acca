"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The partitions are those in which the rows arrive.  Each is permuted where it is, by a sort on random
numbers, and written once with the rows' positions.  How many rows of each partition go to each shard
is drawn from the multivariate hypergeometric law that a uniform permutation of all rows would give;
the permuted partition deals its rows out by those counts, the rows are exchanged, once, and every
shard is permuted again.  Only DataFrame functions touch rows; the driver sees one count a partition.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import gapless, without
from tagloom.session import cut

#: Rows of a bin of a shard, about; bins of a shard at least; numbers of the communication matrix at most.
ROWS, LEAST_BINS, CELLS = 1 << 20, 32, 1 << 20
#: monotonically_increasing_id: the partition, then this many bits for the position in it.
BITS = 33


def hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of ``draws`` rows, drawn without return from ``total``, are among ``good``.

    Inversion outward from the mode; the pmf there comes from log-gamma.
    """
    low, high = max(0, draws + good - total), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = up = down = math.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    u, a, b = rng.random() - p, mode, mode
    while u > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (draws - b) / ((b + 1) * (total - good - draws + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > low:
            down *= a * (total - good - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
    return mode


def communication_matrix(rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Counts by partition and shard: row sums as given, column sums at most one apart."""
    rng, left = random.Random(seed), sum(rows)
    room = [left // n_shards + (s < left % n_shards) for s in range(n_shards)]
    matrix = []
    for n in rows:
        line, free, todo = [], left, n
        for s in range(n_shards):
            x = hypergeometric(rng, room[s], free, todo) if todo else 0
            free -= room[s]
            room[s] -= x
            todo -= x
            line.append(x)
        left -= n
        matrix.append(line)
    return matrix


def shuffle_into_shards(rows: DataFrame, n_shards: int = 24, seed: int = 42) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    All columns are carried, and none is looked at: nulls, equal ids and equal rows are dealt like any
    others, and no value is a key, so none can be hot.  Columns named ``shard`` or ``slot`` are replaced.
    An empty input gives an empty output; shards may be empty if there are fewer rows than shards.

    The communication matrix has at most CELLS numbers, so that it can be broadcast: beyond
    CELLS / n_shards partitions neighbouring ones are read by one task.  Input in the same partitions
    and order gives the same output.
    """
    if not 0 < n_shards <= CELLS:
        raise ValueError(f"between 1 and {CELLS} shards")
    spark, rows = rows.sparkSession, without(rows, ["shard", "slot", "__r", "__m"])
    permuted = rows.coalesce(CELLS // n_shards).withColumn("__r", F.rand(seed)).sortWithinPartitions("__r").drop("__r")
    placed = cut(permuted.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", BITS).cast("int")
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    matrix = communication_matrix([n for _, n in counts], n_shards, seed)
    deal = spark.createDataFrame([(p, list(accumulate(line))) for (p, _), line in zip(counts, matrix)], "__p int, __ends array<bigint>")
    at = F.col("__m").bitwiseAND(F.lit((1 << BITS) - 1))
    dealt = placed.withColumn("__p", part).join(F.broadcast(deal), "__p").withColumn("shard", F.size(F.filter("__ends", lambda e: e <= at)))
    n_bins = max(LEAST_BINS, -(-sum(n for _, n in counts) // (n_shards * ROWS)))
    draw = lambda k: F.xxhash64(F.lit(seed * 8 + k), "__m")
    return gapless(dealt.drop("__p", "__ends"), "shard", draw, ["__m"], n_bins, "slot").select(*[f"`{c}`" for c in rows.columns], "shard", "slot")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``size`` (UTF-8 bytes of the text plus 8) and ``text_crc32`` of each document."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
