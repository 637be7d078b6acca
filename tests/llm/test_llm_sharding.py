"""Shards of exact sizes, gapless slots and the law of the counts."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.llm import queries, sharding


def test_query(spark, sf, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op10_sharding(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    shards = Counter(r.shard for r in rows)
    assert {*shards} == {*range(24)} and max(shards.values()) - min(shards.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in shards.items() for i in range(n)}
    again = queries.op10_sharding(spark, sf).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {r.doc_id: (r.shard, r.slot) for r in again}


@pytest.mark.parametrize("good,total,draws", [(7, 20, 9), (500, 1000, 24), (3, 1000, 400), (40, 60, 50)])
def test_hypergeometric_law(good, total, draws):
    """Chi-square of 20,000 draws against the law."""
    rng, n = random.Random(good), 20_000
    seen = Counter(sharding.hypergeometric(rng, good, total, draws) for _ in range(n))
    low, high = max(0, draws + good - total), min(good, draws)
    law = {k: n * math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws) for k in range(low, high + 1)}
    big = {k: e for k, e in law.items() if e >= 10}
    assert {*seen} <= {*law}
    assert sum((seen[k] - e) ** 2 / e for k, e in big.items()) < len(big) + 5 * math.sqrt(2 * len(big)) + 5


def test_matrix_has_exact_sums():
    for seed, rows in enumerate([[5, 0, 17, 3], [1], [0], [1000] * 7, [10**9, 3, 10**8]]):
        matrix = sharding.communication_matrix(rows, 6, seed)
        assert [sum(line) for line in matrix] == rows
        columns = [sum(c) for c in zip(*matrix)]
        assert max(columns) - min(columns) <= 1


def test_shuffle_is_uniform(spark):
    """Over many rows, a row's neighbours in the input are no more often in its shard than chance says."""
    n = 24_000
    placed = sharding.shuffle_into_shards(spark.range(n).withColumnRenamed("id", "doc_id"), 24).collect()
    at = {r.doc_id: r for r in placed}
    together = sum(at[i].shard == at[i + 1].shard for i in range(n - 1))
    assert abs(together - n / 24) < 5 * math.sqrt(n / 24)
    early = sum(at[i].slot < 500 for i in range(n // 2))
    assert abs(early - n / 4) < 5 * math.sqrt(n / 16)


def test_awkward_rows(awkward, none):
    out = sharding.shuffle_into_shards(awkward, 5)
    rows = out.collect()
    assert [c for c in out.columns if c in ("shard", "slot")] == ["shard", "slot"] and len(out.columns) == len(awkward.columns)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in awkward.collect())
    counts = Counter(r.shard for r in rows)
    assert sorted(counts.values()) == [2, 3, 3, 3, 3] and {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in counts.items() for i in range(n)}
    assert sharding.shuffle_into_shards(none, 5).count() == 0


def test_no_key_is_hot(spark):
    """Rows without an id, all alike, are spread over shards and bins like others."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    placed = sharding.shuffle_into_shards(rows, 7).collect()
    counts = Counter(r.shard for r in placed)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in placed} == {(s, i) for s, n in counts.items() for i in range(n)}


def test_more_partitions_than_the_matrix_may_have(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 20)
    placed = sharding.shuffle_into_shards(spark.range(500, numPartitions=16), 5).collect()
    assert Counter(r.shard for r in placed) == dict.fromkeys(range(5), 100) and {r.id for r in placed} == {*range(500)}
