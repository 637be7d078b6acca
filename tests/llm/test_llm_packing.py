"""Optimal buckets against all splits, and batches against their rules."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from tagloom.llm import packing, queries


def waste(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        lengths = sorted(r.sample(range(50), r.randint(1, 9)))
        counts = [r.randint(1, 30) for _ in lengths]
        k = r.randint(1, 5)
        ends = packing.boundaries(lengths[::-1], counts[::-1], k)
        best = min(waste(lengths, counts, [*c, lengths[-1]]) for j in range(min(k, len(lengths))) for c in combinations(lengths[:-1], j))
        assert len(ends) <= k and ends[-1] == lengths[-1] and waste(lengths, counts, ends) == best
    assert packing.boundaries([], [], 4) == []


def hold(rows, tokens, most, budget):
    """Pieces make up their documents; batches keep the budget; only a bucket's last one may be smaller."""
    pieces, batches, buckets = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.token_start, r.length))
        batches[r.bucket, r.batch].append(r.slot)
        buckets[r.bucket].add(r.padded)
        assert r.length <= r.padded <= most
    for i, n in tokens.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces.pop(i))):
            assert (piece, start) == (k, at)
            at += length
        assert at == n
    assert not pieces
    last = {b: max(x for c, x in batches if c == b) for b in buckets}
    for (b, x), slots in batches.items():
        (padded,) = buckets[b]
        room = max(1, budget // max(1, padded))
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == room or x == last[b] and len(slots) <= room)
        assert x <= last[b]


def test_query(spark, sf):
    tokens = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf).collect()}
    rows = queries.op2_packing(spark, sf).collect()
    hold(rows, tokens, packing.MOST, packing.BUDGET)
    assert len({r.bucket for r in rows}) <= packing.BUCKETS
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.length] += 1
    ends = packing.boundaries([*lengths], [*lengths.values()], packing.BUCKETS)
    assert sorted({r.padded for r in rows}) == ends


@pytest.mark.parametrize("most,buckets,budget", [(4, 2, 9), (7, 3, 7), (100, 1, 1000)])
def test_small_budgets(spark, most, buckets, budget):
    r = random.Random(most)
    tokens = {i: r.choice([0, 1, 2, 3, 5, 8, 40]) for i in range(120)}
    df = spark.createDataFrame([*tokens.items()], "doc_id long, n_tokens long").selectExpr("*", "1 AS bucket", "2 AS PADDED", "'x' AS slot", "3 AS piece")
    hold(packing.pack(df, most, buckets, budget).collect(), tokens, most, budget)


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, 3), (1, None), (1, 2), (1, 2), (2, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.pack(df, 4, 2, 8).collect()
    assert len(out) == 5 and len({(r.bucket, r.batch, r.slot) for r in out}) == 5
    assert packing.pack(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 10, 2, 9)


def test_lengths_are_the_counted_tokens(spark, awkward):
    """Also for special strings and for runs that are very long."""
    from tagloom.llm.token_counts import count_tokens

    long = spark.createDataFrame([(i, t * 30_000) for i, t in enumerate([" ", "ab", "a b ", "\n\t", "é😀"], 100)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(long)
    counted, lengths = (sorted((r.doc_id or 0, r.n_tokens) for r in f(docs).collect()) for f in (count_tokens, packing.with_lengths))
    assert counted == lengths
