"""Exact top-k search against brute force."""

import numpy as np
import pytest

from tagloom.llm import kdtree, queries


def brute(rows, wanted, k):
    """rows: [(id, vector)]; {query: [(id, score)]}"""
    out = {}
    for q in wanted:
        v = next(v for i, v in sorted(rows, key=lambda x: (x[0], x[1])) if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return {q: h for q, h in out.items() if h}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None]
    assert listed(queries.op6_topk(spark, sf)) == brute(rows, [i for i, _ in rows if i % 50 == 0], 5)


@pytest.mark.parametrize("shard,block,leaf", [(4096, 512, 128), (40, 7, 4), (25, 6, 1)])
def test_many_shards_and_ties(spark, monkeypatch, shard, block, leaf):
    for name, v in (("SHARD", shard), ("BLOCK", block), ("LEAF", leaf)):
        monkeypatch.setattr(kdtree, name, v)
    r = np.random.default_rng(shard)
    rows = [(i, r.integers(-3, 4, 3).tolist()) for i in range(200)] + [(200 + i, [1, 1, 1]) for i in range(60)] + [(300, [5, 5]), (301, [1, 2]), (302, [9])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    asked = df.where("vec_id % 7 = 0 OR vec_id >= 298")
    assert listed(kdtree.top_k(df, asked, 5)) == brute(rows, [i for i, _ in rows if i % 7 == 0 or i >= 298], 5)


def test_boxes_are_tight():
    r = np.random.default_rng(5)
    data = r.integers(-99, 99, (1000, 4))
    order, depth, low, high = kdtree.build(data)
    assert sorted(order.tolist()) == list(range(1000)) and depth == 3
    for level in range(depth + 1):
        for j in range(1 << level):
            part = data[order[1000 * j >> level : 1000 * (j + 1) >> level]]
            node = (1 << level) - 1 + j
            assert (low[node] == part.min(axis=0)).all() and (high[node] == part.max(axis=0)).all()


def test_most_leaves_stay_closed():
    """On clustered vectors the bounds spare some leaves."""
    r = np.random.default_rng(6)
    data = np.concatenate([r.normal(c, 1, (128, 8)) for c in np.eye(8) * 100]).astype(int)
    order, depth, low, high = kdtree.build(data)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(at)
            return np.ndarray.__getitem__(self.view(np.ndarray), at)

    q = data[0]
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    best = kdtree.search(q, -1, order, data[order].view(Watched), depth, bounds, 5, -np.inf)
    assert len(seen) < 8 and [s for s, _ in best] == sorted((data @ q).tolist(), reverse=True)[:5]


def test_clustered_vectors_are_routed_to_few_shards(spark, monkeypatch):
    """Queries go on to the shards alone that can hold one of their best; the result is that of all pairs."""
    for name, v in (("SHARD", 50), ("BLOCK", 16), ("LEAF", 8), ("BOXES", 3)):
        monkeypatch.setattr(kdtree, name, v)
    r = np.random.default_rng(8)
    rows = [(i, (r.normal(0, 2, 4) + 200 * np.eye(4)[i % 4] * (1 + i % 3)).astype(int).tolist()) for i in range(800)] + [(9000, [7, 7, 7, 7])] * 120
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    asked = df.where("vec_id % 50 = 0")
    seen = []
    monkeypatch.setattr(kdtree, "_meet", lambda trees, blocks, k, f=kdtree._meet: (seen.append((trees.count(), blocks.select("block", "cell", "chunk").distinct().count(), blocks.select("block").distinct().count())), f(trees, blocks, k))[1])
    assert listed(kdtree.top_k(df, asked, 5)) == brute(rows, sorted({i for i, _ in rows if i % 50 == 0}), 5)
    shards, met, n_blocks = seen[1]
    assert shards >= 16 and met < 0.6 * shards * n_blocks


def test_cells_are_those_of_the_splits():
    data = np.random.default_rng(1).integers(-50, 50, (500, 3))
    splits = kdtree.fit_cells(data, 8)
    cells = kdtree.cell_of(data, splits)
    assert len(splits) == 7 and {*cells.tolist()} == {*range(8)} and np.bincount(cells).max() < 100
    assert kdtree.fit_cells(data, 1) == [] and not kdtree.cell_of(data, []).any()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (0, [0.5, 1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [-0.001, 2.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS rank", "3 AS score")
    v = kdtree.quantised(df)
    assert sorted((r.vec_id, list(r.v)) for r in v.collect()) == [(0, [128, 256]), (0, [128, 256]), (5, [-1, 512]), (6, [])]
    got = listed(kdtree.top_k(v, v, 5))
    assert got == {0: [(5, 130944)], 5: [(0, 130944), (0, 130944)]}
    assert kdtree.top_k(v, v.where("false"), 5).count() == 0 and kdtree.top_k(v.where("false"), v, 5).count() == 0
