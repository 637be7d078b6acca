"""Exact top-k inner-product search by KD-trees per shard.

Space is cut into cells by median splits of a bounded sample; a shard is a bounded block of one cell's
vectors, under a KD-tree of median splits along the widest dimension, every node with its tight
bounding box.  A query walks a tree best-first: the bound of a box is sum(max(q * low, q * high)), and
a box below the kth score known so far is not opened.  The kth score is propagated: every block of
queries meets a shard of its own cell first; after that each query goes on to those shards alone whose
root box can reach its kth score.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tagloom.session import cut

#: Vectors of a shard, about, queries of a block, vectors of a leaf at most.
SHARD, BLOCK, LEAF = 4096, 512, 128
#: Vectors that the cells are fitted on, about; cells at most; root boxes that a block is held against at once.
SAMPLE, CELLS, BOXES = 16_384, 1024, 256
TREE = "dim int, cell int, chunk int, ids array<bigint>, data binary, depth int, low binary, high binary"
HITS = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Ids and floor(scale * x) of every component; vectors with null or non-finite ones take no part."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v")
    )


def build(data: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Order of the rows, depth, and the boxes of the nodes in heap order (children of i: 2i+1, 2i+2).

    Leaf j of the 2**depth leaves holds the rows order[n * j >> depth : n * (j + 1) >> depth].
    """
    n, dim = data.shape
    depth = max(0, (max(1, -(-n // LEAF)) - 1).bit_length())
    order = np.arange(n)
    low, high = np.zeros((2 ** (depth + 1) - 1, dim), np.int64), np.zeros((2 ** (depth + 1) - 1, dim), np.int64)
    for level in range(depth + 1):
        for j in range(1 << level):
            node, (a, b) = (1 << level) - 1 + j, (n * j >> level, n * (j + 1) >> level)
            if a == b:
                low[node], high[node] = 1, 0
                continue
            part = data[order[a:b]]
            low[node], high[node] = part.min(axis=0), part.max(axis=0)
            if level < depth:
                middle = (n * (2 * j + 1) >> (level + 1)) - a
                widest = int(np.argmax(high[node] - low[node]))
                if 0 < middle < b - a:
                    order[a:b] = order[a:b][np.argpartition(part[:, widest], middle, kind="introselect")]
    return order, depth, low, high


def search(query: np.ndarray, own: int, ids: np.ndarray, data: np.ndarray, depth: int, bounds: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
    """The shard's best (score, id) that may be among the k best of all; ``kth``: kth score so far."""
    n, first_leaf = len(ids), (1 << depth) - 1
    queue, best = [(-bounds[0], 0)], []
    while queue:
        bound, node = heappop(queue)
        if -bound < kth:
            break
        if node < first_leaf:
            for child in (2 * node + 1, 2 * node + 2):
                if bounds[child] >= kth:
                    heappush(queue, (-bounds[child], child))
            continue
        j = node - first_leaf
        a, b = n * j >> depth, n * (j + 1) >> depth
        scores = data[a:b] @ query
        hit = np.nonzero(scores >= kth)[0]
        best += [(int(s), int(i)) for s, i in zip(scores[hit], ids[a:b][hit]) if i != own]
        if len(best) >= k:
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            kth = max(kth, best[-1][0])
    return best


def exact_type(data: np.ndarray, queries: np.ndarray) -> type:
    """Doubles where every sum of products is an exact integer there, else 64-bit integers."""
    most = max([1, *(int(np.abs(x).max()) for x in (data, queries) if x.size)])
    return np.float64 if most * most * max(1, data.shape[1]) < 1 << 53 else np.int64


def fit_cells(sample: np.ndarray, n_cells: int) -> list[tuple[int, int]]:
    """(dimension, value) of the splits in heap order: at most ``n_cells`` cells, about equal in the sample."""
    depth = max(0, n_cells.bit_length() - 1)
    splits, parts = [], [sample]
    for _ in range(depth):
        halves = []
        for part in parts:
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if part.size else 0
            at = int(np.median(part[:, widest])) if part.size else 0
            splits.append((widest, at))
            right = part[:, widest] > at if part.size else np.zeros(len(part), bool)
            halves += [part[~right], part[right]]
        parts = halves
    return splits


def cell_of(data: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """The cell of each vector: the leaf that the splits lead to."""
    node = np.zeros(len(data), np.int64)
    dims, values = (np.array([x[c] for x in splits] or [0], np.int64) for c in (0, 1))
    for _ in range((len(splits) + 1).bit_length() - 1):
        node = 2 * node + 1 + (data[np.arange(len(data)), dims[node]] > values[node])
    return node - len(splits)


def with_cells(vectors: DataFrame, splits: list[tuple[int, int]], dim: int) -> DataFrame:
    """``vectors`` with dim and cell; those of another dimension than ``dim`` are in cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            n = v.value_lengths().to_numpy()
            cell = np.zeros(len(n), np.int32)
            mine = np.nonzero(n == dim)[0]
            if dim and len(mine):
                cell[mine] = cell_of(v.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), dim), splits)
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(n.astype(np.int32)), pa.array(cell)], names=["vec_id", "v", "dim", "cell"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id bigint, v array<bigint>, dim int, cell int")


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (a written table of dim, cell, at) with chunk: about ``size`` rows of a cell, dealt by their places."""
    n = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    return rows.join(n, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("at"), "__n").cast("int")).drop("__n")


def index(placed: DataFrame) -> DataFrame:
    """One row for each shard (dim, cell, chunk): ids and vectors in tree order, and the boxes."""
    arrow = to_arrow_schema(_parse_datatype_string(TREE))
    key = ["dim", "cell", "chunk"]
    grouped = chunked(placed, SHARD).groupBy(*key).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")).select(*key, "rows.vec_id", "rows.v")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, cell, chunk = (batch.column(c)[i].as_py() for c in range(3))
                ids = batch.column(3)[i].values.to_numpy()
                data = np.asarray(batch.column(4)[i].values.flatten()).reshape(len(ids), dim)
                order, depth, low, high = build(data)
                yield pa.RecordBatch.from_pylist([{"dim": dim, "cell": cell, "chunk": chunk, "ids": ids[order], "data": data[order].tobytes(), "depth": depth, "low": low.tobytes(), "high": high.tobytes()}], schema=arrow)

    return grouped.mapInArrow(plant, TREE)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest inner products of each query with every other vector of its dimension.

    Both inputs: ``vec_id``, ``v`` (array of long); other columns go.  Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id; fewer rows where there are fewer candidates.  A
    query's own vec_id is no candidate.  Repeated query rows count once; of several vectors under one id
    the least is the query.  Repeated vectors are dealt by their places, so no id makes a large shard.
    Empty inputs give an empty result.  Nothing is broadcast, and no task holds more than a shard and a
    block, or a block and some boxes.
    """
    vectors = cut(vectors.select("vec_id", "v"))
    total = vectors.count()
    sampled = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < F.lit(int(min(1.0, SAMPLE / max(1, total)) * 1_000_000))).limit(2 * SAMPLE)
    rows = [r[0] for r in sampled.select("v").collect()]
    dims = [len(r) for r in rows]
    dim = max(sorted({*dims}), key=dims.count, default=0)
    sample = np.array([r for r in rows if len(r) == dim], np.int64).reshape(-1, dim) if dim else np.zeros((0, 1), np.int64)
    splits = fit_cells(sample, min(CELLS, -(-total // SHARD)) or 1)
    placed = cut(with_cells(vectors, splits, dim).withColumn("at", F.monotonically_increasing_id()))
    trees = cut(index(placed))

    asked = with_cells(queries.groupBy("vec_id").agg(F.min("v").alias("v")), splits, dim)
    asked = cut(asked.withColumn("at", F.monotonically_increasing_id()))
    grouped = chunked(asked, BLOCK).groupBy("dim", "cell", "chunk").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    blocks = cut(grouped.select("dim", "cell", "chunk", F.col("rows.vec_id").alias("q_ids"), F.col("rows.v").alias("q")))
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))

    n_chunks = trees.groupBy("dim", "cell").agg(F.count("*").alias("__n"))
    own = blocks.join(n_chunks, ["dim", "cell"]).select("dim", "cell", F.pmod(F.col("chunk"), F.col("__n")).cast("int").alias("chunk"), "block", "q_ids", "q", F.lit(None).cast("array<double>").alias("kth"))
    first = cut(_meet(trees, own, k))
    seen = own.select("dim", "cell", "chunk", "block")
    reached = first.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "kth")
    each = blocks.select("dim", "block", F.posexplode(F.arrays_zip("q_ids", "q")).alias("i", "x")).select("dim", "block", "i", F.col("x.q_ids").alias("query_id"), F.col("x.q").alias("q"))
    each = each.join(reached, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    asked = each.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("i", "query_id", "q", "kth"))).alias("x"))
    asked = cut(asked.select("dim", "block", F.col("x.query_id").alias("q_ids"), F.col("x.q").alias("q"), F.col("x.kth").alias("kth")))

    routes = cut(_routes(trees, asked).join(seen, ["dim", "cell", "chunk", "block"], "left_anti"))
    picked = lambda c: F.transform("at", lambda i: F.get(c, i)).alias(c)
    sent = routes.join(asked, ["dim", "block"]).select("dim", "cell", "chunk", "block", *map(picked, ("q_ids", "q", "kth")))
    hits = first.unionByName(_meet(trees, sent, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbers(cell: pa.Scalar, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int64).reshape(rows, dim)


def _routes(trees: DataFrame, asked: DataFrame) -> DataFrame:
    """(dim, cell, chunk, block, at): the shards whose root box can reach the kth score of queries ``at``.

    Blocks of queries meet all root boxes of their dimension, some at a time; vectors stay where they are.
    """
    root = lambda c: F.substring(F.col(c), F.lit(1), 8 * F.col("dim")).alias(c)
    boxes = trees.select("dim", "cell", "chunk", root("low"), root("high"), F.pmod(F.xxhash64("cell", "chunk"), F.lit(max(1, -(-trees.count() // BOXES)))).alias("g"))
    boxes = cut(boxes.groupBy("dim", "g").agg(F.collect_list(F.struct("cell", "chunk", "low", "high")).alias("boxes")))
    met = asked.select("dim", "block", "q", "kth").join(boxes, "dim").select("dim", "block", "q", "kth", "boxes")
    schema = "dim int, cell int, chunk int, block bigint, at array<int>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                kth = batch.column(3)[i].values.to_numpy()
                q = np.asarray(batch.column(2)[i].values.flatten()).reshape(len(kth), dim)
                inside = batch.column(4)[i].values
                low, high = (np.array([_numbers(x, 1, dim)[0] for x in inside.field(c)], np.int64).reshape(len(inside), dim) for c in ("low", "high"))
                kind = exact_type(np.concatenate((low, high)), q)
                low, high, q = (x.astype(kind) for x in (low, high, q))
                may = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T >= kth[:, None]
                at = [(j, np.nonzero(may[:, j])[0].tolist()) for j in range(len(inside)) if may[:, j].any()]
                cells, chunks = inside.field("cell").to_pylist(), inside.field("chunk").to_pylist()
                yield pa.RecordBatch.from_pylist([{"dim": dim, "cell": cells[j], "chunk": chunks[j], "block": block, "at": xs} for j, xs in at], schema=arrow)

    return met.mapInArrow(run, schema)


def _meet(trees: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Hits of every block in its shard; rows of trees and blocks are bounded."""
    arrow = to_arrow_schema(_parse_datatype_string(HITS))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                dim, depth = row["dim"].as_py(), row["depth"].as_py()
                ids, q_ids = row["ids"].values.to_numpy(), row["q_ids"].values.to_numpy()
                data = _numbers(row["data"], len(ids), dim)
                low, high = (_numbers(row[c], 2 ** (depth + 1) - 1, dim) for c in ("low", "high"))
                q = np.asarray(row["q"].values.flatten()).reshape(len(q_ids), dim)
                kind = exact_type(data, q)
                data, low, high, q = (x.astype(kind) for x in (data, low, high, q))
                bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                kth = row["kth"].values.to_numpy() if row["kth"].is_valid else np.full(len(q_ids), -np.inf)
                out = [(int(qi), i, s) for n, qi in enumerate(q_ids) for s, i in search(q[n], qi, ids, data, depth, bounds[n], k, kth[n])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], schema=arrow)

    pairs = blocks.join(trees, ["dim", "cell", "chunk"]).select("dim", "ids", "data", "depth", "low", "high", "q_ids", "q", "kth")
    return pairs.mapInArrow(walk, HITS)
