"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints that differ in at most 4 of 64 bits differ in at most 2 bits of one 32-bit half.  The
anchors of a half are a covering code: 26 information bits of the perfect (31, 26) Hamming code and
the last bit as it is; every half-word is within covering radius 1 of an anchor.  Two half-words at
distance 2 have a word between them, at 1 from both, and that word's anchor is within 1 + 1 of both:
so replicating each fingerprint to all anchors within covering radius plus (half the pair's) threshold
brings every linked pair together.  That is 17 anchors a half (2 for code words).

Fingerprints are compared per anchor; an anchor gives a spanning forest of its links, never all
pairs.  An anchor with many fingerprints is cut into chunks and every two chunks meet in a task of
their own, so no link is lost and no group is unbounded.

Near copies by the Jaccard similarity of their word shingles (``copy_links``) differ in too many bits for
that: at 0.8, in 15 % of them.  Their fingerprints are wider, 2,048 bits, cut into 128 blocks of 16.  A
block's anchor is its nearest word of the perfect (15, 11) Hamming code beside the last bit as it is.
Nodes that share an anchor of any block are compared by 192 bits, then by all bits, and the shingle sets
of those that remain exactly.  The many anchors of a large group of near copies each give a part of it, so a
node would meet another centre in each: such parts are merged into the one group that they connect to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import as_bytes, map_columns
from tagloom.session import cut, drop_cut

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Near copies: words of a shingle, least Jaccard similarity, 64-bit words of a wide fingerprint, its blocks.  Of
#: a pair at 0.8 a bit differs with a chance of acos(8 / 9) / pi = 0.1515, so a block's anchors are equal with
#: one of 0.1265 and none of 128 is with 3e-8; of the smallest such sets, of 4 and 5 shingles, with 3e-5.
WORDS, JACCARD, WIDE = 5, 0.8, 32
BLOCKS = 4 * WIDE
#: Shares of the bits, over that chance, that may differ in the first 192 and in all bits; one node in so many is counted.
FIRST, FIRST_OVER, ALL_OVER, SAMPLE = 3, 0.17, 0.1, 8
#: Rounds of pairs with one centre of each band, before all pairs that are left; nodes of a connected group whose bands are merged in any case.
ROUNDS, SMALL = 2, 64
#: Bytes of a text split at once; shingles whose bits are counted at once; fingerprints of a chunk, about;
#: rows of its matrix compared at once; shingles of a chunk of sets, about.
BYTES, HASHES, CHUNK, STRIP, SHINGLES = 1 << 22, 1 << 16, 2048, 256, 1 << 19


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles of a text, block by block, repeats included.

    Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lowered.  A text of fewer
    than k words gives one hash, of all its words; one without words gives none.
    """
    digest, carry, at, any_hash = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        end = at + BYTES
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = carry + text[at:end].lower().split()
        at = end
        n = len(words)
        if n < k:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        any_hash = True
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)
        carry = words[n - k + 1 :]
    if carry and not any_hash:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the hashes; no words: 0.  Signed, as Spark's long."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, k):
        n += len(hashes)
        for i in range(0, len(hashes), HASHES):
            ones += np.unpackbits(hashes[i : i + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", k: int = SHINGLE) -> DataFrame:
    """``docs`` with the long ``fp`` in place of the text; null counts as empty.  A narrow map."""
    sent = docs.withColumn("__bytes", as_bytes(docs, text))
    return map_columns(sent, ["__bytes"], T.StructType([T.StructField(out, T.LongType())]), lambda c: [[fingerprint(t, k) for t in c[0].to_pylist()]], drop=("__bytes", text))


def anchor_flips() -> list[list[int]]:
    """For each of the 32 syndromes of the Hamming code: what to flip to reach the anchors within 2."""
    flips = [[0, 1 << 31]]
    for s in range(1, 32):
        near = 1 << (s - 1)
        flips.append([near, near | 1 << 31, *((1 << (a - 1)) | (1 << (b - 1)) for a, b in combinations(range(1, 32), 2) if a ^ b == s)])
    return flips


def anchors(fp: Column) -> Column:
    """Array of the anchors of a fingerprint: half << 32 | code word."""
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in line]) for line in anchor_flips()])
    halves = []
    for half in (0, 1):
        word = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        bits = [F.bit_count(word.bitwiseAND(F.lit(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)))).bitwiseAND(F.lit(1)) for k in range(5)]
        syndrome = sum((b * (1 << k) for k, b in enumerate(bits[1:], 1)), bits[0])
        flip = lambda w, h: lambda m: w.bitwiseXOR(m) + F.lit(h << 32)
        halves.append(F.transform(F.element_at(flips, syndrome + 1), flip(word, half)))
    return F.concat(*halves)


def forest(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """(least member, member) for each other member of each connected group of an anchor."""
    n = len(fps)
    if n == 2:
        a, b = sorted(map(int, fps))
        return [(a, b)] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= threshold else []
    near = np.empty((n, n), bool)
    for i in range(0, n, STRIP):
        near[i : i + STRIP] = np.bitwise_count((fps[i : i + STRIP, None] ^ fps[None, :]).view(np.uint64)) <= threshold
    out = []
    for group in connected(near):
        members = np.sort(fps[group])
        out += [(int(members[0]), int(m)) for m in members[1:]]
    return out


def connected(near: np.ndarray) -> Iterator[np.ndarray]:
    """Masks of the connected groups of two members or more; ``near``: who is near whom, and oneself."""
    todo = near.sum(axis=1) > 1
    while todo.any():
        group = np.zeros(len(near), bool)
        front = np.zeros(len(near), bool)
        front[np.argmax(todo)] = True
        while front.any():
            group |= front
            front = near[front].any(axis=0) & ~group
        todo &= ~group
        yield group


def grown(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: merged, never collected on the driver to be broadcast.

    A few MB of Parquet are within Spark's broadcast threshold and many times that on the driver's heap.
    """
    return table.hint("merge")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints; ``fps``: distinct longs ``fp``."""
    if threshold > 4:
        raise ValueError("two halves with covering radius 1 hold for thresholds up to 4")
    near = fps.select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
    counts = near.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    met = (
        near.join(grown(counts), "anchor")
        .select("anchor", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .groupBy("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
            found: set[tuple[int, int]] = set()
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                found.update(forest(flat[a:b], threshold))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return met.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root: the least node of its component.

    Every round each node hooks to its least neighbour, the hooks are shortened once, and the graph
    is contracted.  Tables between rounds are written to the shared folder, and removed after the next;
    joins run between such tables, so that adaptive execution can split the keys of large components.
    """
    edges = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")))
    nodes = cut(edges.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        hook = cut(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = cut(hook.join(grown(up), "p").select("u", F.col("pp").alias("p")))
        named = cut(nodes.join(grown(parent), nodes["root"] == parent["u"], "left").select("node", F.coalesce("p", "root").alias("root")))
        left = cut(edges.join(grown(parent), "u").select(F.col("p").alias("pu"), "v"))
        right = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        fewer = cut(left.join(grown(right), "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        for done in (hook, parent, left, nodes, edges):
            drop_cut(done)
        nodes, edges = named, fewer
    return nodes


def shingle_set(text: bytes, k: int = WORDS) -> np.ndarray:
    """The distinct hashes of the k-word shingles of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, k)]))


#: Each makes another word of the wide fingerprint of the same hashes.
_TURNS = np.array([xxhash.xxh64_intdigest(b"turn%d" % i, SEED) for i in range(WIDE)], np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The blocks of 16 bits; as in ``fingerprint`` a bit is 1 if set in over half, here of hashes mixed anew for each word."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 255):  # a count of so many fits a byte
        z = hashes[i : i + 255, None] ^ _TURNS
        for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            z ^= z >> np.uint64(33)
            z *= np.uint64(odd)
        z ^= z >> np.uint64(33)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view("<u2")


def _code_words() -> np.ndarray:
    """For each 16-bit word its nearest code word: the syndrome names the bit of the first 15 to flip."""
    words = np.arange(1 << 16)
    syndrome = np.zeros_like(words)
    for at in range(1, 16):
        syndrome ^= np.where(words >> (at - 1) & 1, at, 0)
    return words ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)


_CODE = _code_words()


def block_anchors(blocks: np.ndarray) -> np.ndarray:
    """block << 16 | code word for each block of each line."""
    return _CODE[blocks] + (np.arange(BLOCKS) << 16)


def differing(least: float) -> float:
    """The share of bits in which two sets of one size at that Jaccard similarity differ on average."""
    return float(np.arccos(2 * least / (1 + least)) / np.pi)


def text_hash(docs: DataFrame, text: str = "text") -> Column:
    """A hash of the text, null as empty: with the id it tells rows apart that are not repeated."""
    return F.xxhash64(as_bytes(docs, text))


def with_nodes(docs: DataFrame, k: int = WORDS, fp: bool = False) -> DataFrame:
    """doc_id, text_hash, node (a hash of the shingle set), n (its size) and sketch (its wide
    fingerprint) of every row."""
    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())]

    def run(columns: list[pa.Array]) -> list[list]:
        rows: list[list] = [[] for _ in range(3 + fp)]
        for text in columns[0]:
            text = text.as_py()
            found = shingle_set(text, k)
            digest = xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED)
            line = [int(np.uint64(digest).astype(np.int64)), len(found), wide_fingerprint(found).tobytes(), *([fingerprint(text)] if fp else [])]
            for out, v in zip(rows, line):
                out.append(v)
        return rows

    sent = docs.select("doc_id", text_hash(docs).alias("text_hash"), as_bytes(docs, "text").alias("__bytes"))
    return map_columns(sent, ["__bytes"], T.StructType(fields + [T.StructField("fp", T.LongType())] * fp), run, drop=("__bytes",), rows=64)


def with_shingles(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """``texts`` with the sorted hashes of the shingles as bytes in place of the text."""
    made = T.StructType([T.StructField("shingles", T.BinaryType())])
    sent = texts.withColumn("text", as_bytes(texts, "text"))
    return map_columns(sent, ["text"], made, lambda c: [[shingle_set(t.as_py(), k).astype("<u8").tobytes() for t in c[0]]], drop=("text",), rows=64)


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, each in order, have a Jaccard similarity of ``least`` or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def all_alike(sets: list[np.ndarray], least: float) -> Callable[[int], np.ndarray]:
    """``alike`` of one of the sets, by its place, and each of them: shared hashes are counted by the lists of their holders."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders, starts = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")], np.cumsum(held) - held

    def of(i: int) -> np.ndarray:
        own = code[ends[i] - size[i] : ends[i]]
        n = held[own]
        both = np.bincount(holders[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        return both >= least * (size[i] + size - both) - 1e-9

    return of


def sizes_allow(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - 1e-9


def likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose wide fingerprints differ in few enough bits: at 0.8, in a quarter."""
    most = (differing(least) + ALL_OVER) * 64 * WIDE
    first, second = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"{c}s")) for c in "ab")
    met = pairs.join(grown(first), "a").join(grown(second), "b").select("a", "b", "as", "bs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(-1, WIDE) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most))

    return met.mapInArrow(run, "a bigint, b bigint")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``least`` or more, exactly.

    Sets are joined to, and compared for, only pairs whose sketches differ in few enough bits; the
    joins still shuffle ``sets`` whole.
    """
    pairs = cut(likely(pairs, sets, least))
    first, second = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}s")) for c in "ab")
    met = pairs.join(grown(first), "a").join(grown(second), "b").select("a", "b", "as", "bs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ((np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(c)) for c in (2, 3))
            stay = [alike(x, y, least) for x, y in zip(*sides)]
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    return met.mapInArrow(run, "a bigint, b bigint")


def _anchored(nodes: DataFrame) -> DataFrame:
    """anchor, node and the first 192 bits, a row for each block of each of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                node, sketch = batch.slice(at, STRIP).columns
                blocks = np.frombuffer(b"".join(sketch.to_pylist()), "<u2").reshape(-1, BLOCKS)
                first = blocks[:, : 4 * FIRST].copy().view("<i8")
                columns = [block_anchors(blocks).ravel(), *(np.repeat(x, BLOCKS) for x in (node.to_numpy(), *first.T))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "node", "f0", "f1", "f2"])

    return nodes.select("node", "sketch").mapInArrow(run, "anchor bigint, node bigint, f0 bigint, f1 bigint, f2 bigint")


def _anchor_bands(nodes: DataFrame, least: float) -> DataFrame:
    """(band, node, low, m): a band is a connected group of nodes of one anchor whose first 192 bits differ in few
    enough, low its least node and m their number.

    An anchor with many nodes, by the count of a sample, is cut into chunks of which every two meet.  Rows are
    sorted by anchor and pass by; a band is named by its nodes, so that one that several anchors give is one.
    """
    some = _anchored(nodes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0))
    large = some.groupBy("anchor").agg((F.count("*") * SAMPLE).alias("m")).where(F.col("m") > CHUNK)
    large = cut(large.select(F.col("anchor").alias("of"), F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")))
    met = _anchored(nodes)
    if not large.isEmpty():
        mine = F.pmod(F.xxhash64("node", F.lit(1)), "chunks").cast("int")
        met = met.join(grown(large), met["anchor"] == large["of"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        met = met.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
        key = F.struct("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        met = met.select(F.xxhash64(key).alias("anchor"), "node", "f0", "f1", "f2")
    most = (differing(least) + FIRST_OVER) * 64 * FIRST

    def bands(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        bits, n = rows[:, 2:].view(np.uint64), len(rows)
        near = np.empty((n, n), bool)
        for i in range(0, n, STRIP):
            near[i : i + STRIP] = np.bitwise_count(bits[i : i + STRIP, None] ^ bits[None]).sum(axis=2, dtype=np.uint8) <= most
        if np.count_nonzero(near) == n:
            return []
        found = [np.sort(rows[group, 1]) for group in connected(near)]
        return [(xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63), x) for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + FIRST), np.int64)
        for batch in chain(batches, [None]):
            rows = held if batch is None else np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            ends = [*(np.nonzero(np.diff(rows[:, 0]))[0] + 1).tolist(), *([len(rows)] if batch is None else [])]
            made = [x for a, b in zip([0, *ends], ends) if b - a > 1 for x in bands(rows[a:b])]
            held = rows[ends[-1] if ends else 0 :]
            if made:
                m = [len(x[1]) for x in made]
                columns = [np.repeat([x[0] for x in made], m), np.concatenate([x[1] for x in made]), np.repeat([x[1][0] for x in made], m), np.repeat(m, m)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["band", "node", "low", "m"])

    return met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "band bigint, node bigint, low bigint, m bigint").distinct()


def near_bands(nodes: DataFrame, least: float = JACCARD) -> DataFrame:
    """(band, node): bands that hold all pairs of nodes of one anchor whose first 192 bits differ in few enough.

    A large group of near copies has other bands at each of its anchors, up to 128 for a node.  Bands that
    connect are merged into one if it has no more pairs than they have, or few nodes; else they stay.
    """
    near = cut(_anchor_bands(nodes, least))
    lows = near.groupBy("node").agg(F.collect_set("low").alias("lows"))
    # a node's bands meet in the least of their names: fewer edges than one from each node to each name
    edges = lows.select(F.array_min("lows").alias("a"), F.explode(F.array_union("lows", F.array("node"))).alias("b")).where("a <> b")
    root = cut(components(edges.distinct()))
    pairs = near.groupBy("low").agg(F.sum("m").alias("pairs")).withColumnRenamed("low", "node")
    sizes = root.join(grown(pairs), "node", "left").groupBy("root").agg(F.count("*").alias("m"), F.sum("pairs").alias("pairs"))
    large = cut(sizes.where((F.col("m") > SMALL) & (F.col("m") * F.col("m") > F.col("pairs"))).select("root"))
    made = root.select(F.col("root").alias("band"), "node")
    if not large.isEmpty():
        stay = cut(root.join(grown(large), "root", "left_semi").select("node"))
        made = made.join(grown(stay), "node", "left_anti").select("band", "node").union(near.join(grown(stay), "node", "left_semi").select("band", "node"))
    made = cut(made)
    for done in (near, root, large):
        drop_cut(done)
    return made


def _centres(left: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs (a, b) of one node of each band, whose nodes have different roots, with each other node of it."""
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), F.col("node").alias("a"), F.col("root").alias("ar"), F.col("n").alias("an"))
    centre = left.groupBy("band").agg(F.min(order).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "c.*")
    met = left.join(grown(cut(centre)), "band").where("root <> ar").where(sizes_allow(F.col("an"), F.col("n"), least))
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _all_pairs(left: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between all nodes of a band with different roots, but for those that others connect.

    A band is cut into chunks by the number of its nodes and of their shingles, those of its most frequent
    root apart: two of these never meet, every other two do, in a task, with the sets, and give the links of
    a spanning forest.
    """
    of = left.groupBy("band", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s")).groupBy("band")
    of = of.agg(F.max(F.struct("m", "s", "root")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("roots")).where("roots > 1")
    chunks = lambda m, s: F.greatest(F.ceil(m / CHUNK), F.ceil(s / SHINGLES)).cast("int")
    of = of.select("band", F.col("main.root").alias("main"), chunks(F.col("main.m"), F.col("main.s")).alias("first"), chunks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("others"))
    is_main, last = F.col("root") == F.col("main"), F.col("first") + F.col("others") - 1
    mine = F.when(is_main, F.pmod(F.xxhash64("node"), "first")).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), "others")).cast("int")
    meets = F.when(is_main, F.sequence("first", last)).otherwise(F.array_remove(F.sequence(F.lit(0), last), F.col("mine")))
    member = left.join(grown(cut(of)), "band").withColumn("mine", mine).select("band", "node", "root", "mine", meets.alias("meets"))
    met = (
        member.join(grown(sets.select("node", "shingles")), "node")
        .select("band", "node", "root", "shingles", "mine", F.explode("meets").alias("other"))
        .groupBy("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .agg(F.collect_list(F.struct("node", "root", "shingles")).alias("rows"))
        .where(F.size("rows") > 1)
        .select("rows")
    )

    def forest_of(rows: pa.StructScalar) -> list[tuple[int, int]]:
        node, root = (rows.values.field(c).to_pylist() for c in ("node", "root"))
        sets = [np.frombuffer(v.as_buffer(), "<u8") for v in rows.values.field("shingles")]
        up, out = {r: r for r in root}, []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        alike_to = all_alike(sets, least)
        _, kind, often = np.unique(np.array(root, np.int64), return_inverse=True, return_counts=True)
        for i in np.nonzero(kind != np.argmax(often))[0].tolist():
            near = np.nonzero(alike_to(i))[0]
            for j in near[np.unique(kind[near], return_index=True)[1]].tolist():
                a, b = top(root[i]), top(root[j])
                if a != b:
                    up[a] = b
                    out.append((node[i], node[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                out = forest_of(rows)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def copy_links(docs: DataFrame, seen: DataFrame, least: float = JACCARD, k: int = WORDS) -> DataFrame:
    """Links (a, b) between nodes of ``seen`` (``with_nodes`` of ``docs``); they connect all pairs at ``least`` or more that share a band.

    A large group of near copies would give the square of its size in pairs.  So all nodes of a band
    meet one centre of it first, which tests every pair of a band of two; a second round takes other
    centres in the larger bands that hold nodes of several groups still; in those that are left then,
    all nodes meet.  Only texts that share a band are moved, one for each node.
    """
    a_row = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("row")
    nodes = cut(seen.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), a_row))
    near = cut(near_bands(nodes.where("n > 0"), least))
    shared = cut(near.groupBy("band").agg(F.count("*").alias("m")))
    left = near.join(grown(shared), "band").join(grown(nodes.select("node", "n")), "node")
    left = cut(left.select("band", "node", "n", F.col("node").alias("root"), "m"))
    of = cut(nodes.join(grown(left.select("node").distinct()), "node", "left_semi").select("node", "sketch", "row.*"))
    texts = docs.select("doc_id", "text", text_hash(docs).alias("text_hash"))
    texts = texts.join(grown(of), (texts["text_hash"] == of["text_hash"]) & texts["doc_id"].eqNullSafe(of["doc_id"])).select("node", "sketch", "text")
    sets = cut(with_shingles(texts, k).dropDuplicates(["node"]))
    for done in (near, shared, nodes, of):
        drop_cut(done)
    found = None
    for turn in range(ROUNDS):
        new = cut(similar(_centres(left, turn, least), sets, least))
        found = cut(found.union(new)) if found else new
        root = components(found).withColumnRenamed("node", "r")
        larger = left.where("m > 2").drop("root")
        rooted = cut(larger.join(grown(root), F.col("node") == F.col("r"), "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"), "m"))
        drop_cut(left)
        drop_cut(root)
        left = rooted
    rest = _all_pairs(left, sets, least)
    return cut(found.union(rest) if found else rest)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None, k: int | None = None, least: float = JACCARD) -> DataFrame:
    """doc_id, text_hash, fp, component_id (the smallest doc_id reachable over links) and group of every row.

    Linked are texts whose k-word shingle sets (five words) have a Jaccard similarity of ``least`` or
    more.  With ``bits``, instead, texts whose fingerprints (of k words, four) differ in at most that
    many bits; ``fp`` is always the fingerprint of four words unless ``bits`` and ``k`` say otherwise.

    Null texts are empty; texts without words have fingerprint 0 and link like any other.  Equal
    fingerprints or sets are one node, so copies are never paired.  Rows without an id take part and
    get the smallest id of their component, null if it has none; ``group`` names the component in any
    case.  Repeated rows stay; other columns go.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if bits is None:
        seen = cut(with_nodes(docs, k or WORDS, fp=True))
        named = _named(seen, copy_links(docs, seen, least, k or WORDS))
    else:
        seen = cut(with_fingerprint(docs.withColumn("text_hash", text_hash(docs)), k=k or SHINGLE).withColumn("node", F.col("fp")))
        named = _named(seen, links(seen.select("fp").distinct(), bits))
    return named.select("doc_id", "text_hash", "fp", "component_id", "group")


def near_copies(docs: DataFrame, k: int = WORDS, least: float = JACCARD) -> DataFrame:
    """``near_duplicates`` by shingle sets, without fingerprints."""
    docs = docs.select("doc_id", "text")
    seen = cut(with_nodes(docs, k))
    return _named(seen, copy_links(docs, seen, least, k)).select("doc_id", "text_hash", "component_id", "group")


def _named(seen: DataFrame, edges: DataFrame) -> DataFrame:
    """``seen`` (doc_id, node, ...) with component_id and group."""
    distinct = cut(seen.groupBy("node").agg(F.min("doc_id").alias("least")))
    root = components(edges).withColumnRenamed("node", "of")
    linked = cut(distinct.join(grown(root), distinct["node"] == root["of"]).select("node", "root", "least"))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = cut(linked.join(grown(least), "root").select(F.col("node").alias("of"), "root", "component_id"))
    named = distinct.join(grown(linked), distinct["node"] == linked["of"], "left")
    named = cut(named.select("node", F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "node").alias("group")))
    return seen.drop("sketch").join(grown(named), "node")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``found`` (``near_duplicates`` of ``docs``).

    It is the row with the smallest id, of several the one with the smallest hash of its text; a group
    without ids keeps a row, too.  Of rows that repeat both, any one.  Texts are moved once; groups of
    repeated rows are reduced before they are moved.
    """
    keys = {"__id": F.coalesce("doc_id", F.lit(0)), "__no": F.col("doc_id").isNull()}
    rows = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("c"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("text_hash").alias("__h"), "c")
    first = cut(rows.groupBy("group").agg(F.min(order).alias("w")).select("w.*").withColumns(keys).select(*keys, "__h", "c"))
    sent = docs.withColumns(keys | {"__h": text_hash(docs)})
    single = sent.join(grown(first.where("c = 1").drop("c")), [*keys, "__h"], "left_semi")
    several = sent.join(grown(first.where("c > 1").drop("c")), [*keys, "__h"], "left_semi").dropDuplicates([*keys, "__h"])
    return single.union(several).select(*[f"`{c}`" for c in docs.columns])


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
