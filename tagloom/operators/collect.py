"""Decoded reads to counted compounds: filter, collect, UMI correction, per-library summaries.

Counts are built in two grouped levels, (compound, UMI) and then (compound): partial aggregation
shrinks the first before its shuffle, and no list of raw UMIs is ever held.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.functions.dna import parted_keys
from tagloom.session import cut

COMPOUND = ["library_id", "bb_ids"]
#: A compound with at most so many UMIs is solved in one row; more go the set-based way.
SMALL = 1024
#: Bases of a UMI that its keys hide: at most 64 UMIs share a key.
HIDDEN = 3


def kept(decoded: DataFrame, score_threshold: float = 100.0) -> DataFrame:
    """Only the columns and rows that count; rows without a score go."""
    return decoded.select(*COMPOUND, "umi", "overall_score").where(F.col("overall_score") <= score_threshold)


def umi_counts(decoded: DataFrame, score_threshold: float = 100.0) -> DataFrame:
    """One row for each compound and UMI with its number of reads."""
    return kept(decoded, score_threshold).groupBy(*COMPOUND, "umi").agg(F.count("*").alias("c"))


def collect(decoded: DataFrame, score_threshold: float = 100.0) -> DataFrame:
    """One row for each compound: its distinct UMIs and their counts, both in UMI order."""
    return listed(umi_counts(decoded, score_threshold))


def listed(umis: DataFrame) -> DataFrame:
    """One row for each compound of (compound, umi, c).

    A file format: the list is as long as the compound has distinct UMIs.  Counting starts from
    ``umi_counts`` and holds no list.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col("umi").alias("k"), "c")))
    return umis.groupBy(*COMPOUND).agg(pairs.alias("umi_counts")).select(*COMPOUND, F.col("umi_counts.k").alias("umi"), "umi_counts")


def regrouped(collected: DataFrame) -> DataFrame:
    """Collected compounds of several runs as one: counts of equal UMIs are added up."""
    return listed(exploded(collected).groupBy(*COMPOUND, "umi").agg(F.sum("c").alias("c")))


def exploded(collected: DataFrame) -> DataFrame:
    """Back from collected compounds to one row a UMI."""
    return collected.select(*COMPOUND, F.explode("umi_counts").alias("x")).select(*COMPOUND, F.col("x.k").alias("umi"), F.col("x.c").alias("c"))


def raw_and_dedup(umis: DataFrame) -> DataFrame:
    """raw_count and dedup_count of each compound; a null UMI counts as reads but not as a UMI."""
    return umis.groupBy(*COMPOUND).agg(F.sum("c").alias("raw_count"), F.count("umi").alias("dedup_count"))


def hamming_edges(umis: DataFrame, directional: bool = False) -> DataFrame:
    """Pairs a < b of UMIs of one compound that differ in exactly one base.

    UMIs meet under (compound, UMI with a run of bases hidden): two that differ in one base share one such
    key alone, so no pair shows twice, and a key has no more than all UMIs that fill the run.  Fewer keys
    move than with each base hidden in turn.  ``directional`` keeps a pair if one has at least 2 n + 1
    reads of the other's n.
    """
    slim = umis.where(F.col("umi").isNotNull() & ~F.contains("umi", F.lit("N"))).select(*COMPOUND, "umi", "c", F.explode(parted_keys(F.col("umi"), HIDDEN)).alias("mask"))
    groups = slim.groupBy(*COMPOUND, "mask").agg(F.collect_list(F.struct("umi", "c")).alias("g")).where(F.size("g") > 1)
    pair = groups.select(*COMPOUND, F.explode("g").alias("x"), "g").select(*COMPOUND, "x", F.explode("g").alias("y")).where("x.umi < y.umi AND levenshtein(x.umi, y.umi, 1) = 1")
    if directional:
        pair = pair.where("x.c >= 2 * y.c + 1 OR y.c >= 2 * x.c + 1")
    return pair.select(*COMPOUND, F.col("x.umi").alias("a"), F.col("y.umi").alias("b"))


def n_components(umis: list[str], counts: list[int], directional: bool) -> int:
    """Connected components of one compound's UMI graph, by union-find over shared masked keys."""
    root, met, shared, n = list(range(len(umis))), {}, defaultdict(list), len(umis)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, u in enumerate(umis):
        if "N" not in u:
            for p in range(len(u)):
                key = (p, u[:p], u[p + 1 :])
                first = met.setdefault(key, i)
                if first == i:
                    continue
                if not directional:  # all of a key are one component: the first stands for them
                    a, b = find(first), find(i)
                    root[b] = a
                    n -= a != b
                else:
                    shared[key].append(i)
    for key, others in shared.items():
        for i, j in combinations([met[key], *others], 2):
            low, high = sorted((counts[i], counts[j]))
            if high >= 2 * low + 1:
                i, j = find(i), find(j)
                root[j] = i
                n -= i != j
    return n


def corrected_in_rows(umis: DataFrame, directional: bool) -> DataFrame:
    """count of each compound, from one row that holds all its UMIs: for compounds of bounded size."""
    pairs = F.collect_list(F.when(F.col("umi").isNotNull(), F.struct("umi", "c")))
    schema = T.StructType([*[umis.schema[c] for c in COMPOUND], T.StructField("count", T.LongType())])
    arrow = to_arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at, flat = column.offsets.to_pylist(), column.values
            names, counts = flat.field("umi").to_pylist(), flat.field("c").to_pylist()
            made = [n_components(names[a:b], counts[a:b], directional) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:2], arrow)), pa.array(made, pa.int64())], schema=arrow)

    return umis.groupBy(*COMPOUND).agg(pairs.alias("u")).mapInArrow(solve, schema)


def corrected(umis: DataFrame, method: str = "directional", small: int = SMALL) -> DataFrame:
    """count of each compound: connected components of its UMI graph.

    Compounds of up to ``small`` UMIs are solved row by row; only where a larger one exists is its
    graph built and closed set-based, so that one compound may hold any share of the rows.
    """
    if method not in ("directional", "cluster"):
        raise ValueError(f"unknown UMI correction {method!r}")
    directional = method == "directional"
    umis = cut(umis)
    large = umis.groupBy(*COMPOUND).agg(F.count("umi").alias("n")).where(F.col("n") > small).select(*COMPOUND)
    if large.isEmpty():
        return corrected_in_rows(umis, directional)
    u, g = umis.alias("u"), cut(large).alias("g")
    same = F.col("u.library_id").eqNullSafe(F.col("g.library_id")) & F.col("u.bb_ids").eqNullSafe(F.col("g.bb_ids"))
    return corrected_in_rows(u.join(g, same, "left_anti"), directional).union(corrected_set_based(cut(u.join(g, same, "left_semi")), directional))


def corrected_set_based(umis: DataFrame, directional: bool) -> DataFrame:
    """The same for compounds of any size.

    Labels fall to the least UMI of the component by hooking to the least neighbour and doubling of
    paths; only UMIs with edges take part, the others are a component each.
    """
    group = F.struct(*COMPOUND).alias("g")  # equal as a whole, nulls included
    edges = hamming_edges(umis, directional).select(group, "a", "b")
    edges = cut(edges.union(edges.select("g", "b", "a")))
    nodes = cut(edges.groupBy("g", F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")))
    changed = not edges.isEmpty()
    while changed:
        offers = edges.join(nodes, (edges["g"] == nodes["g"]) & (edges["b"] == nodes["node"])).select(edges["g"], F.col("a").alias("node"), "root", F.lit(None).cast("string").alias("old"))
        least = cut(nodes.withColumn("old", F.col("root")).union(offers).groupBy("g", "node").agg(F.min("root").alias("root"), F.max("old").alias("old")))
        up = least.select(F.col("g").alias("ug"), F.col("node").alias("un"), F.col("root").alias("ur"))
        jumped = cut(least.join(up, (least["g"] == up["ug"]) & (least["root"] == up["un"])).select("g", "node", F.least("root", "ur").alias("root"), "old"))
        changed = not jumped.where("root <> old").isEmpty()
        nodes = jumped.drop("old")
    merged = nodes.groupBy("g").agg((F.count("*") - F.count_distinct("root")).alias("merged"))
    alone = umis.groupBy(*COMPOUND).agg(F.count("umi").alias("n")).withColumn("g", F.struct(*COMPOUND))
    return alone.join(merged, "g", "left").select(*COMPOUND, (F.col("n") - F.coalesce("merged", F.lit(0))).alias("count"))


def count_compounds(collected: DataFrame, method: str | None = "directional", raw: bool = False, dedup: bool = False) -> DataFrame:
    """``count_umis`` of a collected file."""
    return count_umis(exploded(collected), method, raw, dedup)


def count_umis(umis: DataFrame, method: str | None = "directional", raw: bool = False, dedup: bool = False) -> DataFrame:
    """Counted compounds as the count step writes them: ``count`` and, on demand, the other two."""
    plain = raw_and_dedup(umis)
    if method is None:
        out = plain.withColumn("count", F.col("dedup_count"))
    else:
        c = corrected(umis, method).alias("c")
        p = plain.alias("p")
        out = p.join(c, F.col("p.library_id").eqNullSafe(F.col("c.library_id")) & F.col("p.bb_ids").eqNullSafe(F.col("c.bb_ids"))).select("p.*", "c.count")
    extra = [F.col("raw_count").cast("int")] * raw + [F.col("dedup_count").cast("int")] * dedup
    return out.select(*COMPOUND, F.col("count").cast("int"), *extra)


def summarize(counted: DataFrame) -> DataFrame:
    """Compounds and molecules of each library."""
    return counted.groupBy("library_id").agg(F.count("*").alias("n_compounds"), F.sum("count").alias("n_molecules"))


def zero_filled(summary: DataFrame, libraries: DataFrame) -> DataFrame:
    """All listed libraries, with zeros where the summary has no row."""
    counts = [c for c in summary.columns if c != "library_id"]
    return libraries.select("library_id").join(summary, "library_id", "left").select("library_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


def merged_stats(parts: list[DataFrame]) -> DataFrame:
    """Field-wise sums of long-form statistics (name, library_id, value)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("name", "library_id").agg(F.sum("value").alias("value"))
