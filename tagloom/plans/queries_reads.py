"""Queries over decoded reads: filter, collect, count, summarise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import collect as C
from tagloom.plans.derive import decoded, sql_decoded
from tagloom.session import table


def score_filter(spark, sf_dir):
    return C.kept(decoded(spark, sf_dir), 3.0)


def collect_umis(spark, sf_dir):
    return C.collect(decoded(spark, sf_dir), 5.0).select("library_id", "bb_ids", F.size("umi").cast("long").alias("n_umis"), F.array_join("umi", ",").alias("umis"))


def umi_value_counts(spark, sf_dir):
    return C.umi_counts(decoded(spark, sf_dir), 5.0)


def count_raw_dedup(spark, sf_dir):
    return C.raw_and_dedup(C.umi_counts(decoded(spark, sf_dir)))


def count_cluster(spark, sf_dir):
    return C.corrected(C.umi_counts(decoded(spark, sf_dir, 6)), "cluster")


def count_directional(spark, sf_dir):
    return C.corrected(C.umi_counts(decoded(spark, sf_dir, 5)), "directional")


def count_compounds(spark, sf_dir):
    return C.count_umis(C.umi_counts(decoded(spark, sf_dir, 5)), "directional", raw=True, dedup=True)


def umi_edges_hamming1(spark, sf_dir):
    return C.hamming_edges(C.umi_counts(decoded(spark, sf_dir, 6)))


def umi_edges_directional(spark, sf_dir):
    return C.hamming_edges(C.umi_counts(decoded(spark, sf_dir, 5)), directional=True)


def summarize_library(spark, sf_dir):
    return C.summarize(C.raw_and_dedup(C.umi_counts(decoded(spark, sf_dir))).withColumnRenamed("dedup_count", "count"))


def stats_zero_fill(spark, sf_dir):
    libraries = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("library_id")).distinct().union(decoded(spark, sf_dir).select("library_id").distinct())
    return C.zero_filled(summarize_library(spark, sf_dir), libraries.distinct())


def stats_merge(spark, sf_dir):
    reads = decoded(spark, sf_dir)
    parts = [reads.where(F.col("overall_score") % 2 == k).groupBy("library_id").agg(F.count("*").alias("value")).withColumn("name", F.lit("num_seqs_decoded")) for k in (0, 1)]
    return C.merged_stats(parts)


def duplicate_tags(spark, sf_dir):
    """Tags that more than one building block has."""
    from tagloom.functions.dna import md5_dna

    tags = table(spark, sf_dir, "part").select(md5_dna(F.col("p_partkey"), 5).alias("tag"), "p_partkey")
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_bb")).where("n > 1")


def _closure(umi: int, edge: str) -> str:
    return f"""
WITH RECURSIVE {sql_decoded(umi)},
u AS (SELECT library_id, bb_ids, umi, count(*) AS c FROM decoded WHERE overall_score <= 100 GROUP BY ALL),
e AS (SELECT a.library_id, a.bb_ids, a.umi AS a, b.umi AS b FROM u a JOIN u b ON a.library_id = b.library_id AND a.bb_ids = b.bb_ids AND a.umi <> b.umi AND hamming(a.umi, b.umi) = 1 {edge}),
r AS (SELECT library_id, bb_ids, umi AS node, umi AS root FROM u
      UNION SELECT e.library_id, e.bb_ids, e.b AS node, r.root FROM r JOIN e ON e.library_id = r.library_id AND e.bb_ids = r.bb_ids AND e.a = r.node AND r.root < e.b),
m AS (SELECT library_id, bb_ids, node, min(root) AS root FROM r GROUP BY ALL)
SELECT library_id, bb_ids, count(DISTINCT root) AS count FROM m GROUP BY ALL"""


DIRECTIONAL = "AND (a.c >= 2 * b.c + 1 OR b.c >= 2 * a.c + 1)"
_U = "u AS (SELECT library_id, bb_ids, umi, count(*) AS c FROM decoded WHERE overall_score <= 100 GROUP BY ALL)"
_PLAIN = "p AS (SELECT library_id, bb_ids, CAST(sum(c) AS BIGINT) AS raw_count, count(umi) AS dedup_count FROM u GROUP BY ALL)"


def _edges(umi: int, edge: str) -> str:
    return f"WITH {sql_decoded(umi)}, {_U} SELECT a.library_id, a.bb_ids, a.umi AS a, b.umi AS b FROM u a JOIN u b ON a.library_id = b.library_id AND a.bb_ids = b.bb_ids AND a.umi < b.umi AND hamming(a.umi, b.umi) = 1 {edge}"


QUERIES = {
    f.__name__: f
    for f in (score_filter, collect_umis, umi_value_counts, count_raw_dedup, count_cluster, count_directional, count_compounds, umi_edges_hamming1, umi_edges_directional, summarize_library, stats_zero_fill, stats_merge, duplicate_tags)
}

_SUMMARY = f"{sql_decoded()}, {_U}, {_PLAIN}, s AS (SELECT library_id, count(*) AS n_compounds, CAST(sum(dedup_count) AS BIGINT) AS n_molecules FROM p GROUP BY 1)"
SQL = {
    "score_filter": f"WITH {sql_decoded()} SELECT * FROM decoded WHERE overall_score <= 3",
    "collect_umis": f"WITH {sql_decoded()} SELECT library_id, bb_ids, count(DISTINCT umi) AS n_umis, string_agg(DISTINCT umi, ',' ORDER BY umi) AS umis FROM decoded WHERE overall_score <= 5 GROUP BY ALL",
    "umi_value_counts": f"WITH {sql_decoded()} SELECT library_id, bb_ids, umi, count(*) AS c FROM decoded WHERE overall_score <= 5 GROUP BY ALL",
    "count_raw_dedup": f"WITH {sql_decoded()}, {_U}, {_PLAIN} SELECT * FROM p",
    "count_cluster": _closure(6, ""),
    "count_directional": _closure(5, DIRECTIONAL),
    "count_compounds": f"WITH {sql_decoded()}, {_U}, {_PLAIN}, k AS ({_closure(5, DIRECTIONAL)}) SELECT library_id, bb_ids, CAST(count AS INTEGER) AS count, CAST(raw_count AS INTEGER) AS raw_count, CAST(dedup_count AS INTEGER) AS dedup_count FROM p JOIN k USING (library_id, bb_ids)",
    "umi_edges_hamming1": _edges(6, ""),
    "umi_edges_directional": _edges(5, DIRECTIONAL),
    "summarize_library": f"WITH {_SUMMARY} SELECT * FROM s",
    "stats_zero_fill": f"WITH {_SUMMARY}, l AS (SELECT DISTINCT o_orderstatus AS library_id FROM orders UNION SELECT DISTINCT l_returnflag FROM lineitem) SELECT library_id, coalesce(n_compounds, 0) AS n_compounds, coalesce(n_molecules, 0) AS n_molecules FROM l LEFT JOIN s USING (library_id)",
    "stats_merge": "SELECT 'num_seqs_decoded' AS name, l_returnflag AS library_id, count(*) AS value FROM lineitem GROUP BY 2",
    "duplicate_tags": "WITH t AS (SELECT substr(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 5) AS tag, p_partkey FROM part) SELECT tag, count(*) AS n, min(p_partkey) AS first_bb FROM t GROUP BY tag HAVING count(*) > 1",
}
