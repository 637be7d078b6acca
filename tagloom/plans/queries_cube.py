"""Queries over the cube: enrichment, features, overlap, top lists, exports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tagloom.operators import cube as K
from tagloom.operators import overlap as O
from tagloom.operators.library import compound_id_of
from tagloom.operators.polyo import cutoffs, polyo
from tagloom.plans.derive import INDEXES, LIB_SIZE, SQL_CUBE, cube, decoded, sql_decoded


def rounded(df, keep, digits=6):
    return df.select(*[F.col(f"`{c}`") if c in keep else F.round(F.col(f"`{c}`"), digits).alias(c.replace("+", "_hi").replace("-", "_lo")) for c in df.columns if c in keep or c not in ("a1", "a2", "a3", "r1", "r2", "r3", "ctrl")])


def split_compound_id(spark, sf_dir):
    return K.split_ids(cube(spark, sf_dir)).data.select("DEL_ID", "ID_A", "ID_B", "ID_C")


def sd_min(spark, sf_dir):
    return rounded(K.sampling_depth(cube(spark, sf_dir)), {"experiment"})


def nsc(spark, sf_dir):
    return rounded(K.nsc(cube(spark, sf_dir)).data, {"DEL_ID"})


def nsc_intervals(spark, sf_dir):
    return rounded(K.nsc(cube(spark, sf_dir), intervals=True).data.drop("expa_sum", "expa_NSC", "expr_sum", "expr_NSC"), {"DEL_ID"})


def mle(spark, sf_dir):
    return rounded(K.mle(cube(spark, sf_dir)).data, {"DEL_ID"})


def z_score(spark, sf_dir):
    return rounded(K.z_score(cube(spark, sf_dir)).data, {"DEL_ID"})


def z_score_log(spark, sf_dir):
    return rounded(K.z_score_log(cube(spark, sf_dir)).data, {"DEL_ID"})


def normalize(spark, sf_dir):
    df = K.normalize(cube(spark, sf_dir)).data
    return df.select("DEL_ID", *[c for cs in INDEXES.values() for c in cs], *[F.round(f"{e}_avg", 6).alias(f"{e}_avg") for e in INDEXES])


def disynthon_counts(spark, sf_dir):
    made, names = K.disynthonize(cube(spark, sf_dir))
    return made.data.select("DEL_ID", "AB", "AC", "BC", *[c for cs in names.values() for c in cs])


def _top_disynthons(versus):
    def query(spark, sf_dir):
        top = K.top_disynthons(cube(spark, sf_dir), "AB", "expa", versus, "sum")
        return top.select(F.col("AB"), F.col("expa_sum"), *([F.col(f"{versus}_sum").alias("other_sum")] if versus else []), "lead")

    return query


def polyo_raw(spark, sf_dir):
    df = polyo(cube(spark, sf_dir), "disynthon").data
    return df.select("DEL_ID", *[F.round(c, 4).alias(c) for c in df.columns if c.endswith("PolyO_raw")])


def polyo_score(spark, sf_dir):
    df = polyo(cube(spark, sf_dir), "monosynthon").data
    return df.select("DEL_ID", *[F.round(c, 4).alias(c) for c in df.columns if c.endswith("PolyO")])


def polyo_cutoffs(spark, sf_dir):
    """Cutoffs for the disynthon AB, from one aggregated row."""
    c = K.split_ids(cube(spark, sf_dir))
    one = c.data.agg(F.count_distinct("ID_A", "ID_B").alias("n"), F.sum(K.row_sum([x for cs in INDEXES.values() for x in cs])).alias("t")).first()
    compounds, reads = cutoffs(LIB_SIZE, one["n"], (one["t"] or 0.0) / LIB_SIZE)
    return spark.range(1).select(F.lit(compounds).cast("long").alias("compound_cutoff"), F.lit(reads).cast("long").alias("read_cutoff"))


def trisynthon_overlap(spark, sf_dir):
    return O.trisynthon_overlap(cube(spark, sf_dir), "expa", 10.0)


def disynthon_overlap(spark, sf_dir):
    made, names = K.disynthonize(cube(spark, sf_dir))
    return O.disynthon_overlap(made.data, "AB", "expa", names["AB_expa"], 150.0).select("experiment", "region", "n")


def overlap_auto_threshold(spark, sf_dir):
    c = cube(spark, sf_dir)
    return O.threshold_of(c.data, INDEXES["expa"], 90.0).select(F.round("threshold", 6).alias("threshold"))


def overlap_autocorr(spark, sf_dir):
    return O.replicate_correlation(cube(spark, sf_dir).data, INDEXES["expa"], 20.0).select(F.round("correlation", 6).alias("correlation"))


def top_compounds(spark, sf_dir):
    return K.top_compounds(cube(spark, sf_dir), "expa", 20)


def top_deltas(spark, sf_dir):
    return K.top_deltas(cube(spark, sf_dir), "expa", ["ctrl"], 20)


def spotfire(spark, sf_dir):
    return K.spotfire(K.nsc(K.split_ids(cube(spark, sf_dir))))


def monosynthon_summary(spark, sf_dir):
    return K.monosynthons(cube(spark, sf_dir), "A", ["a1", "a2", "a3"]).select("ID_A", F.round("mean_sum", 6).alias("mean_sum"), "n_compounds")


def sample_top_and_rest(spark, sf_dir):
    return K.top_and_sample(cube(spark, sf_dir), K.row_sum(INDEXES["expa"]), 50, 100).select("DEL_ID", "a1", "a2", "a3", "part")


def cubify_pivot(spark, sf_dir):
    reads = decoded(spark, sf_dir)
    counted = reads.groupBy("library_id", F.concat_ws(",", "bb_ids", F.col("overall_score").cast("int")).alias("bb_ids")).agg(F.count("*").alias("count"))
    wide = K.cubify(counted, "ie", selection="library_id", count_least=2)
    return wide.select("DEL_ID", *[F.col(x) for x in ("A", "N", "R")])


def compound_id(spark, sf_dir):
    return decoded(spark, sf_dir).select(compound_id_of(F.col("library_id"), F.array("bb_ids", F.col("overall_score").cast("int").cast("string"))).alias("compound_id")).groupBy("compound_id").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (split_compound_id, sd_min, nsc, nsc_intervals, mle, z_score, z_score_log, normalize, disynthon_counts, polyo_raw, polyo_score, polyo_cutoffs, trisynthon_overlap, disynthon_overlap, overlap_auto_threshold, overlap_autocorr, top_compounds, top_deltas, spotfire, monosynthon_summary, sample_top_and_rest, cubify_pivot, compound_id)
} | {"top_disynthons_none": _top_disynthons(None), "top_disynthons_control": _top_disynthons("ctrl"), "top_disynthons_exp2": _top_disynthons("expr")}

_W = f"WITH {SQL_CUBE}"
_T = f"{_W}, t AS (SELECT sum(sa) AS ta, sum(sr) AS tr, sum(ctrl) AS tc, max(sa) AS ma, max(sr) AS mr FROM cube)"
_N = LIB_SIZE


def _per(template: str) -> str:
    """A select list for both experiments: {e} its name, {s} its sum, {t} its total."""
    return ", ".join(template.format(e=e, s=s, t=t) for e, s, t in (("expa", "sa", "ta"), ("expr", "sr", "tr")))


def _disyn() -> str:
    return ", ".join(f"CAST(sum({c}) OVER (PARTITION BY {k}) AS BIGINT) AS count_{k}_{e}_{c}" for k in ("AB", "AC", "BC") for e, cs in INDEXES.items() for c in cs)


def _top(other: str) -> str:
    extra = f", CAST(sum({other}) AS DOUBLE) AS other_sum" if other else ""
    lead = f"sum(sa) - sum({other})" if other else "sum(sa)"
    return f"{_W} SELECT AB, sum(sa) AS expa_sum{extra}, CAST({lead} AS DOUBLE) AS lead FROM cube GROUP BY AB ORDER BY lead DESC, AB LIMIT 20"


def _poly(keys, score: bool) -> str:
    log10e = 1 / math.log(10)
    rate = {"expa": "ta", "expr": "tr"}
    s = {"expa": "sa", "expr": "sr"}
    cols = []
    for k in keys:
        for e in INDEXES:
            lam = f"({rate[e]} / {_N})"
            raw = f"(-sum({s[e]} * ln({lam}) - {lam} - lgamma({s[e]} + 1)) OVER (PARTITION BY {k}) * {log10e!r})"
            cols.append(f"round({raw} / base_{k}, 4) AS {e}_{k}_PolyO" if score else f"round({raw}, 4) AS {e}_{k}_PolyO_raw")
    if not score:
        return f"{_T} SELECT DEL_ID, {', '.join(cols)} FROM cube, t"
    tail = lambda lam: f"(SELECT min(k) FROM range(0, 100000) g(k) WHERE k >= ceil({lam}) + 1 AND exp(k * ln({lam}) - {lam} - lgamma(k + 1)) <= 0.01)"
    bases = ", ".join(f"(SELECT -{tail(f'n_{k}')} * ({tail('sb')} * ln(sb) - sb - lgamma({tail('sb')} + 1)) * {log10e!r} FROM f) AS base_{k}" for k in keys)
    f = ", f AS (SELECT (SELECT (ta + tr) / 3500 FROM t) AS sb, " + ", ".join(f"3500.0 / count(DISTINCT {k}) AS n_{k}" for k in keys) + " FROM cube)"
    return f"{_T}{f}, b AS (SELECT {bases}) SELECT DEL_ID, {', '.join(cols)} FROM cube, t, b"


_TAIL = "(SELECT min(k) FROM range(0, 100000) g(k) WHERE k >= ceil({0}) + 1 AND exp(k * ln({0}) - {0} - lgamma(k + 1)) <= 0.01)"
_REGION = "SELECT {head}region, count(*) AS n FROM (SELECT CAST(CAST({a} > {t} AS INTEGER) AS VARCHAR) || CAST(CAST({b} > {t} AS INTEGER) AS VARCHAR) || CAST(CAST({c} > {t} AS INTEGER) AS VARCHAR) AS region FROM {src}) WHERE region <> '000' GROUP BY ALL"
_OVER = "(SELECT * FROM cube WHERE a1 > 20 OR a2 > 20 OR a3 > 20)"

SQL = {
    "split_compound_id": f"{_W} SELECT DEL_ID, ID_A, ID_B, ID_C FROM cube",
    "sd_min": f"{_T} SELECT 'expa' AS experiment, round(ta / {_N}, 6) AS sampling_depth, round_even(ma / (ta / {_N}), 2) AS nsc_max, round(10 / round_even(ma / (ta / {_N}), 2), 6) AS sd_min FROM t UNION ALL SELECT 'expr', round(tr / {_N}, 6), round_even(mr / (tr / {_N}), 2), round(10 / round_even(mr / (tr / {_N}), 2), 6) FROM t",
    "nsc": f"{_T} SELECT DEL_ID, {_per('{s} AS {e}_sum')}, {_per(f'round({{s}} / ({{t}} / {_N}), 6) AS {{e}}_NSC')} FROM cube, t",
    "nsc_intervals": f"{_T} SELECT DEL_ID, {_per(f'round(pow(sqrt({{s}} + 1) + 1, 2) / ({{t}} / {_N}), 6) AS {{e}}_NSC_hi')}, {_per(f'round(pow(sqrt({{s}} + 1) - 1, 2) / ({{t}} / {_N}), 6) AS {{e}}_NSC_lo')} FROM cube, t",
    "mle": f"{_T} SELECT DEL_ID, {_per('round((CAST(tc AS DOUBLE) / {t}) * ({s} + 0.375) / (ctrl + 0.375), 6) AS {e}_MLE')} FROM cube, t",
    "z_score": f"{_T} SELECT DEL_ID, {_per('{s} AS {e}_C')}, {_per(f'round({{t}} / {_N}, 6) AS {{e}}_E')}, {_per(f'round(sqrt({{t}} / {_N} * (1 - 1.0 / {_N})), 6) AS {{e}}_sigma')}, {_per(f'round(({{s}} - {{t}} / {_N}) / sqrt({{t}} / {_N} * (1 - CAST(1 AS DOUBLE) / {_N})), 6) AS {{e}}_z_score')}, {_per(f'round(({{s}} - {{t}} / {_N}) / sqrt({{t}} / {_N} * (1 - CAST(1 AS DOUBLE) / {_N})) / sqrt({{t}}), 6) AS {{e}}_norm_z_score')} FROM cube, t",
    "z_score_log": f"{_W}, m AS (SELECT CAST(median(ctrl) AS DOUBLE) AS m FROM cube WHERE ctrl > 0), l AS (SELECT cube.*, CASE WHEN ctrl = 0 THEN ln(1 + m) ELSE ln(1 + CAST(ctrl AS DOUBLE)) END AS lc FROM cube, m), z AS (SELECT avg(lc) AS a, stddev_samp(lc) AS s FROM l) SELECT DEL_ID, round((ln(1 + sa / 3) - a) / s, 6) AS expa_z_score_log, round((ln(1 + sr / 3) - a) / s, 6) AS expr_z_score_log FROM cube, z",
    "normalize": f"{_W}, n AS (SELECT DEL_ID, {', '.join(f'greatest({c} - ctrl, 0) AS {c}' for cs in INDEXES.values() for c in cs)} FROM cube) SELECT *, round((a1 + a2 + a3) / CAST(3 AS DOUBLE), 6) AS expa_avg, round((r1 + r2 + r3) / CAST(3 AS DOUBLE), 6) AS expr_avg FROM n",
    "disynthon_counts": f"{_W} SELECT DEL_ID, AB, AC, BC, {_disyn()} FROM cube",
    "top_disynthons_none": _top(""),
    "top_disynthons_control": _top("ctrl"),
    "top_disynthons_exp2": _top("sr"),
    "polyo_raw": _poly(["AB", "AC", "BC"], False),
    "polyo_score": _poly(["ID_A", "ID_B", "ID_C"], True),
    "polyo_cutoffs": f"{_T}, f AS (SELECT CAST({_N} AS DOUBLE) / count(DISTINCT AB) AS c, (SELECT (ta + tr) / {_N} FROM t) AS r FROM cube) SELECT {_TAIL.format('f.c')} AS compound_cutoff, {_TAIL.format('f.r')} AS read_cutoff FROM f",
    "trisynthon_overlap": f"{_W} " + _REGION.format(head="", a="a1", b="a2", c="a3", t=10, src="cube"),
    "disynthon_overlap": f"{_W} " + _REGION.format(head="'expa' AS experiment, ", a="x1", b="x2", c="x3", t=150, src="(SELECT AB, sum(a1) AS x1, sum(a2) AS x2, sum(a3) AS x3 FROM cube GROUP BY AB)"),
    "overlap_auto_threshold": f"{_W} SELECT round(quantile_cont(v, 0.9), 6) AS threshold FROM (SELECT CAST(unnest([a1, a2, a3]) AS DOUBLE) AS v FROM cube) WHERE v > 0",
    "overlap_autocorr": f"{_W} SELECT round((corr(a1, a2) + corr(a1, a3) + corr(a2, a3)) / 3, 6) AS correlation FROM {_OVER}",
    "top_compounds": f"{_W} SELECT DEL_ID, sa AS expa_sum FROM cube WHERE a1 > 0 AND a2 > 0 AND a3 > 0 ORDER BY sa DESC, DEL_ID LIMIT 20",
    "top_deltas": f"{_W} SELECT DEL_ID, sa AS value, CAST(ctrl AS DOUBLE) AS control, sa - ctrl AS delta FROM cube ORDER BY delta DESC, DEL_ID LIMIT 20",
    "spotfire": f"{_T} SELECT DEL_ID, ID_A, ID_B, ID_C, {', '.join(f'CAST({c} AS DOUBLE) AS {e}_{c}' for e, cs in INDEXES.items() for c in cs)}, {_per('{s} AS {e}_sum')}, {_per('round_even({s} / 3, 2) AS {e}_avg')}, ctrl, {_per(f'round_even({{s}} / ({{t}} / {_N}), 2) AS {{e}}_NSC')} FROM cube, t",
    "sample_top_and_rest": f"{_W}, best AS (SELECT DEL_ID, a1, a2, a3 FROM cube ORDER BY sa DESC, DEL_ID LIMIT 50), rest AS (SELECT DEL_ID, a1, a2, a3 FROM cube WHERE DEL_ID NOT IN (SELECT DEL_ID FROM best) ORDER BY md5('42-' || DEL_ID), DEL_ID LIMIT 100) SELECT *, 'top' AS part FROM best UNION ALL SELECT *, 'sample' AS part FROM rest",
    "monosynthon_summary": f"{_W} SELECT ID_A, round(avg(sa), 6) AS mean_sum, count(*) AS n_compounds FROM cube GROUP BY ID_A",
    "cubify_pivot": f"WITH {sql_decoded()}, c AS (SELECT library_id, bb_ids || '-' || CAST(CAST(overall_score AS INTEGER) AS VARCHAR) AS DEL_ID, count(*) AS n FROM decoded GROUP BY ALL) SELECT DEL_ID, CAST(coalesce(sum(n) FILTER (library_id = 'A'), 0) AS BIGINT) AS A, CAST(coalesce(sum(n) FILTER (library_id = 'N'), 0) AS BIGINT) AS N, CAST(coalesce(sum(n) FILTER (library_id = 'R'), 0) AS BIGINT) AS R FROM c WHERE n >= 2 GROUP BY DEL_ID",
    "compound_id": f"WITH {sql_decoded()} SELECT library_id || '-' || bb_ids || '-' || CAST(CAST(overall_score AS INTEGER) AS VARCHAR) AS compound_id, count(*) AS n FROM decoded GROUP BY ALL",
}
