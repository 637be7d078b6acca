"""Overlap of replicates: Venn regions, automatic thresholds, replicate correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.cube import Cube


def regions(df: DataFrame, key: str, columns: list[str], threshold: float) -> DataFrame:
    """How many keys exceed the threshold in exactly which columns: ``region`` is a bit string."""
    flags = df.groupBy(key).agg(*[F.max((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > threshold).cast("int")).alias(f"f{i}") for i, c in enumerate(columns)])
    region = F.concat(*[F.col(f"f{i}").cast("string") for i in range(len(columns))])
    return flags.select(region.alias("region")).where(F.contains("region", F.lit("1"))).groupBy("region").agg(F.count("*").alias("n"))


def trisynthon_overlap(cube: Cube, experiment: str, threshold: float = 0.0) -> DataFrame:
    """Regions of compounds over all three replicates, or over the first two where there are not three."""
    columns = cube.indexes[experiment]
    if len(columns) < 2:
        raise ValueError("two replicates are needed")
    return regions(cube.data, cube.id_col, columns if len(columns) == 3 else columns[:2], threshold)


def threshold_of(df: DataFrame, columns: list[str], percentile: float = 90.0) -> DataFrame:
    """``threshold``, one row: a percentile of all positive finite values of several columns; 0 if there are none."""
    value = F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")
    some = df.select(value).where((F.col("v") > 0) & (F.col("v") < float("inf")))
    return some.agg(F.coalesce(F.percentile("v", F.lit(percentile / 100)), F.lit(0.0)).alias("threshold"))


def auto_threshold(df: DataFrame, columns: list[str], percentile: float = 90.0) -> float:
    """The value of ``threshold_of``."""
    return float(threshold_of(df, columns, percentile).first()[0])


def resolve_threshold(spec, experiment: str, df: DataFrame, columns: list[str]) -> float:
    """A number, a number for each experiment, ``auto``, or {mode, percentile or value}."""
    if isinstance(spec, dict) and "mode" not in spec:
        spec = spec.get(experiment, 0.0)
    if spec == "auto":
        spec = {"mode": "percentile", "percentile": 90.0}
    if isinstance(spec, dict):
        if spec["mode"] in ("percentile", "auto"):
            return auto_threshold(df, columns, float(spec.get("percentile", 90.0)))
        spec = spec.get("value", 0.0)
    return float(spec)


def disynthon_overlap(df: DataFrame, key: str, experiment: str, columns: list[str], threshold=0.0) -> DataFrame:
    """Regions of disynthons over the first three (or two) summed replicate columns."""
    columns = columns[:3]
    if len(columns) < 2:
        raise ValueError("two replicates are needed")
    one = df.select(key, *columns).dropDuplicates([key])
    t = resolve_threshold(threshold, experiment, one, columns)
    return regions(one, key, columns, t).select(F.lit(experiment).alias("experiment"), F.lit(t).alias("threshold"), "region", "n")


def replicate_correlation(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """Mean of the pairwise Pearson correlations over rows above the threshold in any column.

    Pairs with a constant side have none and are left out.
    """
    some = df.where(F.exists(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]), lambda x: x > threshold))
    x = {c: F.col(c).cast("double") for c in columns}
    made = []
    for a, b in combinations(columns, 2):
        n, sa, sb = F.count("*"), F.sum(x[a]), F.sum(x[b])
        cov, va, vb = n * F.sum(x[a] * x[b]) - sa * sb, n * F.sum(x[a] * x[a]) - sa * sa, n * F.sum(x[b] * x[b]) - sb * sb
        made.append(F.when((va > 0) & (vb > 0), F.try_divide(cov, F.sqrt(F.abs(va) * F.abs(vb)))))
    one = some.agg(F.array(*made).alias("r"))
    kept = F.filter("r", lambda v: v.isNotNull())
    return one.select(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), F.size(kept)).alias("correlation"))
