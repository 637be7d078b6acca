"""PolyO: how unlikely the counts of all compounds that share a feature are together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.stats import log_poisson, tail_start
from tagloom.operators.cube import Cube, row_sum, split_ids, synthon_pairs
from tagloom.session import cut


def features_of(df: DataFrame, mode: str) -> list[str]:
    """The feature columns of a mode that the ids allow."""
    if mode == "disynthon":
        return list(synthon_pairs(df))
    if mode == "monosynthon":
        return [f"ID_{x}" for x in "ABC" if f"ID_{x}" in df.columns]
    raise ValueError(f"unknown feature mode {mode!r}")


def polyo(cube: Cube, mode: str = "disynthon", compat: bool = False, cutoff: float = 0.01) -> Cube:
    """{e}_{feature}_PolyO_raw and {e}_{feature}_PolyO for every feature.

    raw: minus the sum of log10 Poisson probabilities over the feature's compounds; the rate is the
    experiment's total over the library size.  ``compat`` multiplies probabilities instead, whose
    underflow becomes 0.  score: raw over the base from the two cutoffs.

    The cube is written once to the shared folder: totals and every feature read it from there,
    instead of counting the reads again for each.
    """
    cube = split_ids(cube)
    keys = synthon_pairs(cube.data)
    df = cut(cube.data.withColumns(keys))
    features = features_of(cube.data, mode)
    sums = {e: row_sum(c) for e, c in cube.indexes.items()}
    base = df
    stats = base.agg(*[F.sum(s).alias(e) for e, s in sums.items()], *[F.count_distinct(f).alias(f"n_{f}") for f in features]).first()
    s_bar = sum(stats[e] or 0.0 for e in sums) / cube.lib_size
    for f in features:
        logs = {}
        for e, s in sums.items():
            pmf = log_poisson(s, (stats[e] or 0.0) / cube.lib_size)
            logs[e] = -F.log10(F.nullif(F.product(F.exp(pmf)), F.lit(0.0))) if compat else -F.sum(pmf) / math.log(10)
        bound = polyo_base(cube.lib_size, stats[f"n_{f}"], s_bar, cutoff)
        df = df.join(base.groupBy(f).agg(*[F.coalesce(v, F.lit(0.0)).alias(f"{e}_{f}_PolyO_raw") for e, v in logs.items()]), f)
        df = df.withColumns({f"{e}_{f}_PolyO": F.col(f"{e}_{f}_PolyO_raw") / bound if bound else F.lit(0.0) for e in sums})
    new = [f"{e}_{f}_{x}" for f in features for e in sums for x in ("PolyO_raw", "PolyO")]
    order = [*cube.data.columns, *[k for k in keys if k not in cube.data.columns], *new]
    return cube.with_data(df.select(*[f"`{c}`" for c in order]))


def cutoffs(lib_size: int, n_features: int, s_bar: float, threshold: float = 0.01) -> tuple[int, int]:
    """Compounds and reads from which a feature is unlikely by chance."""
    return tail_start(lib_size / max(1, n_features), threshold), tail_start(s_bar, threshold)


def polyo_base(lib_size: int, n_features: int, s_bar: float, threshold: float = 0.01) -> float:
    """-C_cpd log10(s^C_read e^-s / C_read!)."""
    compounds, reads = cutoffs(lib_size, n_features, s_bar, threshold)
    if s_bar <= 0:
        return 0.0
    return -compounds * (reads * math.log(s_bar) - s_bar - math.lgamma(reads + 1)) / math.log(10)
