"""Cubes: compounds by selection counts, and the enrichment statistics on them.

A Cube is an immutable pair of a wide DataFrame and its description; every metric returns a new one.
Whole-table totals are computed in one aggregation and attached as a one-row broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = {"AB": ("A", "B"), "AC": ("A", "C"), "BC": ("B", "C")}


@dataclass(frozen=True)
class Cube:
    """``indexes`` and ``controls`` name the replicate columns of each experiment."""

    data: DataFrame
    indexes: dict[str, list[str]]
    controls: dict[str, list[str]] = field(default_factory=dict)
    lib_size: int | None = None
    id_col: str = "DEL_ID"

    def with_data(self, data: DataFrame, **changes) -> Cube:
        return replace(self, data=data, **changes)


def row_sum(columns: list[str]) -> Column:
    """Sum over columns; nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])


def row_mean(columns: list[str]) -> Column:
    """Mean over the columns that are not null."""
    some = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNotNull().cast("int") for c in columns])
    return F.try_divide(row_sum(columns), some)


def totals(cube: Cube, **aggregates: Column) -> DataFrame:
    """The data with one-row aggregates as further columns."""
    return cube.data.crossJoin(F.broadcast(cube.data.agg(*[c.alias(n) for n, c in aggregates.items()])))


def split_ids(cube: Cube, parts: int | None = None) -> Cube:
    """ID_A, ID_B (, ID_C) right after the id; ``parts`` is taken from one row if not given.

    Two or three parts are allowed; nothing happens if all of ID_A, ID_B, ID_C are there.
    """
    names = [f"ID_{x}" for x in "ABC"]
    if all(n in cube.data.columns for n in names):
        return cube
    if parts is None:
        first = cube.data.select(cube.id_col).where(F.col(cube.id_col).isNotNull()).first()
        parts = len(first[0].split("-")) if first else 3
    if parts not in (2, 3):
        raise ValueError(f"ids have {parts} parts; 2 or 3 are expected")
    pieces = F.split(F.col(cube.id_col), "-")
    checked = F.when(F.col(cube.id_col).isNotNull() & (F.size(pieces) != parts), F.raise_error(F.concat(F.lit("id does not have the parts of the others: "), F.col(cube.id_col)))).otherwise(pieces)
    out = []
    for c in cube.data.columns:
        if c not in names:
            out.append(F.col(f"`{c}`"))
        if c == cube.id_col:
            out += [F.element_at(checked, i + 1).alias(n) for i, n in enumerate(names[:parts])]
    return cube.with_data(cube.data.select(*out))


def sampling_depth(cube: Cube) -> DataFrame:
    """Per experiment: depth, the largest normalised count, and the least depth for ten counts there."""
    sums = {e: row_sum(cols) for e, cols in cube.indexes.items()}
    one = cube.data.agg(*[F.sum(s).alias(f"t{i}") for i, s in enumerate(sums.values())], *[F.max(s).alias(f"m{i}") for i, s in enumerate(sums.values())])
    rows = F.array(*[F.struct(F.lit(e).alias("experiment"), F.col(f"t{i}").alias("t"), F.col(f"m{i}").alias("m")) for i, e in enumerate(sums)])
    depth = F.col("x.t") / cube.lib_size
    nsc = F.bround(F.try_divide(F.col("x.m"), depth), 2)
    return one.select(F.explode(rows).alias("x")).select("x.experiment", depth.alias("sampling_depth"), nsc.alias("nsc_max"), F.try_divide(F.lit(10.0), nsc).alias("sd_min"))


def nsc(cube: Cube, intervals: bool = False) -> Cube:
    """{e}_sum and {e}_NSC: the row sum over the mean count of a library member; on demand Poisson bounds."""
    df = totals(cube, **{f"__{e}": F.sum(row_sum(c)) for e, c in cube.indexes.items()})
    for e, cols in cube.indexes.items():
        depth = F.col(f"__{e}") / cube.lib_size
        df = df.withColumn(f"{e}_sum", row_sum(cols)).withColumn(f"{e}_NSC", F.try_divide(F.col(f"{e}_sum"), depth))
        if intervals:
            root = F.sqrt(F.col(f"{e}_sum") + 1)
            df = df.withColumn(f"{e}_NSC+", F.try_divide(F.pow(root + 1, 2), depth)).withColumn(f"{e}_NSC-", F.try_divide(F.pow(root - 1, 2), depth))
    return cube.with_data(df.drop(*[f"__{e}" for e in cube.indexes]))


def mle(cube: Cube) -> Cube:
    """{e}_MLE: maximum-likelihood enrichment over the control; of several controls the last counts."""
    used = {e: cube.controls[e][-1] for e in cube.indexes if cube.controls.get(e)}
    sums = {f"__t_{e}": F.sum(row_sum(cube.indexes[e])) for e in used} | {f"__c_{e}": F.sum(F.coalesce(F.col(c), F.lit(0)).cast("double")) for e, c in used.items()}
    if not used:
        return cube
    df = totals(cube, **sums)
    for e, c in used.items():
        ratio = F.try_divide(F.col(f"__c_{e}"), F.col(f"__t_{e}"))
        df = df.withColumn(f"{e}_MLE", ratio * (row_sum(cube.indexes[e]) + 3 / 8) / (F.coalesce(F.col(c), F.lit(0)) + 3 / 8))
    return cube.with_data(df.drop(*sums))


def z_score(cube: Cube) -> Cube:
    """{e}_C, _E, _sigma, _z_score, _norm_z_score against a uniform library; an empty experiment raises."""
    df = totals(cube, **{f"__{e}": F.sum(row_sum(c)) for e, c in cube.indexes.items()})
    p = 1 / cube.lib_size
    for e, cols in cube.indexes.items():
        t = F.when(F.col(f"__{e}") > 0, F.col(f"__{e}")).otherwise(F.raise_error(F.lit(f"no counts in {e}")).cast("double"))
        df = df.withColumn(f"{e}_C", row_sum(cols)).withColumn(f"{e}_E", t * p).withColumn(f"{e}_sigma", F.sqrt(t * p * (1 - p)))
        df = df.withColumn(f"{e}_z_score", (F.col(f"{e}_C") - F.col(f"{e}_E")) / F.col(f"{e}_sigma")).withColumn(f"{e}_norm_z_score", F.col(f"{e}_z_score") / F.sqrt(F.col(f"__{e}")))
    return cube.with_data(df.drop(*[f"__{e}" for e in cube.indexes]))


def z_score_log(cube: Cube) -> Cube:
    """{e}_z_score_log: log1p of the replicate mean, standardised by the control's log counts.

    Zero controls count as the median of the positive ones; of several controls the last counts.  A
    control without counts or without spread raises.
    """
    used = {e: cube.controls[e][-1] for e in cube.indexes if cube.controls.get(e)}
    df = cube.data
    for e, c in used.items():
        medians = cube.data.agg(F.median(F.when(F.col(c) > 0, F.col(c)).cast("double")).alias("__m"))
        df = df.crossJoin(F.broadcast(medians))
        log_c = F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.log1p("__m")).otherwise(F.log1p(F.col(c).cast("double")))
        base = cube.data.crossJoin(F.broadcast(medians)).agg(F.avg(log_c).alias("__a"), F.stddev_samp(log_c).alias("__s"))
        safe = F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.raise_error(F.lit(f"control of {e} has no counts or no spread")).cast("double"))
        df = df.crossJoin(F.broadcast(base)).withColumn(f"{e}_z_score_log", (F.log1p(row_sum(cube.indexes[e]) / len(cube.indexes[e])) - F.col("__a")) / safe).drop("__m", "__a", "__s")
    return cube.with_data(df)


def normalize(cube: Cube) -> Cube:
    """Replicates minus the first control, not below 0, and their mean as {e}_avg."""
    df = cube.data
    for e, cols in cube.indexes.items():
        if cube.controls.get(e):
            control = F.coalesce(F.col(cube.controls[e][0]), F.lit(0))
            df = df.withColumns({c: F.greatest(F.col(c) - control, F.lit(0)) for c in cols})
        df = df.withColumn(f"{e}_avg", row_mean(cols))
    return cube.with_data(df)


def synthon_pairs(df: DataFrame) -> dict[str, Column]:
    """The disynthon keys that the ids allow: AB, and with a third cycle AC and BC."""
    have = {x for x in "ABC" if f"ID_{x}" in df.columns}
    return {k: F.concat_ws("-", f"ID_{a}", f"ID_{b}") for k, (a, b) in PAIRS.items() if {a, b} <= have}


def disynthonize(cube: Cube) -> tuple[Cube, dict[str, list[str]]]:
    """Keys AB, AC, BC and count_{key}_{e}_{column}: sums over all compounds that share the key.

    Each key is aggregated on its own and joined back: unlike a window, the aggregation combines
    before its shuffle, and the join's skewed keys can be split.
    """
    cube = split_ids(cube)
    keys = synthon_pairs(cube.data)
    df, names = cube.data.withColumns(keys), {}
    base = df
    for k in keys:
        sums = {f"count_{k}_{e}_{c}": F.sum(F.col(c)) for e, cols in cube.indexes.items() for c in cols}
        df = df.join(base.groupBy(k).agg(*[s.alias(n) for n, s in sums.items()]), k)
        names |= {f"{k}_{e}": [f"count_{k}_{e}_{c}" for c in cols] for e, cols in cube.indexes.items()}
    order = [*cube.data.columns, *keys, *[c for cols in names.values() for c in cols]]
    return cube.with_data(df.select(*[f"`{c}`" for c in order])), names


def disynthon_table(cube: Cube, key: str, experiments: dict[str, list[str]]) -> DataFrame:
    """One row a disynthon: {e}_sum and {e}_avg of each experiment's summed replicates."""
    cube = split_ids(cube)
    df = cube.data.withColumns(synthon_pairs(cube.data))
    cols = sorted({c for cs in experiments.values() for c in cs})
    table = df.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols])
    out = [F.col(key)]
    for e, cs in experiments.items():
        out += [row_sum(cs).alias(f"{e}_sum"), row_mean(cs).alias(f"{e}_avg")]
    return table.select(*out)


def top_disynthons(cube: Cube, key: str, experiment: str, versus: str | None = None, metric: str = "avg", k: int = 20) -> DataFrame:
    """The k disynthons with the largest metric, or the largest lead over ``versus``: another
    experiment, or a control column.  Both sides come from one aggregation; ties go to the lesser key."""
    groups = {experiment: cube.indexes[experiment]}
    if versus:
        groups[versus] = cube.indexes.get(versus, [versus])
    table = disynthon_table(cube, key, groups)
    lead = F.col(f"{experiment}_{metric}") - (F.col(f"{versus}_{metric}") if versus else F.lit(0))
    columns = [f"{e}_{metric}" for e in groups]
    return table.select(key, *columns, lead.alias("lead")).orderBy(F.desc("lead"), key).limit(k)


def top_compounds(cube: Cube, experiment: str, k: int = 20, metric: str = "sum") -> DataFrame:
    """The k compounds with the largest sum or mean among those seen in all replicates."""
    cols = cube.indexes[experiment]
    value = row_sum(cols) if metric == "sum" else row_mean(cols)
    seen = cube.data.where(F.forall(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x > 0))
    return seen.select(cube.id_col, value.alias(f"{experiment}_{metric}")).orderBy(F.desc(f"{experiment}_{metric}"), cube.id_col).limit(k)


def top_deltas(cube: Cube, experiment: str, control: list[str], k: int = 20, metric: str = "sum") -> DataFrame:
    """The k compounds that lead their control most; ``metric``: sum, avg or an existing {e}_{metric}."""
    fold = {"sum": row_sum, "avg": row_mean}
    own = fold[metric](cube.indexes[experiment]) if metric in fold else F.col(f"{experiment}_{metric}").cast("double")
    other = row_mean(control) if metric == "avg" else row_sum(control)
    return cube.data.select(cube.id_col, own.alias("value"), other.alias("control"), (own - other).alias("delta")).orderBy(F.desc("delta"), cube.id_col).limit(k)


METRICS = ("_sum", "_avg", "NSC", "MLE", "z_score", "PolyO")


def spotfire(cube: Cube, normalized: bool = False) -> DataFrame:
    """The export: columns up to SMILES (else the id and the keys), replicates with their experiment
    in front, sums, means and metrics, rounded half-even to two places; controls go after normalizing."""
    controls = {c for cs in cube.controls.values() for c in cs}
    replicates = {c: e for e, cs in cube.indexes.items() for c in cs}
    names = cube.data.columns
    head = names[: names.index("SMILES") + 1] if "SMILES" in names else [c for c in names if c == cube.id_col or c in ("ID_A", "ID_B", "ID_C")]
    out = [F.col(f"`{c}`") for c in head if c not in replicates and c not in controls]
    for e, cs in cube.indexes.items():
        out += [F.bround(F.col(f"`{c}`").cast("double"), 2).alias(f"{e}_{c}") for c in cs]
        out += [F.bround(row_sum(cs), 2).alias(f"{e}_sum"), F.bround(row_mean(cs), 2).alias(f"{e}_avg")]
    if not normalized:
        out += [F.col(f"`{c}`") for c in sorted(controls)]
    done = {f"{e}_{m}" for e in cube.indexes for m in ("sum", "avg")}
    out += [F.bround(F.col(f"`{c}`").cast("double"), 2).alias(c) for c in names if c not in head and c not in done and c not in replicates and any(m in c for m in METRICS)]
    return cube.data.select(*out)


def monosynthons(cube: Cube, cycle: str = "A", columns: list[str] | None = None) -> DataFrame:
    """Per building block of a cycle: mean of the row sums, its SMILES (of the least id), compounds."""
    cube = split_ids(cube)
    columns = columns or [c for cs in cube.indexes.values() for c in cs]
    key, smiles = f"ID_{cycle}", f"SMILES_{cycle}"
    first = F.min_by(F.col(smiles), F.col(cube.id_col)) if smiles in cube.data.columns else F.lit(None).cast("string")
    return cube.data.groupBy(key).agg(F.avg(row_sum(columns)).alias("mean_sum"), first.alias("smiles"), F.count("*").alias("n_compounds"))


def top_and_sample(cube: Cube, value: Column, top: int, sample: int, seed: int = 42) -> DataFrame:
    """The ``top`` best rows and ``sample`` of the rest in the order of md5("seed-id"); ``part`` tells which.

    Two bounded top-k steps: the rest is what an anti-join with the few best rows leaves.
    """
    scored = cube.data.withColumn("__v", value)
    best = scored.orderBy(F.desc("__v"), cube.id_col).limit(top)
    rest = scored.join(F.broadcast(best.select(cube.id_col)), cube.id_col, "left_anti")
    drawn = rest.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(cube.id_col).cast("string")).cast("binary")), cube.id_col).limit(sample)
    return best.withColumn("part", F.lit("top")).unionByName(drawn.withColumn("part", F.lit("sample"))).drop("__v")


def cubify(counted: DataFrame, letters: str = "i", selection: str | None = None, raw_least: int = 0, dedup_least: int = 0, count_least: int = 0) -> DataFrame:
    """Counted compounds as cube rows: thresholds, then the columns the letters name, then, with a
    selection column, one count column for each selection.

    i: compound id without library, l: library, s: SMILES, b: building-block ids, B: their SMILES,
    e: corrected, d: deduplicated, r: raw count.
    """
    bbs = F.split("bb_ids", ",")
    have = set(counted.columns)
    df = counted
    for name, least in (("raw_count", raw_least), ("dedup_count", dedup_least), ("count", count_least)):
        if name in have:
            df = df.where(F.col(name) >= least)
    width = max(1, (df.agg(F.max(F.size(bbs))).first()[0] or 1)) if "b" in letters else 1
    choices = {
        "i": [F.array_join(bbs, "-").alias("DEL_ID")],
        "l": [F.col("library_id")],
        "s": [F.col("smiles")] if "smiles" in have else [],
        "b": [F.get(bbs, i).alias(f"bb{i + 1}") for i in range(width)],
        "B": [F.col(c) for c in counted.columns if c.startswith("bb") and c.endswith("_smiles")],
        "e": [F.col("count")] if "count" in have else [],
        "d": [F.col("dedup_count")] if "dedup_count" in have else [],
        "r": [F.col("raw_count")] if "raw_count" in have else [],
    }
    unknown = set(letters) - set(choices)
    if unknown:
        raise ValueError(f"unknown letters: {''.join(sorted(unknown))}")
    if selection is None:
        return df.select(*[c for x in letters for c in choices[x]])
    keys = [c for x in letters if x in "ilsbB" for c in choices[x]]
    values = {"e": "count", "d": "dedup_count", "r": "raw_count"}
    folds = [F.sum(values[x]).alias(values[x]) for x in letters if x in values and values[x] in have]
    names = df.select(*keys).columns
    slim = df.select(*keys, F.col(selection).alias("__selection"), *[F.col(values[x]) for x in letters if x in values and values[x] in have])
    return slim.groupBy(*names).pivot("__selection").agg(*folds).na.fill(0)
