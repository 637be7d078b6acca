"""The analysis driver: a YAML file of flags runs the cube's steps in their fixed order."""

from __future__ import annotations

import os

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import cube as K
from tagloom.operators import overlap as O
from tagloom.operators.ml import forest_classification, forest_regression, hashed_fingerprint
from tagloom.operators.polyo import polyo
from tagloom.plans.report import analysis_report
from tagloom.sources.files import read_cube, write_csv


def comparison_blocks(block, defaults: dict) -> list[dict]:
    """One mapping, a list of them, or ``true``, as a list with defaults filled in."""
    if not block:
        return []
    if block is True:
        block = [{}]
    inner = block.get("comparisons", block) if isinstance(block, dict) else block
    return [defaults | (b or {}) for b in (inner if isinstance(inner, list) else [inner])]


def load_cube(spark: SparkSession, config: dict) -> K.Cube:
    general = config["general"]
    df, key = read_cube(spark, general["data"], general.get("ID_col"))
    return K.Cube(df, config["indexes"], config.get("control_cols") or {}, general.get("lib_size"), key)


def run_analysis(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every flagged step's result by name; ``cube`` is the final cube.  Files go to ``output_dir``."""
    with open(path) as f:
        config = yaml.safe_load(f)
    flags, out = config.get("flags") or {}, {}
    cube = load_cube(spark, config)
    first = next(iter(cube.indexes))
    controls = {e: c[0] for e, c in cube.controls.items() if c}
    if flags.get("SD_min"):
        out["SD_min"] = K.sampling_depth(cube)
    for name, step in (("NSC_values", K.nsc), ("MLE", K.mle), ("Z_score", K.z_score), ("z_score_log_data", K.z_score_log)):
        if flags.get(name):
            cube = step(cube)
    names: dict[str, list[str]] = {}
    if flags.get("disynthonize"):
        cube, names = K.disynthonize(cube)
    if flags.get("polyO"):
        cube = polyo(cube)
    for i, b in enumerate(comparison_blocks(flags.get("top_disynthons"), {"exp_name1": first, "comparison_type": "control", "comparison_metric": "avg", "top_count": 20, "key": "AB"})):
        versus = {"control": b.get("control_name") or controls.get(b["exp_name1"]), "exp": b.get("exp_name2"), "exp2": b.get("exp_name2"), "none": None}[b["comparison_type"]]
        out[f"top_disynthons_{i}"] = K.top_disynthons(cube, b["key"], b["exp_name1"], versus, b["comparison_metric"], b["top_count"])
    for b in comparison_blocks(flags.get("trisynthon_overlap"), {"threshold": 0.0}):
        for e in [b["experiment"]] if "experiment" in b else [e for e, c in cube.indexes.items() if len(c) > 1]:
            out[f"trisynthon_overlap_{e}"] = O.trisynthon_overlap(cube, e, float(b["threshold"]))
    for b in comparison_blocks(flags.get("disynthon_overlap"), {"threshold": 0.0}):
        for key, cols in names.items():
            if len(cols) > 1:
                out[f"disynthon_overlap_{key}"] = O.disynthon_overlap(cube.data, key.split("_", 1)[0], key.split("_", 1)[1], cols, b["threshold"])
    normalized = bool(flags.get("normalized_data"))
    if normalized:
        cube = K.normalize(cube)
    if flags.get("simple_spotfire_version"):
        out["spotfire"] = K.spotfire(cube, normalized)
    if "SMILES" in cube.data.columns and (flags.get("ml_fingerprints_to_RF") or flags.get("ml_fingerprints_to_classifier")):
        for e, cols in cube.indexes.items():
            value = K.row_mean(cols)
            picked = K.top_and_sample(cube, value, 100, 200).withColumn("__y", value).withColumn("__x", hashed_fingerprint(F.col("SMILES")))
            if flags.get("ml_fingerprints_to_RF"):
                out[f"rf_regression_{e}"] = forest_regression(picked, cube.id_col, "__x", "__y")
            if flags.get("ml_fingerprints_to_classifier"):
                t = float((flags["ml_fingerprints_to_classifier"] or {}).get("threshold", 2) if isinstance(flags["ml_fingerprints_to_classifier"], dict) else 2)
                out[f"rf_classifier_{e}"] = forest_classification(picked, cube.id_col, "__x", F.col("__y") > t)
    for b in comparison_blocks(flags.get("top_hits"), {"n": 20, "metric": "sum"}):
        for e in cube.indexes:
            out[f"top_hits_{e}"] = K.top_compounds(cube, e, b["n"], b["metric"])
    for i, b in enumerate(comparison_blocks(flags.get("top_delta_compounds"), {"exp_name": first, "top_count": 20, "metric": "sum"})):
        control = b.get("control") or cube.controls.get(b["exp_name"]) or []
        control = cube.indexes.get(control, [control]) if isinstance(control, str) else control
        if control:
            out[f"top_deltas_{i}"] = K.top_deltas(cube, b["exp_name"], control, b["top_count"], b["metric"])
    if flags.get("monosynthon_chemical_space"):
        split = K.split_ids(cube)
        for x in "ABC":
            if f"ID_{x}" in split.data.columns:
                out[f"monosynthons_{x}"] = K.monosynthons(split, x)
    folder = config["general"].get("output_dir")
    if folder:
        os.makedirs(folder, exist_ok=True)
        write_csv(cube.data, os.path.join(folder, "cube"), "overwrite")
        for name, df in out.items():
            write_csv(df, os.path.join(folder, name), "overwrite")
        if flags.get("report"):
            analysis_report({n: d for n, d in out.items() if n != "spotfire"}, "Analysis", os.path.join(folder, "report.html"))
    return out | {"cube": cube.data}
