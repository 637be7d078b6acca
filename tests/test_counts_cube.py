import itertools
import random

import pytest
import yaml
from pyspark.sql import functions as F

from tagloom.operators import collect as C
from tagloom.operators import cube as K
from tagloom.operators import overlap as O
from tagloom.operators.enumerate import build_tree, by_ids, enumerate_library, run_reactions, sizes
from tagloom.operators.library import Block, BlockSet, Library
from tagloom.operators.polyo import polyo
from tagloom.plans.analysis import run_analysis
from tagloom.plans.report import decoding_report


def umis(spark, rows):
    return spark.createDataFrame(rows, "library_id string, bb_ids string, umi string, c long")


def test_three_umis(spark):
    df = umis(spark, [("A", "x", "ACGT", 10), ("A", "x", "CCGT", 5), ("A", "x", "GCGT", 3)])
    assert C.raw_and_dedup(df).first()[2:] == (18, 3)
    assert C.corrected(df, "cluster").first()["count"] == 1 and C.corrected(df, "directional").first()["count"] == 2
    with pytest.raises(ValueError):
        C.corrected(df, "other")


def brute_components(counts, directional):
    names, left = list(counts), None
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(names, 2):
        if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 and (not directional or counts[a] >= 2 * counts[b] + 1 or counts[b] >= 2 * counts[a] + 1):
            parent[find(a)] = find(b)
    left = {find(n) for n in names}
    return len(left)


@pytest.mark.parametrize("small", [C.SMALL, 35, 0])
@pytest.mark.parametrize("method", ["cluster", "directional"])
def test_components_against_brute_force(spark, method, small):
    r, rows, truth = random.Random(2), [], {}
    for g in [("A", str(i)) for i in range(6)] + [("A", None), (None, "z")]:
        counts = {"".join(r.choice("ACGT") for _ in range(r.choice([4, 4, 4, 5]))): r.randint(1, 9) for _ in range(40)}
        truth[g] = brute_components(counts, method == "directional")
        rows += [(*g, u, n) for u, n in counts.items()]
    got = {(x[0], x[1]): x["count"] for x in C.corrected(umis(spark, rows), method, small).collect()}
    assert got == truth


def test_collect_and_count(spark):
    reads = [("A", "x", "ACGT", 1.0), ("A", "x", "ACGT", 2.0), ("A", None, "ACGA", 1.0), ("B", "y", "TTTT", 500.0), ("B", "y", "TTTA", None)]
    df = spark.createDataFrame(reads, "library_id string, bb_ids string, umi string, overall_score double")
    got = {(r[0], r[1]): [(x["k"], x["c"]) for x in r["umi_counts"]] for r in C.collect(df).collect()}
    assert got == {("A", "x"): [("ACGT", 2)], ("A", None): [("ACGA", 1)]}
    counted = C.count_compounds(C.collect(df), raw=True, dedup=True)
    assert {(r["bb_ids"], r["count"], r["raw_count"], r["dedup_count"]) for r in counted.collect()} == {("x", 1, 2, 1), (None, 1, 1, 1)}
    assert C.collect(df.limit(0)).count() == 0 and C.corrected(C.umi_counts(df.limit(0))).count() == 0
    summary = C.summarize(counted)
    filled = {r[0]: (r[1], r[2]) for r in C.zero_filled(summary, spark.createDataFrame([("A",), ("Z",)], "library_id string")).collect()}
    assert filled == {"A": (2, 2), "Z": (0, 0)}


@pytest.fixture
def small(spark):
    rows = [("A1-B1-C1", 4, 5, 0), ("A1-B1-C2", 2, 1, 1), ("A1-B2-C1", 0, 0, 2), ("A2-B1-C1", 6, 6, 0)]
    return K.Cube(spark.createDataFrame(rows, "DEL_ID string, x1 int, x2 int, ctrl int"), {"e": ["x1", "x2"]}, {"e": ["ctrl"]}, 8)


def test_hand_computed_metrics(small):
    depth = K.sampling_depth(small).first()
    assert depth["sampling_depth"] == 3.0 and depth["nsc_max"] == 4.0 and depth["sd_min"] == 2.5
    nsc = {r["DEL_ID"]: r["e_NSC"] for r in K.nsc(small).data.collect()}
    assert nsc == {"A1-B1-C1": 3.0, "A1-B1-C2": 1.0, "A1-B2-C1": 0.0, "A2-B1-C1": 4.0}
    mle = {r["DEL_ID"]: r["e_MLE"] for r in K.mle(small).data.collect()}
    assert mle["A1-B1-C1"] == pytest.approx(3 / 24 * 9.375 / 0.375)
    z = {r["DEL_ID"]: r["e_z_score"] for r in K.z_score(small).data.collect()}
    assert z["A1-B1-C1"] == pytest.approx((9 - 3) / (24 / 8 * 7 / 8) ** 0.5)
    norm = {r["DEL_ID"]: (r["x1"], r["x2"], r["e_avg"]) for r in K.normalize(small).data.collect()}
    assert norm["A1-B1-C2"] == (1, 0, 0.5) and norm["A1-B2-C1"] == (0, 0, 0.0)


def test_errors_and_two_cycles(spark, small):
    empty = K.Cube(small.data.withColumns({"x1": F.lit(0), "x2": F.lit(0)}), small.indexes, {}, 8)
    with pytest.raises(Exception, match="no counts"):
        K.z_score(empty).data.collect()
    two = K.Cube(spark.createDataFrame([("a-b", 1), ("a-c", 2)], "DEL_ID string, x1 int"), {"e": ["x1"]}, {}, 4)
    made, names = K.disynthonize(two)
    assert list(names) == ["AB_e"] and "AC" not in made.data.columns
    assert {c for c in polyo(two).data.columns if "PolyO" in c} == {"e_AB_PolyO_raw", "e_AB_PolyO"}
    with pytest.raises(Exception, match="parts"):
        K.split_ids(K.Cube(spark.createDataFrame([("a-b", 1), ("a-b-c", 2)], "DEL_ID string, x1 int").coalesce(1), {"e": ["x1"]}, {}, 4), 2).data.collect()


def test_overlap_and_ties(spark, small):
    got = {r["region"]: r["n"] for r in O.trisynthon_overlap(small, "e").collect()}
    assert got == {"11": 3}
    assert O.auto_threshold(small.data, ["x1", "x2"], 100) == 6.0
    assert O.replicate_correlation(small.data.withColumn("x2", F.lit(1)), ["x1", "x2"]).first()[0] is None
    ties = K.Cube(spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "DEL_ID string, x1 int"), {"e": ["x1"]})
    assert [r["DEL_ID"] for r in K.top_compounds(ties, "e", 2).collect()] == ["a", "b"]


def test_enumeration(spark):
    sets = [BlockSet("S1", [Block("a", "CC"), Block("a_null")]), BlockSet("S2", [Block("b", "N"), Block("c", "O")])]
    lib = Library("L", None, sets)
    assert sizes(lib) == 2
    rows = enumerate_library(spark, lib, lambda s: ".".join(s)).collect()
    assert {(r["DEL_ID"], r["SMILES"]) for r in rows} == {("L-a-b", "CC.N"), ("L-a-c", "CC.O")}
    failing = run_reactions(enumerate_library(spark, lib).drop("SMILES"), ["BB1_SMILES", "BB2_SMILES"], lambda s: None if s[1] == "O" else "x", "drop")
    assert [r["DEL_ID"] for r in failing.collect()] == ["L-a-b"]
    assert by_ids(spark, lib, ["a", "c"])["DEL_ID"] == "L-a-c"
    with pytest.raises(KeyError):
        by_ids(spark, lib, ["a", "zz"])


def test_reaction_tree():
    steps = {
        "one": {"step_id": 1, "rxn_smarts": "A>>B", "reactants": ["S1", ["S2:::x", "S2:::y"]]},
        "two": {"step_id": 2, "rxn_smarts": ["B>>C", "B>>D"], "reactants": ["product_one", "CCO"]},
    }
    tree = build_tree(steps, ["S1", "S2"])
    assert len(tree.threads) == 2 and [s.name for s in tree.thread_of(["S1", "S2:::y"])] == ["one", "two"]
    with pytest.raises(KeyError):
        tree.thread_of(["S1"])
    steps["two"]["reactants"] = ["product_one", "S1"]
    with pytest.raises(ValueError):
        build_tree(steps, ["S1", "S2"])


def test_analysis_run(spark, small, tmp_path):
    small.data.toPandas().to_csv(tmp_path / "cube.csv", index=False)
    flags = {"SD_min": True, "NSC_values": True, "MLE": True, "Z_score": True, "z_score_log_data": True, "disynthonize": True, "polyO": True, "top_disynthons": {"comparisons": [{"exp_name1": "e"}]}, "trisynthon_overlap": True, "disynthon_overlap": {"threshold": "auto"}, "normalized_data": True, "simple_spotfire_version": True, "top_hits": {"n": 2}, "top_delta_compounds": {}, "monosynthon_chemical_space": True, "report": True}
    config = {"general": {"data": str(tmp_path / "cube.csv"), "lib_size": 8, "output_dir": str(tmp_path / "out")}, "indexes": {"e": ["x1", "x2"]}, "control_cols": {"e": ["ctrl"]}, "flags": flags}
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(config))
    out = run_analysis(spark, str(tmp_path / "a.yaml"))
    assert {"SD_min", "top_disynthons_0", "trisynthon_overlap_e", "disynthon_overlap_AB_e", "spotfire", "top_hits_e", "monosynthons_A", "cube"} <= set(out)
    assert (tmp_path / "out/report.html").read_text().startswith("<!DOCTYPE html>")
    assert "ctrl" not in out["spotfire"].columns and "e_NSC" in out["spotfire"].columns


def test_report():
    text = decoding_report({"num_seqs_read": 5, "num_seqs_decoded_per_lib": {"L<1>": 3}, "num_failed_AmbiguousBuildingBlockBarcode": 2}, "T")
    assert "L&lt;1&gt;" in text and "AmbiguousBuildingBlockBarcode" in text and "<svg" in text
