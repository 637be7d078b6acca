"""The command line from reads to counts, and enumeration thread by thread."""

import json

import pytest

from tagloom.cli import main
from tagloom.operators import collect as U
from tagloom.operators.enumerate import build_tree, enumerate_threads, sizes
from tagloom.operators.library import Block, BlockSet, Library
from tagloom.sources import files
from tagloom.sources.library import DataFolder


@pytest.fixture
def selection(tmp_path):
    """A library of nine compounds, 40 reads of which some fail, and a selection of them."""
    DataFolder.create(str(tmp_path / "data"))
    tags = ["ACAC", "GGTT", "TTAA"]
    for c in "AB":
        (tmp_path / "data/building_blocks" / f"S{c}.csv").write_text("id,tag\n" + "".join(f"{c}{i},{t}\n" for i, t in enumerate(tags)))
    schema = {"primer": {"tag": "GTAGATCTTAGATTCG"}, "library": {"tag": "ACCTTGGCAC"}, "bb1": {"tag": "NNNN"}, "bb2": {"tag": "NNNN"}, "static": {"tag": "CCTAGATTAG"}, "umi": {"tag": "NNNNNN"}}
    (tmp_path / "data/libraries/LIB.json").write_text(json.dumps({"barcode_schema": schema, "bb_sets": [{"cycle": 1, "bb_set_name": "SA"}, {"cycle": 2, "bb_set_name": "SB"}]}))
    (tmp_path / "data/libraries/OTHER.json").write_text(json.dumps({"barcode_schema": schema | {"library": {"tag": "TTGACGGATC"}}, "bb_sets": [{"cycle": 1, "bb_set_name": "SA"}, {"cycle": 2, "bb_set_name": "SB"}]}))
    reads, truth = [], []
    for i in range(40):
        a, b, umi = i % 3, i // 3 % 3, "ACGTAC"[: 5] + "ACGT"[i % 2]
        bad = i % 10 == 9
        reads.append("GTAGATCTTAGATTCGACCTTGGCAC" + ("NNNN" if bad else tags[a]) + tags[b] + "CCTAGATTAG" + umi)
        if not bad:
            truth.append((f"A{a},B{b}", umi))
    (tmp_path / "x.fastq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    (tmp_path / "sel.yaml").write_text("libraries: [LIB, OTHER]\nsequence_files: [x.fastq]\n")
    return tmp_path, truth


def test_from_reads_to_counts(spark, selection):
    at, truth = selection
    path = lambda name: str(at / name)
    main(["decode", path("sel.yaml"), "--data-dir", path("data"), "--out", path("out"), "--save-failed"])
    stats = json.loads((at / "out/sel_stats.json").read_text())
    assert stats == {"num_failed_FailedBuildingBlockCall": 4, "num_seqs_decoded_per_lib": {"LIB": 36}, "num_seqs_read": 40}
    assert "40 reads" in (at / "out/sel_report.html").read_text()
    decoded = files.read_decoded(spark, path("out/sel_decoded.tsv"))
    assert sorted((r.bb_ids, r.umi) for r in decoded.collect()) == sorted(truth)
    with pytest.raises(Exception):
        main(["decode", path("sel.yaml"), "--data-dir", path("data"), "--out", path("out")])
    main(["decode", path("sel.yaml"), "--data-dir", path("data"), "--out", path("out"), "--overwrite"])

    main(["collect", path("out/sel_decoded.tsv"), "--out", path("c1.json")])
    main(["collect", path("out/sel_decoded.tsv"), path("out/sel_decoded.tsv"), "--out", path("c2.json"), "--compress"])
    main(["merge", "collected", path("c1.json"), path("c2.json"), "--out", path("c3.json")])
    once, thrice = (files.read_collected(spark, path(n)) for n in ("c1.json", "c3.json"))
    tripled = {(r.bb_ids, r.umi): 3 * r.c for r in U.exploded(once).collect()}
    assert {(r.bb_ids, r.umi): r.c for r in U.exploded(thrice).collect()} == tripled

    main(["count", path("c1.json"), "--out", path("n.tsv"), "--format", "tsv", "--method", "none", "--raw", "--dedup"])
    counted = files.read_counted(spark, path("n.tsv")).collect()
    want = {}
    for bb, umi in truth:
        want.setdefault(bb, []).append(umi)
    assert {r.bb_ids: (r["count"], r.raw_count, r.dedup_count) for r in counted} == {k: (len({*v}), len(v), len({*v})) for k, v in want.items()}
    main(["count", path("c1.json"), "--out", path("d.parquet")])
    main(["merge", "counted", path("d.parquet"), path("d.parquet"), "--out", path("dd.parquet")])
    assert spark.read.parquet(path("dd.parquet")).count() == 2 * len(want)
    main(["summarise", path("n.tsv"), "--out", path("s.json"), "--selection", path("sel.yaml"), "--data-dir", path("data")])
    assert json.loads((at / "s.json").read_text()) == {"LIB": {"num_compounds": len(want), "num_molecules": sum(len({*v}) for v in want.values())}, "OTHER": {"num_compounds": 0, "num_molecules": 0}}
    main(["merge", "stats", path("out/sel_stats.json"), path("out/sel_stats.json"), "--out", path("m.json")])
    assert json.loads((at / "m.json").read_text())["num_seqs_read"] == 80
    main(["report", path("m.json"), "--out", path("r.html"), "--title", "Both"])
    assert "80 reads" in (at / "r.html").read_text()


def test_enumerate(spark, selection, capsys):
    at, _ = selection
    main(["enumerate", "LIB", "--data-dir", str(at / "data"), "--count-only"])
    assert capsys.readouterr().out.strip() == "9"
    main(["enumerate", "LIB", "--data-dir", str(at / "data"), "--out", str(at / "e.parquet")])
    assert {r.DEL_ID for r in spark.read.parquet(str(at / "e.parquet")).collect()} == {f"LIB-A{i}-B{j}" for i in range(3) for j in range(3)}
    with pytest.raises(SystemExit):
        main(["enumerate", "LIB", "--data-dir", str(at / "data")])


def threaded() -> tuple[Library, object]:
    """Acids and esters of set a react with set b in steps of their own."""
    a = BlockSet("a", [Block("a0", "C", "acid"), Block("a1", "CC", "acid"), Block("NULL_a", "C", "acid"), Block("a2", "CCC", "ester")])
    b = BlockSet("b", [Block("b0", "N"), Block("b1", "bad"), Block("b2", "O", None, "tool")])
    steps = {"one": {"step_id": 1, "rxn_smarts": "amide", "reactants": [["a:::acid", "a:::ester"], "b"]}}
    return Library("L", None, [a, b]), build_tree(steps, ["a", "b"])


def test_enumeration_by_threads(spark):
    library, tree = threaded()
    assert len(tree.threads) == 2 and sizes(library, tree) == 6

    def runner_of(steps, order):
        name = order[0]
        return lambda smiles: None if "bad" in smiles else f"{name}:{'.'.join(smiles)}:{steps[-1].smarts[0]}"

    rows = {r.DEL_ID: r for r in enumerate_threads(spark, library, tree, runner_of).collect()}
    assert {k: r.SMILES for k, r in rows.items()} == {f"L-a{i}-b{j}": f"a:::{'ester' if i == 2 else 'acid'}:{'C' * (i + 1)}.N:amide" if j == 0 else None for i in range(3) for j in range(2)}
    assert {r.thread for r in rows.values()} == {"a:::acid,b", "a:::ester,b"}
    kept = enumerate_threads(spark, library, tree, runner_of, "drop").collect()
    assert {r.DEL_ID for r in kept} == {"L-a0-b0", "L-a1-b0", "L-a2-b0"}
    some = enumerate_threads(spark, library, tree, threads=[frozenset(["a:::ester", "b"])]).collect()
    assert {r.DEL_ID for r in some} == {"L-a2-b0", "L-a2-b1"} and all(r.SMILES is None for r in some)
    with pytest.raises(Exception, match="no product"):
        enumerate_threads(spark, library, tree, runner_of, "raise").collect()
    with pytest.raises(KeyError):
        enumerate_threads(spark, library, tree, threads=[frozenset(["a"])])
