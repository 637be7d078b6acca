"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline as C

from tagloom.llm.simhash import near_duplicates
from tagloom.llm.token_counts import count_tokens


def test_stages_take_effect(spark, tmp_path):
    sf, kept = "/root/testdata/sf0.01", {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == C.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_dedup":
            groups = near_duplicates(before).collect()
            assert kept[name] == {r.component_id for r in groups} and docs.count() == len(kept[name])
            assert len(kept[name]) < before.count()
        if name in ("language", "quality"):
            assert 0.5 * before.count() < docs.count() < before.count() + (name == "language")
            same = before.join(docs, C.COLUMNS, "left_semi")
            assert same.count() == docs.count()
        if name == "privacy":
            assert kept[name] == {r.doc_id for r in before.collect()}
            text = "\n".join(r.text for r in docs.collect())
            assert "[EMAIL]" in text and "[PHONE]" in text
            assert docs.where("n_chars <> length(text)").count() == 0
            tokens = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    total = {}
    for r in docs.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == tokens


def test_run_gives_the_last_stage(spark, sf):
    out = C.run(spark, sf)
    assert {"doc_id", "piece", "bucket", "batch", "slot"} <= {*out.columns} and out.count() > 0


def test_stages_on_awkward_tables(spark, awkward, none, tmp_path):
    """Nulls, repeated rows, missing ids, clashing columns and empty tables, through every stage."""
    for n, docs in enumerate((awkward, none)):
        for name, stage in C.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            out.write.parquet(f"{tmp_path}/{n}{name}")
            if name == "near_dedup":
                kept = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/{n}{name}").collect()]
                assert len(kept) == len({*kept}) and ((None, "no id here, one two three four five") in kept) == (n == 0)
            if name != "packing":
                assert out.columns == C.COLUMNS
                assert spark.read.parquet(f"{tmp_path}/{n}{name}").count() <= docs.count()
