"""Held-out accuracy and edge cases of the two classifiers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import langid, quality, queries


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


def test_language_on_held_out_documents(larger):
    """Fitted with the labels of four in five documents; the rest are told by text and host alone."""
    held = larger.withColumn("told", F.when(F.xxhash64("doc_id") % 5 != 0, F.col("lang")))
    found = langid.identify(held, label="told").where("told IS NULL AND length(trim(text)) >= 40 AND lang IS NOT NULL")
    r = found.agg(F.avg((F.col("lang_id") == F.col("lang")).cast("double")).alias("right"), F.avg(F.col("keep").cast("double")).alias("kept")).first()
    assert r.right > 0.9 and r.kept > 0.9, r


def test_language_rejects_junk(spark, larger):
    junk = spark.createDataFrame([(-1, "!!! 12345 %%% ### 999", "x"), (-2, "", None), (-3, None, None)], "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    found = langid.identify(larger.select("doc_id", "text", "source", "lang").union(junk.select("doc_id", "text", "source", "lang"))).where("doc_id < 0").collect()
    assert len(found) == 3 and not any(r.keep for r in found) and {r.lang_id for r in found} == {"und"}


def test_evidence_is_fused(spark, larger):
    """The same undecided text goes where its markup, its host or its suffix points."""
    base = larger.select("doc_id", "text", "lang", F.concat(F.lit("site."), "lang").alias("source"), F.concat(F.lit("http://site."), "lang", F.lit("/x")).alias("url"))
    langs = [r[0] for r in larger.where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()]
    a, b = langs[0], langs[-1]
    odd = [(-1, "xx", f"site.{a}", f"http://site.{a}/y"), (-2, "xx", f"site.{b}", f"http://site.{b}/y"), (-3, f'<html lang="{a}">xx', None, None), (-4, f"<html lang='{b}-XY'>xx", None, None), (-5, "xx", None, f"https://other.{a}:80/?q"), (-6, "xx", "unseen", f"other.{b}")]
    more = spark.createDataFrame(odd, "doc_id long, text string, source string, url string").withColumn("lang", F.lit(None).cast("string"))
    found = langid.identify(base.unionByName(more.select(*base.columns)), address="url").where("doc_id < 0")
    assert {r.doc_id: r.lang_id for r in found.collect()} == {-1: a, -2: b, -3: a, -4: b, -5: a, -6: b}


def plain_identify(rows, langs, table):
    """The fused posterior by plain sums: rows of (id, text, host, url), none of them marked up twice."""
    import re
    from collections import defaultdict

    n = len(langs)

    def posterior(text):
        raw = text.encode().lower()
        hits = [(raw[i] * 7919 + raw[i + 1] * 263 + raw[i + 2] * 40503) % langid.BUCKETS for i in range(len(raw) - 2)]
        total = sum((table[h].astype(float) for h in hits), np.zeros(n)) * min(1, langid.FULL / max(1, len(hits)))
        p = np.exp(total - total.max())
        return p / p.sum()

    seen, by = [], {"globe": np.zeros(n), "suffix": defaultdict(lambda: np.zeros(n)), "host": defaultdict(lambda: np.zeros(n))}
    for i, text, host, url in rows:
        said = re.search(r"<html[^>]*\slang=[\"']?([a-z]{2,3})", text or "")
        p = posterior(re.sub("<[^<>]*>", " ", text) if said else text or "")
        suffix = re.search(r"\.([a-z]{2,})(?:[:/?]|$)", url)[1] if url else None
        seen.append((i, text, host, suffix, said and said[1], p))
        by["globe"] += p
        if suffix:
            by["suffix"][suffix] += p
        if host:
            by["host"][host, suffix] += p
    w = langid.WEIGHT
    globe = (by["globe"] + w / n) / (by["globe"].sum() + w)
    over = {k: (v + w * globe) / (v.sum() + w) for k, v in by["suffix"].items()}
    prior = {k: (v + w * over.get(k[1], globe)) / (v.sum() + w) for k, v in by["host"].items()}
    claims = [(s, p) for *_, s, p in seen if s in langs]
    trust = (sum(p[langs.index(s)] for s, p in claims) + 9) / (sum(p.sum() for _, p in claims) + 10)
    out = {}
    for i, text, host, suffix, said, p in seen:
        f = p * prior.get((host, suffix), over.get(suffix, globe))
        if said in langs:
            f = f * np.array([trust if k == said else (1 - trust) / (n - 1) for k in langs])
        letters = any(c.isalpha() for c in text or "")
        out[i] = (langs[int(f.argmax())], f.max() / f.sum()) if letters else ("und", 0.0)
    return out


def test_against_a_plain_version(spark, larger):
    """All rows of a small table of pages and of documents, with every kind of evidence."""
    docs = larger.limit(300).select("doc_id", "text", "lang")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(60).select("page_id", "html", "url").collect()
    rows = [(r.page_id, r.html, r.url.split("/")[2], r.url) for r in pages]
    rows += [(-1, "xx", None, "http://a.org/"), (-2, "", "h", None), (-3, None, None, None), (-4, "the xx", "h", None), (-5, "12 34", None, None), (-6, "mit de la " * 20000, "h", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, url string")
    found = {r.doc_id: r for r in langid.identify(table, address="url", labelled=docs).collect()}
    want = plain_identify(rows, *langid.fit(docs, "text", "lang", "doc_id"))
    assert found.keys() == want.keys()
    for i, (lang, confidence) in want.items():
        assert found[i].lang_id == lang and found[i].confidence == pytest.approx(confidence, abs=2e-6)
        assert found[i].keep == (lang != "und" and round(confidence, 6) >= langid.LIMIT)


def test_each_evidence_of_the_pages_changes_results(spark, sf):
    """Without the markup, without the suffix, or without the host, pages of few letters get other confidences."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.concat(F.regexp_extract("html", "(<html[^>]*>)", 1), F.regexp_extract("html", "<title>(.{4})", 1)).alias("text"), "url").withColumn("source", F.regexp_extract("url", "://([^/?#:]+)", 1))
    labelled = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")

    def confidences(df, **how):
        return {r.doc_id: (r.lang_id, r.confidence) for r in langid.identify(df, labelled=labelled, **how).collect()}

    whole = confidences(pages, address="url")
    others = [confidences(pages.withColumn("text", F.regexp_replace("text", r' lang="[^"]*"', "")), address="url"), confidences(pages), confidences(pages, address="url", host=None)]
    for other in others:
        assert other.keys() == whole.keys() and sum(other[i] != whole[i] for i in whole) > 0.1 * len(whole)


def test_dirty_labels_do_not_make_the_model_grow(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the cat and dog' ELSE 'der hund und die' END AS text", "CASE WHEN id >= 40 THEN concat('x', id) WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang", "CAST(NULL AS string) AS source")
    assert langid.fit(docs, "text", "lang", "doc_id")[0] == ["de", "en", "und"]
    found = langid.identify(docs)
    assert found.where("lang_id = CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END").count() == 300


def test_declared_language_in_a_long_tag(spark):
    rows = [(f"<!doctype html><HTML class='{'c' * 3000}' LANG = DE-at>x",), ("<html data-lang='fr'>",), ("<htmlx lang='fr'>",), ("<html>lang='fr'",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(langid.declared_in(F.col("t"))).collect()] == ["de", None, None, None, None]


def test_suffix_and_markup(spark):
    rows = spark.createDataFrame([("http://a.b.FR/x.html",), ("a.de:80",), ("nohost",), (None,), ("ftp://x.es?q=a.fr",)], "u string")
    assert [r[0] for r in rows.select(langid.suffix_of(F.col("u"))).collect()] == ["fr", "de", None, None, "es"]


def test_language_edges(awkward, none):
    rows = langid.identify(awkward).collect()
    assert len(rows) == awkward.count() and not any(r.keep for r in rows)
    assert langid.identify(none).count() == 0
    labelled = awkward.withColumn("lang", F.lit("en"))
    rows = langid.identify(labelled).collect()
    assert len(rows) == awkward.count() and not any(r.keep for r in rows if not (r.text or "").strip())


def test_quality_on_held_out_labels(spark, larger):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, rest = labels.where("xxhash64(doc_id) % 4 <> 0"), labels.where("xxhash64(doc_id) % 4 = 0").select("doc_id", "quality")
    rows = quality.classify(larger, fit).join(rest, "doc_id").select("quality", "quality_score", "keep").collect()
    y, p = np.array([r.quality for r in rows]), np.array([r.quality_score for r in rows])
    good, bad = p[y == 1], p[y == 0]
    auc = np.mean(good[:, None] > bad[None, :]) + 0.5 * np.mean(good[:, None] == bad[None, :])
    kept = np.mean([r.keep for r in rows if r.quality == 1])
    dropped = np.mean([not r.keep for r in rows if r.quality == 0])
    assert auc > 0.85 and kept > 0.97 and dropped > 0.3, (auc, kept, dropped)


def test_views_teach_each_other():
    """Two views, each enough alone; few labels, many free rows: the views hand over and stay right."""
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 2040).astype(float)
    text, meta = (np.column_stack([y[:, None] * 3 + r.normal(0, 1, (2040, 1)), r.normal(0, 1, (2040, w - 1))]) for w in (quality.TEXT, quality.SLOTS + 3))
    model = quality.Model(text[:40], meta[:40], y[:40], text[40:], meta[40:])
    assert min(model.handed) > 50
    assert np.mean((model.score(text[40:], meta[40:]) > 0.5) == y[40:]) > 0.9


def test_quality_edges(spark, awkward, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(r.keep is True and r.quality_score is None for r in rows)
    assert quality.classify(none, labels).count() == 0
    many = spark.range(40).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN repeat('good clear prose here. ', 20) ELSE '### $$$ 111' END AS text", "CAST(NULL AS string) AS source", "CAST(NULL AS string) AS lang", "CAST(NULL AS bigint) AS n_chars")
    marked = many.selectExpr("doc_id", "CAST(1 - doc_id % 2 AS int) AS quality")
    model = quality.train(many, marked)
    rows = quality.classify(awkward, marked, model=model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.quality_score <= 1 for r in rows)


def test_queries_cover_all_documents(spark, sf, documents):
    n = documents.count()
    assert queries.op8_language(spark, sf).count() == queries.op9_quality(spark, sf).count() == n
