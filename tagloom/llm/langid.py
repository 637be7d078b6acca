"""Language identification by Bayesian evidence fusion.

The posterior of a document's language is the product of its text likelihood (hashed byte trigrams),
the reliability of the language its markup declares, and the prior of its host.  Host priors are
smoothed towards those of the address suffix, these towards the global one; all come from grouped sums
of the text posteriors.  A background language, "und", takes texts that are like none of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import as_bytes, map_columns, without
from tagloom.session import cut

#: Trigram buckets; labelled documents a language is fitted on, about; labels that are taken for languages
#: at most, the most frequent first; trigrams that count in full; pseudo-documents of the smoothing; bytes of
#: a text hashed at once.
BUCKETS, SAMPLE, LANGUAGES, FULL, WEIGHT, BYTES = 1 << 16, 4000, 64, 200, 20.0, 1 << 20
UND, LIMIT = "und", 0.5


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the lower-cased text, block by block."""
    for at in range(0, len(text), BYTES):
        raw = np.frombuffer(text[at : at + BYTES + 2].lower(), np.uint8).astype(np.uint32)
        if len(raw) > 2:
            yield (raw[:-2] * np.uint32(7919) + raw[1:-1] * np.uint32(263) + raw[2:] * np.uint32(40503)) & np.uint32(BUCKETS - 1)


def fit(docs: DataFrame, text: str, label: str, key: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages (``und`` last) and log P(bucket | language), float32 of BUCKETS x languages.

    Fitted on whole texts of about ``sample`` labelled documents a language, chosen by hash of the
    key; what comes to the driver is a count per language and bucket.  Labels beyond the LANGUAGES most
    frequent ones (and "und") count as unknown, so that dirty labels cannot make the model grow.
    """
    docs = docs.where(F.col(label).isNotNull() & (F.col(label) != UND))
    seen = {r[0]: r[1] for r in docs.groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(LANGUAGES).collect()}
    langs = sorted(seen)
    if not langs:
        return [UND], np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / seen[k])))])
    drawn = F.pmod(F.xxhash64(F.lit(8), F.col(key)), F.lit(1_000_000)) < share[F.col(label)] * 1_000_000

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in trigrams(raw):
                    mine += np.bincount(part, minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    known = docs.where(F.col(label).isin(langs)).where(drawn).withColumn("__spoken", spoken(F.col(text)))
    known = known.select(F.col(label), as_bytes(known, "__spoken"))
    counts = np.full((BUCKETS, len(langs) + 1), 0.5)
    for r in known.mapInArrow(tally, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r[1], langs.index(r[0])] += r[2]
    counts[:, -1] = 1
    return [*langs, UND], np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_posterior(docs: DataFrame, text: str, n_langs: int, table: np.ndarray) -> DataFrame:
    """``docs`` with ``__p``, the languages' probabilities by the text alone.

    The log-likelihood of a text with more than FULL trigrams is scaled to FULL, since trigrams are
    not independent.  Texts of under three bytes say nothing.
    """

    def one(raw: bytes) -> list[float]:
        total, n = np.zeros(n_langs), 0
        for part in trigrams(raw):
            total += table[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        total *= min(1.0, FULL / max(n, 1))
        p = np.exp(total - total.max())
        return (p / p.sum()).tolist()

    sent = docs.withColumn("__spoken", spoken(F.col(text)))
    sent = sent.withColumn("__bytes", as_bytes(sent, "__spoken")).drop("__spoken")
    schema = T.StructType([T.StructField("__p", T.ArrayType(T.DoubleType()))])
    return map_columns(sent, ["__bytes"], schema, lambda c: [[one(t) for t in c[0].to_pylist()]], drop=("__bytes",))


def declared_in(text: Column) -> Column:
    """The language that the markup's first html tag declares, without region; null if none."""
    tag = F.regexp_extract(text, r"(?i)<html(\s[^>]*+)", 1)
    found = F.lower(F.regexp_extract(tag, r"(?i)\slang\s*+=\s*+[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def spoken(text: Column) -> Column:
    """The text without its tags where it declares a language: tags are in none."""
    return F.when(declared_in(text).isNotNull(), F.regexp_replace(text, "<[^<>]*+>", " ")).otherwise(text)


def suffix_of(address: Column) -> Column:
    """The last label of the address's host; null if there is no host."""
    found = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#:]*?\.([A-Za-z]{2,})(?:[:/?#]|$)", 1))
    return F.when(found != "", found)


def sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    parts = [F.sum(F.get("__p", i)).alias(f"s{i}") for i in range(n)]
    grouped = rows.groupBy(*by).agg(*parts) if by else rows.agg(*parts)
    return grouped.select(*by, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)]).alias("s"))


def smoothed(own: Column, towards: Column, weight: float = WEIGHT) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(own, towards, lambda o, t: (o + weight * t) / total)


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", host: str = "source", address: str | None = None,
    sample: int = SAMPLE, limit: float = LIMIT, keep_text: bool = True, labelled: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``lang_id``, ``confidence`` and ``keep``.

    ``label``: the labels to fit on, null where unknown; of ``labelled`` (key, text, label), if given,
    else of ``docs``.  ``host`` and ``address`` may be null, or None if there is no such column; the
    markup is looked for in the text.  ``keep``: the best language is not "und" and its posterior
    reaches ``limit``.  Empty and null texts have neither likelihood nor letters: "und", 0.0, false.
    Rows are decided one by one: repeated rows, null ids and ties (the first language by name) need no
    care; an empty table gives an empty one.  Columns named like the outputs are replaced.

    Every text is scored once, and written with its row (without it, unless ``keep_text``), as its
    posterior is read again when the priors are known.  Texts are never shuffled unless the table of
    hosts is too large to broadcast.
    """
    langs, table = fit(docs if labelled is None else labelled, text, label, key, sample)
    n = len(langs)
    base = without(docs, ["lang_id", "confidence", "keep"])
    evidence = {
        "__host": F.col(host).cast("string") if host else F.lit(None).cast("string"),
        "__suffix": suffix_of(F.col(address)) if address else F.lit(None).cast("string"),
        "__said": declared_in(F.col(text)),
        "__letters": F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False)),
    }
    scored = text_posterior(base.withColumns(evidence), text, n, table)
    own = [c for c in base.columns if keep_text or c != text]
    scored = cut(scored.select(*[f"`{c}`" for c in own], *evidence, "__p"))

    flat = [1 / n] * n
    first = sums(scored, [], n).first()[0]
    whole = [(s + f * WEIGHT) / (sum(first) + WEIGHT) for s, f in zip(first, flat)]
    globe = F.array(*[F.lit(float(x)) for x in whole])
    suffixes = cut(sums(scored.where("__suffix IS NOT NULL"), ["__suffix"], n).select("__suffix", smoothed(F.col("s"), globe).alias("__by_suffix")))
    hosts = cut(sums(scored.where("__host IS NOT NULL"), ["__host", "__suffix"], n))
    hosts = hosts.join(suffixes, "__suffix", "left").withColumn("__by_suffix", F.coalesce("__by_suffix", globe))
    hosts = cut(hosts.select(F.col("__host").alias("__h"), F.col("__suffix").alias("__s"), smoothed(F.col("s"), F.col("__by_suffix")).alias("__prior")))
    said = {r[0]: r[1] for r in sums(scored.where(F.col("__said").isin(*langs)), ["__said"], n).collect()}
    right = sum(said[k][i] for i, k in enumerate(langs) if k in said) + 9.0
    trust = right / (sum(sum(v) for v in said.values()) + 10.0)
    rest = (1 - trust) / max(1, n - 1)
    claimed = F.col("__said").isin(*langs)
    claim = F.array(*[F.when(claimed & (F.col("__said") == k), trust).when(claimed, rest).otherwise(1.0) for k in langs])
    joined = scored.join(hosts, (scored["__host"] == hosts["__h"]) & scored["__suffix"].eqNullSafe(hosts["__s"]), "left")
    prior = F.coalesce("__prior", globe)
    if address:
        joined = joined.join(suffixes, "__suffix", "left")
        prior = F.coalesce("__prior", "__by_suffix", globe)
    fused = F.zip_with(F.zip_with(F.col("__p"), prior, lambda a, b: a * b), claim, lambda a, b: a * b)
    out = joined.withColumn("__f", fused).withColumn("__best", F.array_max("__f"))
    names = F.array(*[F.lit(k) for k in langs])
    lang = F.element_at(names, F.array_position("__f", F.col("__best")).cast("int"))
    mass = F.aggregate("__f", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("lang_id", F.when(F.col("__letters"), lang).otherwise(UND)).withColumn("confidence", F.when(F.col("__letters"), F.round(F.col("__best") / mass, 6)).otherwise(0.0))
    out = out.withColumn("keep", (F.col("lang_id") != UND) & (F.col("confidence") >= limit))
    return out.select(*[f"`{c}`" for c in own], "lang_id", "confidence", "keep")
