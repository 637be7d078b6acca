"""The thin queries of the ten operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.token_counts import count_tokens, with_limit

    return with_limit(count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.packing import pack, with_lengths

    return pack(with_lengths(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.media import feature_digest, read_back, store

    seen = read_back(store(table(spark, sf_dir, "documents").select("doc_id", "text")))
    columns = [c for c in seen.columns if c != "fingerprint"]
    return seen.select(*columns, feature_digest().alias("feature"), "fingerprint")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.pii import find, listed

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.simhash import SHINGLE, THRESHOLD, hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), bits=THRESHOLD, k=SHINGLE)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.kdtree import quantised, top_k

    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.tree_bpe import decode, encode, ids_digest

    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = encoded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("ids_sha256", ids_digest())
    return decode(kept).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.langid import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs, address="source", keep_text=False).select("doc_id", "lang_id", "confidence", "keep")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw web pages, which have all four evidences; fitted on the labels of the documents."""
    from tagloom.llm.langid import identify

    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), "url").withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1)))
    labelled = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", "lang")
    found = identify(pages, key="page_id", host="host", address="url", keep_text=False, labelled=labelled)
    return found.select("page_id", "lang_id", "confidence", "keep")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.quality import classify

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "keep")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.sharding import shuffle_into_shards, sized

    placed = shuffle_into_shards(sized(table(spark, sf_dir, "documents")), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_media": op3_media,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "language_of_pages": language_of_pages,
}

SQL: dict[str, str] = {"op6_topk": OP6_SQL}
