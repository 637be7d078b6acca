"""The corpus pipeline: language, quality, near-duplicates, personal data, packing.

Each stage reads what the one before kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.langid import identify
from tagloom.llm.packing import pack, with_lengths
from tagloom.llm.pii import find, redact
from tagloom.llm.quality import classify
from tagloom.llm.simhash import keep_one, near_copies
from tagloom.session import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; ``lang`` as it was.

    Null and empty texts have none.  Repeated rows and null ids are decided like others; other columns go.
    """
    return identify(docs.select(*COLUMNS), address="source").where("keep").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers do not reject.

    Nulls in any column are values of their own; without labels of both kinds nothing is rejected.
    """
    return classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of 0.8 or more): that with the smallest id.

    SimHash fingerprints and covering-code anchors, as in operator 5 but wider, give the candidates.

    Null texts are empty, and all texts without words are copies of each other.  Rows without an id come
    last in their group; of different texts under one id each group keeps its own.
    """
    return keep_one(docs.select(*COLUMNS), near_copies(docs))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind in brackets; ``n_chars`` follows.

    Null texts stay null, with null ``n_chars``; repeated rows stay.
    """
    found = find(docs.select(*COLUMNS))
    clean = found.withColumn("text", redact(found))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bucket, batch and slot; null and empty texts have one piece of length 0."""
    return pack(with_lengths(docs.select("doc_id", "text")))


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("privacy", privacy), ("packing", packing)]

#: Classifiers and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
