import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

#: doc_id, text: nulls, empty and very long texts, ties, repeated rows, odd white space, marks, other scripts.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \t\n "),
    (4, "one"),
    (5, "Hello <|endoftext|> world<|endoftext|>"),
    (6, "a" * 5000),
    (7, "naïve café – “quoted” 漢字かな 🙂🙂   x\x1c\x1f y"),
    (8, "it's we'll I'D 12345 x1y2\r\n\r\n  end  "),
    (9, "mail bob.smith+x@mail.example.com or +44 (20) 7946 0958, card 4111 1111 1111 1111 at 10.0.0.255"),
    (10, "the quick brown fox jumps over the lazy dog " * 300),
    (10, "the quick brown fox jumps over the lazy dog " * 300),
    (11, "The quick brown fox jumps over the lazy dog " * 300),
    (None, "no id here, one two three four five"),
    (12, "\x00\x01 zero bytes \x7f"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above with columns whose names clash with outputs and inner names."""
    rows = [Row(doc_id=i, text=t) for i, t in AWKWARD]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = ["N_TOKENS", "n_bytes", "media", "fp", "shard", "slot", "base", "spans", "ids", "decoded", "keep", "lang_id", "component_id", "k0", "i0"]
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")} | {c: F.lit("own") for c in clash}).repartition(3)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
