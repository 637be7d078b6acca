"""Every query with a SQL counterpart gives the same rows on the smallest tables."""

import decimal

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_without_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in (root / "tagloom").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tagloom.llm" not in path.read_text(), path
