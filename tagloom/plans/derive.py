"""Reads, tags and cubes derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.dna import md5_dna
from tagloom.operators.cube import Cube
from tagloom.session import table


def sql_dna(value: str, length: int) -> str:
    return f"substr(translate(md5(CAST({value} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {length})"


def decoded(spark: SparkSession, sf_dir: str, umi: int = 5) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("library_id"), F.col("l_suppkey").cast("string").alias("bb_ids"), md5_dna(F.col("l_orderkey"), umi).alias("umi"), F.col("l_linenumber").cast("double").alias("overall_score")
    )


def sql_decoded(umi: int = 5) -> str:
    return f"decoded AS (SELECT l_returnflag AS library_id, CAST(l_suppkey AS VARCHAR) AS bb_ids, {sql_dna('l_orderkey', umi)} AS umi, CAST(l_linenumber AS DOUBLE) AS overall_score FROM lineitem)"


REPLICATES = {f"{e.lower()}{i + 1}": f"l_returnflag = '{e}' AND l_orderkey % 3 = {i}" for e in "AR" for i in range(3)} | {"ctrl": "l_returnflag = 'N' AND l_orderkey % 5 = 0"}
INDEXES = {"expa": ["a1", "a2", "a3"], "expr": ["r1", "r2", "r3"]}
CONTROLS = {"expa": ["ctrl"], "expr": ["ctrl"]}
LIB_SIZE = 3500


def cube(spark: SparkSession, sf_dir: str) -> Cube:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_orderkey", "l_quantity")
    sums = [F.sum(F.when(F.expr(p), F.col("l_quantity")).otherwise(0)).cast("long").alias(n) for n, p in REPLICATES.items()]
    ident = F.concat_ws("-", F.col("l_suppkey") % 20, F.col("l_partkey") % 25, "l_linenumber")
    return Cube(li.groupBy(ident.alias("DEL_ID")).agg(*sums), INDEXES, CONTROLS, LIB_SIZE)


SQL_CUBE = (
    "cube0 AS (SELECT CAST(l_suppkey % 20 AS VARCHAR) || '-' || CAST(l_partkey % 25 AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS DEL_ID, "
    + ", ".join(f"CAST(sum(CASE WHEN {p} THEN l_quantity ELSE 0 END) AS BIGINT) AS {n}" for n, p in REPLICATES.items())
    + " FROM lineitem GROUP BY 1), cube AS (SELECT *, split_part(DEL_ID, '-', 1) AS ID_A, split_part(DEL_ID, '-', 2) AS ID_B, split_part(DEL_ID, '-', 3) AS ID_C, "
    "split_part(DEL_ID, '-', 1) || '-' || split_part(DEL_ID, '-', 2) AS AB, split_part(DEL_ID, '-', 1) || '-' || split_part(DEL_ID, '-', 3) AS AC, split_part(DEL_ID, '-', 2) || '-' || split_part(DEL_ID, '-', 3) AS BC, "
    "CAST(a1 + a2 + a3 AS DOUBLE) AS sa, CAST(r1 + r2 + r3 AS DOUBLE) AS sr FROM cube0)"
)
