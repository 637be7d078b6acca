"""Table files between the steps: decoded reads, collected and counted compounds, statistics, cubes."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECODED = "library_id string, library_score double, bb_ids string, bb_scores string, umi string, overall_score double, fastq_file string, read_name string"
COLLECTED = "library_id string, bb_ids string, umi array<string>, umi_counts array<struct<k:string,c:bigint>>"
COUNTED = "library_id string, bb_ids string, count int, raw_count int, dedup_count int"


def output_path(path: str, extension: str | None = None, overwrite: bool = False) -> str:
    """The path with its ending, checked: an existing one is an error unless it may be overwritten."""
    if extension and not path.endswith(extension):
        path += extension
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    return path


def write_decoded(lines: DataFrame, path: str, split_by_library: bool = False, scores: bool = True, mode: str = "error") -> None:
    """Tab-separated decoded reads, one folder a library on demand."""
    df = lines if scores else lines.drop("library_score", "bb_scores")
    writer = df.write.mode(mode).option("header", True).option("sep", "\t")
    (writer.partitionBy("library_id") if split_by_library else writer).csv(path)


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """Header by header, since files may lack columns; cells that do not parse become null."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    kinds = dict(x.split(" ") for x in DECODED.split(", "))
    return df.select(*[F.expr(f"try_cast(`{c}` AS {kinds.get(c, 'string')})").alias(c) for c in df.columns])


def write_failed(failures: DataFrame, path: str, mode: str = "error") -> None:
    df = failures.select("fastq_file", "read_name", F.col("status").alias("issue"), "reason")
    df.write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def write_collected(collected: DataFrame, path: str, compress: bool = False, mode: str = "error") -> None:
    collected.write.mode(mode).option("compression", "gzip" if compress else "none").json(path)


def read_collected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLLECTED).json(path)


def write_counted(counted: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    if kind == "parquet":
        counted.write.mode(mode).parquet(path)
    elif kind in ("tsv", "tsv.gz"):
        counted.write.mode(mode).option("header", True).option("sep", "\t").option("compression", "gzip" if kind.endswith("gz") else "none").csv(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def read_counted(spark: SparkSession, path: str) -> DataFrame:
    """By its ending: .tsv, .tsv.gz, else Parquet; missing count columns stay missing."""
    if path.rstrip("/").endswith((".tsv", ".tsv.gz")):
        df = spark.read.option("header", True).option("sep", "\t").csv(path)
        kinds = dict(x.split(" ") for x in COUNTED.split(", "))
        return df.select(*[F.expr(f"try_cast(`{c}` AS {kinds.get(c, 'string')})").alias(c) for c in df.columns])
    return spark.read.parquet(path)


def concat_parquet(spark: SparkSession, paths: list[str], out: str, mode: str = "error") -> None:
    spark.read.parquet(*paths).write.mode(mode).parquet(out)


def write_stats(stats: DataFrame, path: str) -> dict:
    """Long-form statistics as one JSON object; a library's counts form a map under their name."""
    out: dict = {}
    for name, library, value in sorted((r["name"], r["library_id"] or "", r["value"]) for r in stats.collect()):
        if name == "num_seqs_decoded":
            out.setdefault("num_seqs_decoded_per_lib", {})[library] = value
        else:
            out[name] = value
    with open(path, "w") as f:
        json.dump(out, f, indent=2)
    return out


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Back to long form; missing keys are absent and count as 0 when merged."""
    with open(path) as f:
        data = json.load(f)
    rows = [(k, None, int(v)) for k, v in data.items() if not isinstance(v, dict)]
    rows += [("num_seqs_decoded", lib, int(v)) for lib, v in data.get("num_seqs_decoded_per_lib", {}).items()]
    return spark.createDataFrame(rows, "name string, library_id string, value bigint")


def write_summary(summary: DataFrame, path: str) -> dict:
    out = {r["library_id"]: {"num_compounds": r["n_compounds"], "num_molecules": r["n_molecules"]} for r in summary.collect()}
    with open(path, "w") as f:
        json.dump(out, f, indent=2)
    return out


def read_cube(spark: SparkSession, path: str, id_col: str | None = None) -> tuple[DataFrame, str]:
    """A cube CSV and its id column, by default the first."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df, id_col or df.columns[0]


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)
