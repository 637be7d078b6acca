"""Session construction and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def local_session(cpus: int | str = 8, name: str = "tagloom", memory: str = "12g") -> SparkSession:
    """A single-node session as the tests and ``bench.py`` use it."""
    partitions = cpus if str(cpus).isdigit() else 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a temporary folder of this
    process takes its place in local mode, where executors are threads of it; elsewhere this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tagloom-")
    return f"file://{_own[app]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tagloom-{spark.sparkContext.applicationId}"


def drop_cut(df: DataFrame) -> None:
    """Remove the table behind ``df``, a result of ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getParent().getName() == f"tagloom-{spark.sparkContext.applicationId}":
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear_cuts(spark: SparkSession) -> None:
    """Remove all tables that ``cut`` wrote for this application; no result may be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out row by row, for work that is heavy for its bytes.

    A scan has at most as many tasks as its file has row groups, often one for a million rows.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own readers so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["clear_cuts", "cut", "drop_cut", "local_session", "shared_dir", "spread", "table"]
