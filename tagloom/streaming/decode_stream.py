"""Decoding as files land: a stateless stream of reads, appended in the decoded format.

Counts are made afterwards, in batch: UMI counts of a part of the reads cannot be added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.decode import Decoder, as_lines, decode

READS = "fastq_file string, read_name string, sequence string, qualities string"


def decode_stream(spark: SparkSession, landing: str, out: str, decoder: Decoder, checkpoint: str, once: bool = False, files_per_batch: int = 100) -> StreamingQuery:
    """Reads (Parquet files in ``landing``) to decoded rows (Parquet in ``out``), exactly once.

    ``once``: take what is there and stop.
    """
    reads = spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    writer = as_lines(decode(reads, decoder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def decoded_so_far(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)
