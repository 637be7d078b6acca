"""FASTQ and FASTA as a Spark data source, and the paths that stand for sequence files.

    spark.dataSource.register(SequenceSource)
    spark.read.format("sequences").option("paths", json.dumps([...])).load()

Records of four lines; plain FASTQ files are split into byte ranges that start at a record whose
second line after the header opens with "+" and whose sequence and qualities are equally long, since
quality lines may themselves open with "@".  Compressed files are one partition each.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import json
import lzma
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "fastq_file string, read_name string, sequence string, qualities string"
NAME = re.compile(r"\.(fastq|fq|fasta|fa|fna|ffn|frn)(\.(gz|xz|bz2|zst))?$", re.IGNORECASE)
SPLIT = 64 << 20


def is_sequence_file(name: str) -> bool:
    return NAME.search(os.path.basename(name)) is not None


def resolve(inputs: list[str] | str) -> list[str]:
    """Files, folders (not their subfolders) and globs to files, in order; files named outright need
    no known ending, empty folders and globs are errors."""
    out: list[str] = []
    for item in [inputs] if isinstance(inputs, str) else inputs:
        if os.path.isdir(item):
            found = sorted(os.path.join(item, n) for n in os.listdir(item) if is_sequence_file(n) and os.path.isfile(os.path.join(item, n)))
        elif os.path.isfile(item):
            found = [item]
        else:
            found = sorted(f for f in glob.glob(item) if os.path.isfile(f) and is_sequence_file(f))
        if not found:
            raise FileNotFoundError(f"no sequence files in {item}")
        out += found
    return out


def opened(path: str):
    low = path.lower()
    if low.endswith(".gz"):
        return gzip.open(path, "rb")
    if low.endswith(".xz"):
        return lzma.open(path, "rb")
    if low.endswith(".bz2"):
        return bz2.open(path, "rb")
    if low.endswith(".zst"):
        import zstandard

        return zstandard.open(path, "rb")
    return open(path, "rb")


def fasta_records(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str | None]]:
    name, parts = None, []
    for line in lines:
        line = line.rstrip(b"\r\n")
        if line.startswith(b">"):
            if name is not None:
                yield name, "".join(parts), None
            name, parts = line[1:].decode(), []
        elif name is not None:
            parts.append(line.strip().decode())
    if name is not None:
        yield name, "".join(parts), None


def fastq_records(f, stop: int | None = None) -> Iterator[tuple[str, str, str | None]]:
    """Records that start before byte ``stop``."""
    while stop is None or f.tell() < stop:
        head = f.readline()
        if not head:
            return
        if not head.strip():
            continue
        seq, plus, qual = f.readline().rstrip(b"\r\n"), f.readline(), f.readline().rstrip(b"\r\n")
        if not head.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(qual):
            raise ValueError(f"no FASTQ record at {head[:60]!r}")
        yield head[1:].rstrip(b"\r\n").decode(), seq.decode(), qual.decode()


def seek_record(f, start: int) -> None:
    """To the first record at or after ``start``."""
    if start == 0:
        return
    f.seek(start - 1)
    f.readline()
    window = []
    while True:
        at = f.tell()
        line = f.readline()
        if not line:
            f.seek(at)
            return
        window.append((at, line.rstrip(b"\r\n")))
        if len(window) > 4:
            window.pop(0)
        if len(window) == 4 and window[0][1].startswith(b"@") and window[2][1].startswith(b"+") and len(window[1][1]) == len(window[3][1]):
            f.seek(window[0][0])
            return


class Part(InputPartition):
    def __init__(self, path: str, start: int = 0, stop: int | None = None):
        self.path, self.start, self.stop = path, start, stop


class SequenceReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self):
        out = []
        for p in self.paths:
            plain = re.search(r"\.(gz|xz|bz2|zst)$", p.lower()) is None
            size = os.path.getsize(p)
            if plain and re.search(r"\.(fastq|fq)$", p.lower()) and size > self.split:
                out += [Part(p, a, min(size, a + self.split)) for a in range(0, size, self.split)]
            else:
                out.append(Part(p))
        return out

    def read(self, partition):
        with opened(partition.path) as f:
            if partition.stop is not None:
                seek_record(f, partition.start)
                records = fastq_records(f, partition.stop)
            else:
                first = f.read(1)
                f.seek(0)
                records = fasta_records(iter(f)) if first == b">" else fastq_records(f)
            for name, seq, qual in records:
                yield partition.path, name, seq, qual


class SequenceSource(DataSource):
    """Options: ``paths`` (a JSON list) or a path; ``split`` in bytes."""

    @classmethod
    def name(cls):
        return "sequences"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        paths = json.loads(self.options["paths"]) if "paths" in self.options else resolve(self.options["path"])
        return SequenceReader(paths, int(self.options.get("split", SPLIT)))


def read_sequences(spark: SparkSession, inputs: list[str] | str, quality_threshold: float = 0.0, split: int = SPLIT) -> DataFrame:
    """All records of the inputs with their file; reads of a lower mean quality go if a threshold is set."""
    from tagloom.functions.dna import quality_ok

    spark.dataSource.register(SequenceSource)
    df = spark.read.format("sequences").option("paths", json.dumps(resolve(inputs))).option("split", str(split)).load()
    return df if quality_threshold <= 0 else df.where(quality_ok(df["qualities"], quality_threshold))
