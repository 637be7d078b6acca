"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that clash with ``names``, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{f.name}`"] for f in df.schema.fields if f.name.lower() not in low])


def map_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    fn: Callable[[list[pa.Array]], list[list]],
    drop: tuple[str, ...] = (),
    rows: int = 512,
) -> DataFrame:
    """Arrow-batched narrow map: ``fn`` gets the input columns and returns one list per output field.

    Other columns pass through; those named like an output, or listed in ``drop``, go.  Batches are
    cut to ``rows`` rows, which bounds what a worker holds beyond one text.
    """
    gone = {n.lower() for n in (*outputs.fieldNames(), *drop)}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    sent = df.select(*[df[f"`{f.name}`"].alias(f"k{i}") for i, f in enumerate(keep)], *[df[f"`{n}`"].alias(f"i{i}") for i, n in enumerate(inputs)])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in keep], *outputs.fields])
    arrow, n_keep = to_arrow_schema(T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn(part.columns[n_keep:])
                cols = [c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(part.columns[:n_keep])]
                cols += [x.cast(arrow.field(n_keep + i).type) if isinstance(x, pa.Array) else pa.array(x, arrow.field(n_keep + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    renamed = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    out = sent.mapInArrow(run, renamed)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(schema.fields)])


def as_bytes(df: DataFrame, text: str) -> F.Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(df[f"`{text}`"].cast("string").cast("binary"), F.lit(b""))


def gapless(rows: DataFrame, group: str, key: Callable[[int], F.Column], order: list[str], n_bins: int, out: str) -> DataFrame:
    """``rows`` with ``out``: 0, 1, ... within each ``group``, in random order.

    ``key(k)``: independent random longs of a row.  A group's rows fall into ``n_bins`` bins by one;
    a rank is the size of the bins before plus the rank in the bin, so that no task orders a whole
    group.  The keys should tell rows apart, or one bin gets all that are alike.  ``rows`` is read twice:
    it should be a written table, or a narrow map of one.
    """
    binned = rows.withColumns({"__bin": F.pmod(key(1), F.lit(n_bins)).cast("int"), "__at": key(2)})
    before = Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(group, "__bin").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = Window.partitionBy(group, "__bin").orderBy("__at", *order)
    placed = binned.withColumn("__i", F.row_number().over(inside)).join(starts, [group, "__bin"])
    return placed.withColumn(out, F.col("__start") + F.col("__i") - 1).drop("__bin", "__at", "__n", "__start", "__i")
