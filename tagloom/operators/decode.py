"""Decoding reads to compounds: one narrow Arrow stage over a compiled plan.

The result has one row a read: its ``status`` (``OK`` or the name of the failure) and the decoded
fields.  Successes, failures and statistics are filters and aggregates of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.dna import levenshtein
from tagloom.operators.calling import AMBIGUOUS, APPROACHES, Memo, make_caller
from tagloom.operators.demux import Demultiplexer, Placed
from tagloom.operators.library import Library, Tool, check_collection

TOOL = "ToolCompound"
FAILURES = (
    "ReadTooShort", "ReadTooLong", "FailedStaticAlignment", "FailedLibraryBarcodeLookup", "FailedFullBarcodeAlignment", "AlignmentFailed",
    "FailedBuildingBlockCall", "AmbiguousBuildingBlockBarcode", "ImpossibleBuildingBlockBarcode", "UMIContainsAmbiguity", "UMIContainsINDEL",
)
OUT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("library_id", T.StringType()),
        T.StructField("library_score", T.DoubleType()),
        T.StructField("bb_ids", T.ArrayType(T.StringType())),
        T.StructField("bb_scores", T.ArrayType(T.DoubleType())),
        T.StructField("umi", T.StringType()),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("flipped", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    """All decode settings with their defaults; ``default_correction`` applies to sections without
    a mode of their own only if ``apply_default`` is set."""

    demultiplexer_mode: str = "single"
    demultiplexer_algorithm: str = "regex"
    library_error_tolerance: int = 1
    library_error_correction_mode_str: str | None = "levenshtein_dist:2,asymmetrical"
    realign: bool = False
    revcomp: bool = False
    wiggle: bool = False
    library_wiggle: bool = False
    decode_matching_approach: str = "first_perfect"
    default_correction: str = "levenshtein_dist:1,asymmetrical"
    apply_default: bool = False
    max_read_length: int | None = None
    min_read_length: int | None = None
    ignore_tool_compounds: bool = False
    tool_distance: int = 2

    @classmethod
    def of(cls, data: dict | None) -> Settings:
        """From a mapping: the key ``decode_settings`` first, else the mapping itself."""
        data = (data or {}).get("decode_settings", data) or {}
        known = {f.name for f in fields(cls)}
        unknown = set(data) - known
        if unknown:
            raise ValueError(f"unknown decode settings: {sorted(unknown)}")
        return cls(**data)

    def as_dict(self) -> dict:
        return asdict(self)


class Decoder:
    """The compiled plan; sent to executors with the stage's closure."""

    def __init__(self, libraries: list[Library], tools: list[Tool] | None = None, settings: Settings | None = None):
        self.settings = s = settings or Settings()
        members = [*libraries, *([] if s.ignore_tool_compounds else tools or [])]
        check_collection(members)
        self.demux = Demultiplexer(members, s.demultiplexer_mode, s.demultiplexer_algorithm, s.library_error_tolerance, s.library_error_correction_mode_str, s.revcomp, s.realign, s.wiggle, s.library_wiggle)
        least = min(m.schema.min_length for m in members)
        self.min_length = s.min_read_length if s.min_read_length is not None else least - 10
        self.max_length = s.max_read_length if s.max_read_length is not None else 5 * least
        self.approach = APPROACHES[s.decode_matching_approach]
        self.adjust = s.demultiplexer_mode == "single" and not s.realign
        fallback = s.default_correction if s.apply_default else None
        self.callers = {lib.library_id: [make_caller(b.tags, sec.mode or fallback) for sec, b in zip(lib.schema.blocks, lib.sets)] for lib in libraries}
        self.steps = {lib.library_id: [(sec.name, len(sec.tag), caller, Memo()) for sec, caller in zip(lib.schema.blocks, self.callers[lib.library_id])] for lib in libraries}

    def __call__(self, read: str | None) -> tuple:
        """A row of OUT."""
        return self.many([read])[0]

    def many(self, reads: list[str | None]) -> list[tuple]:
        """A row of OUT for each read."""
        rows: list = [self.wrong_length(read := (r or "").upper()) or read for r in reads]
        at = [i for i, r in enumerate(rows) if isinstance(r, str)]
        for i, placed in zip(at, self.demux.many([rows[i] for i in at])):
            rows[i] = self.row(placed)
        return rows

    def wrong_length(self, read: str) -> tuple | None:
        if len(read) > self.max_length:
            return self.failed("ReadTooLong", f"{len(read)} bases")
        if len(read) < self.min_length:
            return self.failed("ReadTooShort", f"{len(read)} bases")
        return None

    def row(self, placed: Placed | str) -> tuple:
        if isinstance(placed, str):
            return self.failed(placed, "")
        worst = None
        for spans in placed.candidates:
            row = self.tool(placed, spans) if isinstance(placed.library, Tool) else self.compound(placed, spans)
            if row[0] == "OK":
                return row
            worst = worst or row
        return worst

    def failed(self, status: str, reason: str, library: str | None = None, flipped: bool = False) -> tuple:
        return (status, reason, library, None, None, None, None, None, flipped)

    def compound(self, placed, spans) -> tuple:
        lib, read, at, moved, called, where = placed.library, placed.read, 0, 0, [], {}
        fail = lambda status, reason: self.failed(status, reason, lib.library_id, placed.flipped)
        for name, size, caller, known in self.steps[lib.library_id]:
            start, stop = spans[name]
            if self.adjust:
                start, stop = start + moved, stop + moved
            start = max(start, at)
            stop = max(start + size, stop)
            codon = read[start:stop]
            hit = known[codon] if codon in known else known.keep(codon, self.approach(codon, caller, size))
            if hit is AMBIGUOUS:
                return fail("AmbiguousBuildingBlockBarcode", f"{name}: {codon}")
            if hit is None and caller.fixed is None:
                return fail("FailedBuildingBlockCall", f"{name}: {codon}")
            if hit is None:
                return fail("AlignmentFailed", f"{name} lies beyond the read")
            call, a, b = hit
            called.append(call)
            where[name] = (start + a, start + b)
            at = start + b
            moved += (b - a) - (stop - start)
        umi = self.umi(lib.schema, read, where)
        if umi is None:
            return fail("UMIContainsINDEL", "")
        if "N" in umi:
            return fail("UMIContainsAmbiguity", umi)
        blocks, scores = [c.item for c in called], [c.score for c in called]
        score = sum(scores)
        if not any([b.tool is not None for b in blocks]):
            ids, library = [b.bb_id for b in blocks], lib.library_id
        else:
            stands = {b.tool for b in blocks}
            if any(b.is_real for b in blocks) or len(stands) > 1:
                return fail("ImpossibleBuildingBlockBarcode", ",".join(b.bb_id for b in blocks))
            ids, scores, library = [stands.pop()], [score], TOOL
        return ("OK", None, library, placed.score, ids, scores, umi, placed.score + score, placed.flipped)

    def umi(self, schema, read: str, where: dict[str, tuple[int, int]]) -> str | None:
        """By distance to the nearest called sections; between two of them its length has to fit."""
        u0, u1, u2 = schema.spans["umi"]
        before = [n for n in where if schema.spans[n][0] < u0]
        after = [n for n in where if schema.spans[n][0] > u0]
        start = stop = None
        if before:
            name = before[-1]
            start = where[name][1] + u0 - schema.spans[name][1]
            stop = start + u1 - u0
        if after:
            name = after[0]
            end = where[name][0] - (schema.spans[name][0] - u1)
            if start is not None and end - start != u1 - u0:
                return None
            start, stop = end - (u1 - u0), end
        umi = read[max(0, start) : max(0, stop)]
        return umi if len(umi) == u1 - u0 else None

    def tool(self, placed, spans) -> tuple:
        lib, schema = placed.library, placed.library.schema
        ref = next(s for s in schema.sections if s.kind == "tool")
        a, b = spans[ref.name]
        edits = levenshtein(placed.read[a:b], ref.tag)
        if edits > self.settings.tool_distance:
            return self.failed("AlignmentFailed", f"{edits} edits", lib.library_id, placed.flipped)
        a, b = spans["umi"]
        umi = placed.read[a:b]
        if "N" in umi:
            return self.failed("UMIContainsAmbiguity", umi, lib.library_id, placed.flipped)
        return ("OK", None, TOOL, placed.score, [lib.compound_id], [float(edits)], umi, placed.score + edits, placed.flipped)


def decode(reads: DataFrame, decoder: Decoder, sequence: str = "sequence") -> DataFrame:
    """``reads`` (all columns) with the decoded fields; null reads are too short.  No shuffle."""
    keep = [f for f in reads.schema.fields if f.name not in OUT.fieldNames()]
    schema = T.StructType([*keep, *OUT.fields])
    at = [f.name for f in keep].index(sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = decoder.many(batch.column(at).to_pylist())
            made = [pa.array([r[i] for r in rows], target.field(len(keep) + i).type) for i in range(len(OUT))]
            yield pa.RecordBatch.from_arrays([*[c.cast(target.field(i).type) for i, c in enumerate(batch.columns)], *made], schema=target)

    return reads.select(*[f.name for f in keep]).mapInArrow(run, schema)


def successes(decoded: DataFrame) -> DataFrame:
    return decoded.where("status = 'OK'")


def failures(decoded: DataFrame) -> DataFrame:
    return decoded.where("status <> 'OK'")


def as_lines(decoded: DataFrame) -> DataFrame:
    """Successes as the decoded table has them: ids and scores comma-joined."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    extra = [c for c in ("fastq_file", "read_name") if c in decoded.columns]
    return successes(decoded).select("library_id", "library_score", joined("bb_ids").alias("bb_ids"), joined("bb_scores").alias("bb_scores"), "umi", "overall_score", *extra)


def as_cube_rows(decoded: DataFrame, blocks: DataFrame, cycles: int) -> DataFrame:
    """Successes with building-block ids and SMILES spread over columns.

    ``blocks``: library_id, cycle, bb_id, smiles.  A missing SMILES reads "null".
    """
    df = successes(decoded)
    for i in range(1, cycles + 1):
        b = blocks.where(F.col("cycle") == i).select(F.col("library_id"), F.col("bb_id").alias(f"bb{i}"), F.coalesce("smiles", F.lit("null")).alias(f"bb{i}_smiles"))
        df = df.withColumn(f"bb{i}", F.get("bb_ids", i - 1)).join(b, ["library_id", f"bb{i}"], "left")
    return df.select("library_id", *[c for i in range(1, cycles + 1) for c in (f"bb{i}", f"bb{i}_smiles")], "umi")


def length_status(length: Column, shortest: int, longest: int) -> Column:
    return F.when(length > longest, "ReadTooLong").when(length < shortest, "ReadTooShort").otherwise("OK")


def statistics(decoded: DataFrame) -> DataFrame:
    """(name, library_id, value): reads, reads decoded of each library, and failures by kind.

    Reads are decoded once: a group of status and library gives its count to both of its rows.
    """
    by = decoded.groupBy("status", "library_id").agg(F.count("*").alias("value"))
    none, ok = F.lit(None).cast("string"), F.col("status") == "OK"
    kind = F.when(ok, F.lit("num_seqs_decoded")).otherwise(F.concat(F.lit("num_failed_"), "status"))
    of = lambda name, library: F.struct(name.alias("name"), library.alias("library_id"))
    both = by.select(F.explode(F.array(of(F.lit("num_seqs_read"), none), of(kind, F.when(ok, F.col("library_id"))))).alias("x"), "value").select("x.*", "value")
    nothing = decoded.sparkSession.range(1).select(F.lit("num_seqs_read").alias("name"), none.alias("library_id"), F.lit(0).cast("long").alias("value"))
    return both.union(nothing).groupBy("name", "library_id").agg(F.sum("value").alias("value"))
