"""The command line: the steps from reads to reports, each a Spark job between files.

    python -m tagloom decode SELECTION --data-dir DIR --out DIR [--reads FILE ...] [--split-by-library] [--no-scores] [--save-failed] [--quality X]
    python -m tagloom collect DECODED ... --out FILE [--score-threshold X] [--compress]
    python -m tagloom count COLLECTED ... --out FILE [--method directional|cluster|none] [--raw] [--dedup] [--format parquet|tsv|tsv.gz]
    python -m tagloom merge collected|counted|stats FILE ... --out FILE
    python -m tagloom summarise COUNTED --out FILE [--selection FILE --data-dir DIR]
    python -m tagloom report STATS --out FILE
    python -m tagloom analyse CONFIG
    python -m tagloom enumerate LIBRARY --data-dir DIR --out FILE [--count-only]

An output that exists is an error unless --overwrite is given.  Tables may lie wherever Spark reads and
writes; selections, libraries, configurations, statistics and reports are small files of the driver.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from tagloom.operators import collect as U
from tagloom.operators.decode import Decoder, as_lines, decode, failures, statistics
from tagloom.operators.enumerate import enumerate_library, sizes
from tagloom.plans.analysis import run_analysis
from tagloom.plans.report import decoding_report
from tagloom.session import cut, local_session
from tagloom.sources import files
from tagloom.sources.fastq import read_sequences
from tagloom.sources.library import DataFolder, load_library, load_selection


def run_decode(spark: SparkSession, a: argparse.Namespace) -> None:
    """Decoded reads, failures on demand, statistics and a report in the folder ``--out``."""
    selection = load_selection(a.selection, DataFolder(a.data_dir))
    reads = a.reads or selection.sequence_files
    if not reads:
        raise SystemExit("the selection names no sequence files; give some with --reads")
    decoded = cut(decode(read_sequences(spark, reads, a.quality), Decoder(selection.libraries, selection.tools, selection.settings)))
    os.makedirs(a.out, exist_ok=True)
    at = lambda name: os.path.join(a.out, f"{selection.selection_id}_{name}")
    files.write_decoded(as_lines(decoded), at("decoded.tsv"), a.split_by_library, not a.no_scores, mode(a))
    if a.save_failed:
        files.write_failed(failures(decoded), at("failed.tsv"), mode(a))
    stats = files.write_stats(statistics(decoded), files.output_path(at("stats.json"), overwrite=a.overwrite))
    decoding_report(stats, selection.selection_id, at("report.html"))


def run_collect(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [files.read_decoded(spark, p) for p in a.decoded]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    files.write_collected(U.collect(whole, a.score_threshold), a.out, a.compress, mode(a))


def run_count(spark: SparkSession, a: argparse.Namespace) -> None:
    method = None if a.method == "none" else a.method
    files.write_counted(U.count_compounds(files.read_collected(spark, a.collected), method, a.raw, a.dedup), a.out, a.format, mode(a))


def run_merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Collected compounds are added up UMI by UMI, statistics field by field; counted tables are joined end to end."""
    if a.kind == "collected":
        files.write_collected(U.regrouped(files.read_collected(spark, a.files)), a.out, mode=mode(a))
    elif a.kind == "counted":
        files.concat_parquet(spark, a.files, a.out, mode(a))
    else:
        files.write_stats(U.merged_stats([files.read_stats(spark, p) for p in a.files]), files.output_path(a.out, overwrite=a.overwrite))


def run_summarise(spark: SparkSession, a: argparse.Namespace) -> None:
    summary = U.summarize(files.read_counted(spark, a.counted))
    if a.selection:
        known = load_selection(a.selection, DataFolder(a.data_dir)).libraries
        summary = U.zero_filled(summary, spark.createDataFrame([(x.library_id,) for x in known], "library_id string"))
    files.write_summary(summary, files.output_path(a.out, overwrite=a.overwrite))


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    with open(a.stats) as f:
        decoding_report(json.load(f), a.title or os.path.basename(a.stats), files.output_path(a.out, overwrite=a.overwrite))


def run_analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    run_analysis(spark, a.config)


def run_enumerate(spark: SparkSession, a: argparse.Namespace) -> None:
    folder = DataFolder(a.data_dir)
    library = load_library(folder.find("libraries", a.library), folder)
    if a.count_only:
        print(sizes(library))
        return
    files.write_counted(enumerate_library(spark, library, on_failure=a.on_failure), a.out, a.format, mode(a))


def mode(a: argparse.Namespace) -> str:
    return "overwrite" if a.overwrite else "error"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tagloom", description="From reads of DNA-encoded libraries to counts and reports.")
    top.add_argument("--cpus", default="8", help="cores of a local session, where no other session is running")
    steps = top.add_subparsers(dest="step", required=True)

    def step(name: str, run: Callable, *positional: str, many: str | None = None, out: bool = True) -> argparse.ArgumentParser:
        p = steps.add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        for x in positional:
            p.add_argument(x)
        if many:
            p.add_argument(many, nargs="+")
        if out:
            p.add_argument("--out", required=True)
        p.add_argument("--overwrite", action="store_true")
        p.set_defaults(run=run)
        return p

    p = step("decode", run_decode, "selection")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--reads", nargs="+")
    p.add_argument("--quality", type=float, default=0.0, help="least mean quality of a read")
    for flag in ("--split-by-library", "--no-scores", "--save-failed"):
        p.add_argument(flag, action="store_true")
    p = step("collect", run_collect, many="decoded")
    p.add_argument("--score-threshold", type=float, default=100.0)
    p.add_argument("--compress", action="store_true")
    p = step("count", run_count, many="collected")
    p.add_argument("--method", choices=("directional", "cluster", "none"), default="directional")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--dedup", action="store_true")
    p.add_argument("--format", choices=("parquet", "tsv", "tsv.gz"), default="parquet")
    p = step("merge", run_merge)
    p.add_argument("kind", choices=("collected", "counted", "stats"))
    p.add_argument("files", nargs="+")
    p = step("summarise", run_summarise, "counted")
    p.add_argument("--selection")
    p.add_argument("--data-dir", default=".")
    p = step("report", run_report, "stats")
    p.add_argument("--title")
    step("analyse", run_analyse, "config", out=False)
    p = step("enumerate", run_enumerate, "library", out=False)
    p.add_argument("--out")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--count-only", action="store_true")
    p.add_argument("--on-failure", choices=("null", "drop", "raise"), default="null")
    p.add_argument("--format", choices=("parquet", "tsv", "tsv.gz"), default="parquet")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.step == "enumerate" and not (a.out or a.count_only):
        raise SystemExit("enumerate needs --out or --count-only")
    running = SparkSession.getActiveSession()
    spark = running or local_session(a.cpus)
    try:
        a.run(spark, a)
    finally:
        if running is None:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
