"""All queries of the library's own operators with their SQL counterparts.

DNA, reads, compounds and counts are derived from the driver's tables by expressions that both
dialects share; see ``plans/derive.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.plans import queries_cube, queries_dna, queries_reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries_reads.QUERIES | queries_dna.QUERIES | queries_cube.QUERIES
SQL: dict[str, str] = queries_reads.SQL | queries_dna.SQL | queries_cube.SQL
