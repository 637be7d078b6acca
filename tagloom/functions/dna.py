"""Sequence functions: columns where Spark can say it, plain Python for neighbourhoods of short tags."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "AGCT"


def md5_dna(value: Column, length: int) -> Column:
    """A reproducible DNA string of a value: its md5 digits written with four letters."""
    return F.substring(F.translate(F.md5(value.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, length)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def section(seq: Column, start: Column | int, stop: Column | int) -> Column:
    """seq[start:stop] with Python's meaning of the bounds, for start >= 0."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return F.substring(seq, start + 1, F.greatest(stop - start, F.lit(0)))


def mean_phred(qualities: Column) -> Column:
    """Mean of (code - 33) over a quality string; null for null or empty ones."""
    total = F.aggregate(F.filter(F.split(qualities, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c) - 33)
    return F.when(F.length(qualities) > 0, total / F.length(qualities))


def quality_ok(qualities: Column, threshold: float) -> Column:
    """Whether a read passes: always for thresholds up to 0 and for reads without qualities."""
    return F.lit(True) if threshold <= 0 else F.coalesce(mean_phred(qualities) >= threshold, F.lit(True))


def has_ambiguity(umi: Column) -> Column:
    return F.contains(umi, F.lit("N"))


def windows(seq: Column, length: int) -> Column:
    """All substrings of the tag's length, then one shorter, then one longer, left to right."""
    n = F.length(seq)

    def of(size: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(size)))
        return F.when((n >= size) & F.lit(size > 0), cut).otherwise(F.array().cast("array<string>"))

    return F.concat(of(length), of(length - 1), of(length + 1))


def masked_keys(seq: Column) -> Column:
    """The sequence with each position hidden in turn: two of equal length share one iff they differ in one."""
    return F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.concat(F.substring(seq, F.lit(1), i - 1), F.lit("*"), F.substring(seq, i + 1, F.length(seq))))


def parted_keys(seq: Column, hidden: int) -> Column:
    """The sequence with each run of ``hidden`` bases hidden in turn: two of equal length that differ in one base
    share one of them, and what shares one differs in that run alone."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)), F.lit(hidden)), lambda i: i <= F.length(seq))
    return F.transform(starts, lambda i: F.concat(F.substring(seq, F.lit(1), i - 1), F.repeat(F.lit("*"), F.least(F.lit(hidden), F.length(seq) - i + 1)), F.substring(seq, i + hidden, F.length(seq))))


def hamming_neighbours(tag: str, distance: int) -> Iterator[tuple[str, int]]:
    """(neighbour, distance) within a Hamming distance, the tag itself first."""
    yield tag, 0
    for d in range(1, distance + 1):
        for at in combinations(range(len(tag)), d):
            for new in product(*([b for b in BASES if b != tag[i]] for i in at)):
                out = list(tag)
                for i, b in zip(at, new):
                    out[i] = b
                yield "".join(out), d


def levenshtein_neighbours(tag: str, distance: int) -> Iterator[tuple[str, int]]:
    """(neighbour, distance) within an edit distance, breadth first."""
    seen, ring = {tag}, [tag]
    yield tag, 0
    for d in range(1, distance + 1):
        following = []
        for s in ring:
            near = {s[:i] + s[i + 1 :] for i in range(len(s))}
            near |= {s[:i] + b + s[i + 1 :] for i in range(len(s)) for b in BASES}
            near |= {s[:i] + b + s[i:] for i in range(len(s) + 1) for b in BASES}
            for x in sorted(near - seen):
                seen.add(x)
                following.append(x)
                yield x, d
        ring = following


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
