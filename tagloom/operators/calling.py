"""Barcode callers: exact and error-correcting lookups of tags, and the window search around them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dna import BASES, hamming_neighbours, levenshtein_neighbours, windows
from tagloom.session import cut, spread

AMBIGUOUS = object()


@dataclass(frozen=True)
class Call:
    item: Any
    score: float


class Memo(dict):
    """What was worked out, by argument: a bounded number, and empty where it is sent to executors."""

    def keep(self, key, value, most: int = 1 << 16):
        if len(self) >= most:
            self.clear()
        self[key] = value
        return value

    def __reduce__(self):
        return Memo, ()


class Caller:
    """A map from observed tags to calls; ``AMBIGUOUS`` marks ties, None is a miss."""

    def __init__(self, table: dict[str, Any], fixed: Any = None):
        self.table, self.fixed = table, fixed

    def __call__(self, tag: str):
        return Call(self.fixed, 0.0) if self.fixed is not None else self.table.get(tag)


def exact_caller(tags: dict[str, Any]) -> Caller:
    return Caller({t: Call(x, 0.0) for t, x in tags.items()})


def correcting_caller(tags: dict[str, Any], neighbours: Callable[[str, int], Iterator[tuple[str, int]]], distance: int, asymmetrical: bool) -> Caller:
    """All neighbours of all tags.

    Symmetrical: two items must not meet anywhere.  Asymmetrical: the item at the least distance
    wins, and items tied there make the neighbour ambiguous.
    """
    near: dict[str, tuple[int, set]] = {}
    for tag, item in tags.items():
        for n, d in neighbours(tag, distance):
            best, items = near.setdefault(n, (d, set()))
            if not asymmetrical and items and item not in items:
                raise ValueError(f"{n} is within {distance} of tags of {items} and {item}; use asymmetrical correction")
            if d < best:
                near[n] = (d, {item})
            elif d == best:
                items.add(item)
    return Caller({n: Call(next(iter(items)), float(d)) if len(items) == 1 else AMBIGUOUS for n, (d, items) in near.items()})


def parse_mode(mode: str | None) -> tuple[str, int, bool]:
    """('exact', 0, False) or (kind, distance, asymmetrical) from ``hamming_dist:d[,x]`` and the like."""
    if mode is None or mode == "disable":
        return "exact", 0, False
    kind, colon, rest = mode.partition(":")
    if not colon or kind not in ("hamming_dist", "levenshtein_dist"):
        raise ValueError(f"error correction {mode!r} is not disable, hamming_dist:d or levenshtein_dist:d")
    number, comma, _ = rest.partition(",")
    return kind, int(number), bool(comma)


def make_caller(tags: dict[str, Any], mode: str | None = None) -> Caller:
    """The caller for a mode; a single tag is always called."""
    if len(tags) == 1:
        return Caller({}, fixed=next(iter(tags.values())))
    kind, distance, asymmetrical = parse_mode(mode)
    if kind == "exact":
        return exact_caller(tags)
    return correcting_caller(tags, hamming_neighbours if kind == "hamming_dist" else levenshtein_neighbours, distance, asymmetrical)


def scan(codon: str, length: int) -> Iterator[tuple[str, int, int]]:
    """Windows of the tag's length, one shorter, one longer, left to right."""
    for size in (length, length - 1, length + 1):
        for at in range(len(codon) - size + 1 if size > 0 else 0):
            yield codon[at : at + size], at, at + size


def hits(codon: str, caller: Caller, length: int) -> Iterable[tuple[Call, int, int]]:
    for window, a, b in scan(codon, length):
        call = caller(window)
        if isinstance(call, Call):
            yield call, a, b


def greedy(codon: str, caller: Caller, length: int):
    """The first hit."""
    return next(iter(hits(codon, caller, length)), None)


def first_perfect(codon: str, caller: Caller, length: int, conflict: bool = True, compat: bool = False):
    """The first perfect hit, else the best one; with ``conflict`` two different items at the best
    score are ambiguous.  ``compat``: any hit at another score replaces the best so far, even if worse."""
    best, tied = None, False
    for hit in hits(codon, caller, length):
        if hit[0].score == 0:
            return hit
        if best is None or hit[0].score < best[0].score or (compat and (not conflict or hit[0].score != best[0].score)):
            best, tied = hit, False
        elif hit[0].score == best[0].score and (compat or hit[0].item != best[0].item):
            tied = True
    return AMBIGUOUS if tied and conflict else best


def search_all(codon: str, caller: Caller, length: int):
    """The best hit if no other window scores the same."""
    found = list(hits(codon, caller, length))
    if not found:
        return None
    low = min(h[0].score for h in found)
    found = [h for h in found if h[0].score == low]
    return found[0] if len(found) == 1 else AMBIGUOUS


APPROACHES: dict[str, Callable] = {
    "greedy": greedy,
    "first_perfect": first_perfect,
    "first_best": lambda codon, caller, length: first_perfect(codon, caller, length, conflict=False),
    "search_all": search_all,
}


def hamming_ring(tag: Column) -> Column:
    """Array of (tag, distance): the tag itself and all that differ in one base."""
    at = F.sequence(F.lit(1), F.length(tag))

    def swapped(i: Column) -> Column:
        made = F.transform(F.array(*[F.lit(b) for b in BASES]), lambda b: F.concat(F.substring(tag, F.lit(1), i - 1), b, F.substring(tag, i + 1, F.length(tag))))
        return F.filter(made, lambda x: x != tag)

    ring = F.transform(F.flatten(F.transform(at, swapped)), lambda x: F.struct(x.alias("tag"), F.lit(1).alias("distance")))
    return F.concat(F.array(F.struct(tag.alias("tag"), F.lit(0).alias("distance"))), ring)


def levenshtein_ring(tag: Column) -> Column:
    """Array of (tag, distance): the tag itself and all at edit distance one."""
    bases = F.array(*[F.lit(b) for b in BASES])
    n = F.length(tag)
    head, tail = lambda i: F.substring(tag, F.lit(1), i - 1), lambda i: F.substring(tag, i, n)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(head(i), tail(i + 1)))
    swaps = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(bases, lambda b: F.concat(head(i), b, tail(i + 1)))))
    adds = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(bases, lambda b: F.concat(head(i), b, tail(i)))))
    near = F.filter(F.array_distinct(F.concat(cuts, swaps, adds)), lambda x: x != tag)
    return F.concat(F.array(F.struct(tag.alias("tag"), F.lit(0).alias("distance"))), F.transform(near, lambda x: F.struct(x.alias("tag"), F.lit(1).alias("distance"))))


def lookup_table(tags: DataFrame, ring: Callable[[Column], Column] = hamming_ring, distance: int = 1) -> DataFrame:
    """(observed, item, distance): the unique item at the least distance; ambiguous ones are left out.

    ``tags``: tag, item.  What is within ``distance`` is reached by as many steps of the ``ring`` of
    distance one.  Items at distance d + 1 from a string, if none is nearer, are those at d from its
    neighbours of least distance d; so each string keeps the least and the greatest of its nearest
    items alone, and a step goes on from strings that are new.  Items of one tag combine first: a step
    costs what the distinct strings cost, however many items share them.  Strings are dealt out before
    each step, as rings are heavy for their bytes, and steps before the last are written once.
    """
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    known = tags.groupBy(F.col("tag").alias("observed")).agg(F.min("item").alias("lo"), F.max("item").alias("hi")).withColumn("distance", F.lit(0))
    for step in range(distance):
        known = cut(known) if step else known
        further = spread(known.where(F.col("distance") == step)).select(F.explode(ring(F.col("observed"))).alias("x"), "lo", "hi").where("x.distance = 1")
        further = further.groupBy(F.col("x.tag").alias("observed")).agg(*ends).withColumn("distance", F.lit(step + 1))
        known = known.union(further.join(known.hint("merge"), "observed", "left_anti"))
    return known.where("lo = hi").select("observed", F.col("lo").alias("item"), "distance")


def search_windows(reads: DataFrame, lookup: DataFrame, key: str, read: str, length: int) -> DataFrame:
    """``search_all`` as a join: (key, item, distance) of every read, null unless one window alone has
    the least distance.  The windows of a read are few, and counted before they are moved by its key.
    No side is broadcast: Catalyst takes the windows for no more than the column they come from."""
    called = spread(reads.select(key, read)).select(key, F.explode(windows(F.col(read), length)).alias("observed")).join(lookup.hint("merge"), "observed")
    per = called.groupBy(key, "distance").agg(F.count("*").alias("n"), F.min("item").alias("item"))
    best = per.groupBy(key).agg(F.min(F.struct("distance", "n", "item")).alias("best")).where("best.n = 1").select(key, "best.item", "best.distance")
    return reads.select(key).join(best.hint("merge"), key, "left")


def call_tags(observed: DataFrame, lookup: DataFrame, tag: str = "tag") -> DataFrame:
    """``observed`` with item and distance, null where there is no call.  Both sides are shuffled on the
    tag: a lookup has many more rows than its tags' file lets Catalyst expect, so it is never broadcast."""
    return observed.join(lookup.hint("merge"), observed[tag] == lookup["observed"], "left").drop("observed")


def min_levenshtein(tags: DataFrame) -> int | None:
    """The least edit distance between two rows of ``tags`` (tag, item), without comparing all pairs.

    Two strings within d edits share a string that d deletions at most make of either; so for d = 0,
    1, ... the tags are joined on those, until a pair within d is found.  None if there are no two items.
    """
    left = tags.select("tag", "item")
    if left.select("item").distinct().limit(2).count() < 2:
        return None
    for d in count():
        variants = F.array(F.col("tag"))
        for _ in range(d):
            variants = _shorter(variants)
        near = left.select("tag", "item", F.explode(variants).alias("v"))
        a, b = near.select("v", F.col("tag").alias("s"), F.col("item").alias("i")), near.select("v", F.col("tag").alias("t"), F.col("item").alias("j"))
        if not a.join(b, "v").where((F.col("i") < F.col("j")) & (F.levenshtein("s", "t") <= d)).isEmpty():
            return d
    return None


def _shorter(strings: Column) -> Column:
    """The strings and all that one deletion makes of them."""
    cuts = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.array_distinct(F.concat(strings, F.flatten(F.transform(F.filter(strings, lambda s: F.length(s) > 0), cuts))))
