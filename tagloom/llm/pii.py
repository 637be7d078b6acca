"""Personal data by candidate gradient boosting, in SQL functions only.

Generators of high recall propose spans, which may overlap; each candidate gets format features (of
its characters) and context features (of the text before and after); boosted trees score it, and a
calibrated threshold for its kind selects it.  The four base kinds are rules and always stay.  The
trees were trained by ``pii_train.py`` on generated examples and are compiled to CASE expressions, so
a row never leaves the JVM.

Patterns are written so that matching is linear: a run of characters is only tried from its start or
from the end of the last match (``\\G``), which leaves the leftmost match as it is, and quantifiers
are possessive where nothing that follows could use what they give back.  Possessive groups also
keep the matcher from recursing once per repetition.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "id")

LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: kind, pattern, what a text must hold besides a digit; if several strings, one of these and no digit
MORE = [
    ("secret", r"(?:\G|(?<![A-Za-z0-9_/+-]))(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+", None),
    ("secret", r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\x20?[:=]\x20?[\"']?[^\s\"',;]{6,}+", "=|:"),
    ("phone", r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9]|\.[0-9])", None),
    ("phone", r"(?<![0-9+.])0[0-9](?:[\x20.-]?[0-9]{2}){4}(?![0-9])", None),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2,3}(?:[\x20.-]?[0-9]{1,3})?(?![0-9])", None),
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20|\x20AT\x20)\x20?[\p{L}\p{N}-]{1,63}+(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20|\x20DOT\x20|\.)[\p{L}\p{N}-]{2,63}+){1,4}+", "(at)|[at]| at | AT "),
    ("id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
]
CANDIDATE = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,hit:string,before:string,after:string>>"
SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"
BLOCK = 256


def let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` of values that are computed once: an expression inside a lambda would be computed for
    each element."""
    names = list(values)
    one = F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), lambda z: body(*[z[n] for n in names]))
    return F.element_at(one, 1)


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Sums of all that stands before each element, with the total at the end; n * sqrt(n) at worst.

    ``op``: what takes the place of the sum, with 0 for nothing (for instance the greatest of numbers
    that are not negative)."""
    zero = F.lit(0).cast("bigint")
    grow = lambda start, xs: F.aggregate(xs, F.array(start), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))
    total = lambda xs: F.aggregate(xs, zero, op)
    cut_up = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

    def joined(parts: Column, starts: Column) -> Column:
        inner = F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda p, s: F.slice(grow(s, p), 1, F.size(p)))
        return F.concat(F.flatten(inner), F.array(F.element_at(starts, -1)))

    return let(lambda p: let(joined, p=p, s=grow(zero, F.transform(p, total))), p=let(cut_up, v=values))


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches with code-point positions and what stands around them, from one split."""
    sizes = lambda xs: F.transform(xs, lambda x: F.length(x).cast("bigint"))

    def placed(found: Column, gaps: Column, outside: Column, inside: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(found) - 1),
            lambda i: F.struct(
                (F.get(outside, i + 1) + F.get(inside, i)).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (F.get(outside, i + 1) + F.get(inside, i + 1)).alias("stop"),
                F.lit(kind).alias("kind"),
                F.get(found, i).alias("hit"),
                F.right(F.get(gaps, i), F.lit(24)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"),
            ),
        )

    def around(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        both = let(lambda f, g: let(placed, f=f, g=g, o=running(sizes(g)), i=running(sizes(f))), f=found, g=gaps)
        return F.when(F.size(found) > 0, both).otherwise(F.array().cast(CANDIDATE))

    return let(around, f=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def guarded(text: Column, made: Column, needs: str | None) -> Column:
    """``made`` where the text holds a digit, or one of the strings in ``needs``."""
    if needs in ("@", None) or needs is None:
        ok = F.contains(text, F.lit("@")) if needs == "@" else F.col("__digit")
    elif "|" in needs:
        ok = sum((F.contains(text, F.lit(n)).cast("int") for n in needs.split("|")), F.lit(0)) > 0
    else:
        ok = F.col("__digit") & F.contains(text, F.lit(needs))
    return F.when(ok, made).otherwise(F.array().cast(CANDIDATE))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes(kind: str, hit: Column) -> Column:
    """The check of a base match: parts of an ip, Luhn, number of digits."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.regexp_like(p, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")), F.lit(False)))
    if kind == "card":
        return F.length(digits(hit)).between(12, 19) & F.call_function("luhn_check", digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


#: name -> SQL expression over the candidate c
WORDS = {
    "near_secret": r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|key|auth|bearer|credential)\W{0,4}$",
    "near_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|t[eé]l[eé]phone|tel[eé]fono)\W{0,12}$",
    "near_card": r"(?i)(?:card|visa|mastercard|amex|account|karte|carte|tarjeta)\W{0,12}(?:no|number|nr)?\W{0,4}$",
    "near_id": r"(?i)(?:ssn|social security|iban|passport|tax|steuer|insee|dni)\W{0,12}$",
    "near_mail": r"(?i)(?:mail|contact|write to|reach)\W{0,12}$",
    "near_plain": r"(?i)(?:version|license|licence|pages?|chapters?|figure|fig|sections?|isbn|issn|orders?|items?|model|part|serial|doi|build|commit|sha|md5|checksum|rev)\W{0,6}(?:no|number|nr)?\W{0,4}$",
}


def count_of(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def features(c: Column) -> list[Column]:
    """The numbers that the trees see, by the names in FEATURES."""
    hit = c["hit"]
    n = F.length(hit)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    number = digits(hit)
    return [
        *[F.when(c["kind"] == k, 1.0).otherwise(0.0).alias(f"is_{k}") for k in KINDS],
        n.cast("double").alias("length"),
        F.length(number).cast("double").alias("digits"),
        (F.length(number) * 100 / n).cast("double").alias("digit_share"),
        count_of(hit, "[A-Z]").cast("double").alias("upper"),
        count_of(hit, "[a-z]").cast("double").alias("lower"),
        count_of(hit, r"[-\x20().]").cast("double").alias("separators"),
        F.size(F.array_distinct(F.split(hit, ""))).cast("double").alias("distinct"),
        F.size(F.regexp_extract_all(hit, F.lit("[0-9]++"), F.lit(0))).cast("double").alias("digit_runs"),
        F.size(F.regexp_extract_all(hit, F.lit("[A-Za-z]++"), F.lit(0))).cast("double").alias("letter_runs"),
        F.regexp_like(hit, F.lit("^[0-9a-f]+$")).cast("double").alias("hex"),
        F.coalesce(F.when(F.length(number).between(12, 19), F.call_function("luhn_check", number)), F.lit(False)).cast("double").alias("luhn"),
        F.regexp_like(hit, F.lit(r"[:=]")).cast("double").alias("assigned"),
        F.contains(hit, F.lit("=")).cast("double").alias("equals"),
        F.regexp_like(hit, F.lit(r"(?i)(?:\.|dot[\])]?)\x20?(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk)$")).cast("double").alias("tld"),
        F.regexp_like(hit, F.lit(r"(?i)[\[(](?:at|dot)[\])]")).cast("double").alias("bracketed"),
        F.length(F.regexp_extract(hit, "([0-9]++)", 1)).cast("double").alias("first_run"),
        F.length(F.regexp_extract(hit, "([0-9]++)[^0-9]*+$", 1)).cast("double").alias("last_run"),
        F.regexp_like(hit, F.lit(r"^(?:19|20)[0-9]{2}[-/.\x20]")).cast("double").alias("year_first"),
        *[flag(F.regexp_like(c["before"], F.lit(p))).alias(name) for name, p in WORDS.items()],
        flag(F.regexp_like(c["before"], F.lit(r"[\p{L}\p{N}]$"))).alias("glued_before"),
        flag(F.regexp_like(c["after"], F.lit(r"^[\p{L}\p{N}]"))).alias("glued_after"),
    ]


FEATURES = [f"is_{k}" for k in KINDS] + [
    "length", "digits", "digit_share", "upper", "lower", "separators", "distinct", "digit_runs", "letter_runs", "hex", "luhn", "assigned", "equals", "tld", "bracketed", "first_run", "last_run", "year_first", *WORDS, "glued_before", "glued_after",
]


@lru_cache(maxsize=1)
def model() -> dict:
    """Trees, calibration and thresholds; a node is [feature, cut, left, right] or a leaf's number."""
    return json.loads(Path(__file__).with_name("pii_model.json").read_text())


def tree_sql(node, f: Column) -> Column:
    if not isinstance(node, list):
        return F.lit(float(node))
    name, at, left, right = node
    return F.when(f[name] <= at, tree_sql(left, f)).otherwise(tree_sql(right, f))


def score(f: Column, trained: dict) -> Column:
    """Calibrated probability: the trees' sum through a fitted logistic curve."""
    raw = sum((tree_sql(t, f) for t in trained["trees"]), F.lit(float(trained["base"])))
    a, b = trained["calibration"]
    return 1 / (1 + F.exp(-(raw * a + b)))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the arrays ``__base`` (checked base matches) and ``__more`` (what generators propose)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.withColumn("__t", t).withColumn("__digit", F.regexp_like(F.col("__t"), F.lit("[0-9]")))
    t = F.col("__t")
    base = {f"__{k}": guarded(t, matches(t, k, p), needs) for k, (p, needs) in BASE.items()}
    more = {f"__m{i}": guarded(t, matches(t, k, p), needs) for i, (k, p, needs) in enumerate(MORE)}
    docs = docs.withColumns(base | more)
    good = lambda k: lambda c: passes(k, c["hit"])
    bad = lambda k: lambda c: ~passes(k, c["hit"]) & (F.length(digits(c["hit"])) >= 9)
    kept = {f"__{k}": F.filter(f"__{k}", good(k)) for k in BASE}
    rejected = F.concat(*[F.filter(f"__{k}", bad(k)) for k in ("card", "phone")])
    return docs.withColumn("__more", F.concat(*[F.col(c) for c in more], rejected)).withColumns(kept).drop(*more)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_email, n_ip, n_card, n_phone (base matches), ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (start, rank, stop, kind), by start, then kind, in code
    points with the end exclusive; ``spans`` holds the base ones and those the trees select, and may
    overlap.  A narrow map.  Null and empty texts have no spans; repeated rows stay; columns of
    ``docs`` named like the outputs are replaced.
    """
    trained = model()
    limits = F.create_map(*[x for k, v in trained["thresholds"].items() for x in (F.lit(k), F.lit(float(v)))])
    out = ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")
    own = [c for c in docs.columns if c.lower() not in out]
    slim = lambda xs: F.transform(xs, lambda c: F.struct(c["start"], c["rank"], c["stop"], c["kind"]))
    distinct = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1)))  # noqa: E731  of sorted ones
    seen = candidates(docs, text)
    scored = F.transform("__more", lambda c: F.struct(c.alias("c"), F.struct(*features(c)).alias("f")))
    chosen = F.transform(F.filter("__scored", lambda x: score(x["f"], trained) >= limits[x["c"]["kind"]]), lambda x: x["c"])
    return (
        seen.withColumn("__scored", F.when(F.size("__more") > 0, scored))
        .withColumn("base", F.array_sort(slim(F.concat(*[F.col(f"__{k}") for k in BASE]))))
        .withColumn("spans", let(distinct, xs=F.array_sort(F.concat("base", F.coalesce(slim(chosen), F.array().cast(SPAN))))))
        .select(*[f"`{c}`" for c in own], *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], "base", "spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


#: Characters of a piece of the text, in which places are found by counting.
PIECE = 4096


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> Column:
    """The text with every span, overlapping ones merged, replaced by its first kind in brackets.

    ``spans`` is in order of start.  What lies between the furthest stop so far and a span's start is
    taken from pieces of the text, so the work is linear in the text plus a piece for each span.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    whole_part = lambda x: F.floor(x / PIECE).cast("int")
    rest = lambda x: F.pmod(x, F.lit(PIECE)).cast("int")

    def between(p: Column, a: Column, b: Column) -> Column:
        i, j = whole_part(a), whole_part(b)
        first = F.substring(F.get(p, i), rest(a) + 1, F.lit(PIECE))
        last = F.coalesce(F.substring(F.get(p, j), F.lit(1), rest(b)), F.lit(""))
        one = F.substring(F.get(p, i), rest(a) + 1, (b - a).cast("int"))
        return F.when(a >= b, F.lit("")).when(i == j, one).otherwise(F.concat(first, F.array_join(F.slice(p, i + 2, j - i - 1), ""), last))

    def rebuilt(p: Column, s: Column, far: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            fresh = (i == 0) | (x["start"] > F.get(far, i))
            return F.when(fresh, F.concat(between(p, F.get(far, i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(s, one), ""), between(p, F.element_at(far, -1), F.length(F.col(text)).cast("bigint")))

    stops = F.transform(F.col(spans), lambda x: x["stop"])
    furthest = running(stops, lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(rebuilt, p=pieces, s=F.col(spans), far=furthest)).otherwise(F.col(text))
