import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import dna, quaternary
from tagloom.functions.stats import log_factorial, log_poisson, tail_start
from tagloom.operators.align import align, find_adapter


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b))


def test_neighbour_counts():
    assert len(list(dna.hamming_neighbours("ACGTACGTACGT", 1))) == 37
    assert len(list(dna.hamming_neighbours("ACGTACGTACGT", 2))) == 37 + 66 * 9
    near = dict(dna.levenshtein_neighbours("ACGT", 2))
    assert all(dna.levenshtein("ACGT", k) == d for k, d in near.items())


@given(st.text("ACGT", max_size=9), st.text("ACGT", max_size=9))
def test_levenshtein_bounds(a, b):
    d = dna.levenshtein(a, b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and d == dna.levenshtein(b, a) and (d == 0) == (a == b)


def test_quaternary_code_corrects_one_error():
    tags = quaternary.all_tags(64)
    assert len(set(tags)) == 64
    assert min(hamming(a, b) for i, a in enumerate(tags) for b in tags[:i]) >= 3
    for tag in tags[::7]:
        for i in range(len(tag)):
            for b in "ACGT":
                assert quaternary.correct(tag[:i] + b + tag[i + 1 :]) == tag
    assert quaternary.correct("N" * len(tags[0])) is None


def test_columns(spark):
    df = spark.createDataFrame([("AACG", "II!!"), (None, None), ("", "")], "s string, q string")
    rows = df.select(dna.reverse_complement(F.col("s")).alias("rc"), dna.mean_phred(F.col("q")).alias("m"), dna.quality_ok(F.col("q"), 20).alias("ok"), dna.windows(F.col("s"), 3).alias("w"), dna.masked_keys(F.col("s")).alias("k")).collect()
    assert rows[0]["rc"] == "CGTT" and rows[0]["m"] == 20 and rows[0]["ok"] and rows[1]["ok"] and rows[1]["rc"] is None
    assert rows[0]["w"] == ["AAC", "ACG", "AA", "AC", "CG", "AACG"]
    assert rows[0]["k"] == ["*ACG", "A*CG", "AA*G", "AAC*"]


def test_poisson(spark):
    ks = [0, 1, 5, 20, 21, 100, 5000]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select("k", log_factorial(F.col("k")).alias("f"), log_poisson(F.col("k"), 3.5).alias("p")).collect()
    for r in got:
        assert math.isclose(r["f"], math.lgamma(r["k"] + 1), rel_tol=1e-11, abs_tol=1e-11)
        assert math.isclose(r["p"], r["k"] * math.log(3.5) - 3.5 - math.lgamma(r["k"] + 1), rel_tol=1e-11)
    k = tail_start(2.0)
    pmf = lambda i: math.exp(-2) * 2**i / math.factorial(i)
    assert pmf(k) <= 0.01 and k >= 3 and all(pmf(i) > 0.01 for i in range(3, k))


def brute_align(read, layout):
    """Best score with free ends, affine gaps, by the plain recurrences."""
    n, m, low = len(layout), len(read), -(10**6)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i - 1][j] - 2, e[i - 1][j] - 1)
            f[i][j] = max(h[i][j - 1] - 2, f[i][j - 1] - 1)
            s = 0 if "N" in (layout[i - 1], read[j - 1]) else 1 if layout[i - 1] == read[j - 1] else -1
            h[i][j] = max(h[i - 1][j - 1] + s, e[i][j], f[i][j])
    return max(max(h[n]), max(r[m] for r in h))


def test_alignment_score_and_places():
    r = random.Random(3)
    for _ in range(60):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randint(1, 14))) for _ in range(2))
        b = "".join("N" if r.random() < 0.2 else c for c in b)
        score, places = align(a, b)
        assert score == max(0, brute_align(a, b)) and len(places) == len(b) + 1 and places == sorted(places)
    assert align("GGACGTNNACCC", "ACGTAAAC")[1] == [2, 3, 4, 5, 6, 7, 8, 9, 10]


@settings(deadline=None)
@given(st.text("ACGT", min_size=20, max_size=40), st.integers(0, 19))
def test_adapter_found_with_one_error(read, at):
    adapter = "ACCTGGATTCAG"
    wrong = adapter[:5] + ("A" if adapter[5] != "A" else "C") + adapter[6:]
    found = find_adapter(read[:at] + wrong + read[at:], adapter, 1)
    assert found is not None and found[0] <= 1


def test_adapter_at_the_ends():
    assert find_adapter("GGATTCAGTTTTTTTTTTTT", "ACCTGGATTCAG", 1, front=True) == (0, 0, 8)
    assert find_adapter("TTTTTTTTTTTTACCTGGATT", "ACCTGGATTCAG", 1, back=True)[2] == 21
    assert find_adapter("TTTTTTTTTTTT", "ACCTGGATTCAG", 1) is None


@pytest.mark.parametrize("count,size", [(4, 3), (16, 5), (64, 6), (65, 7)])
def test_tag_size(count, size):
    assert quaternary.tag_size(count) == size
