"""What has to stay bounded, or in proportion, as the tables grow."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tagloom.operators import align as A
from tagloom.operators import calling as C
from tagloom.operators import demux as M
from tagloom.operators.decode import Decoder, Settings, decode, statistics
from tagloom.plans.queries_dna import LIBRARIES
from tagloom.session import spread


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fingerprint_hashes_each_gram_once(spark):
    from tagloom.operators.ml import hashed_fingerprint

    texts = ["", "a", "CCO", "banana banana", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hashed_fingerprint(F.col("t"), 64).alias("x"))
    assert re.findall(r"array_contains\(\w*", plan_of(df)) == ["array_contains(lambda"]
    for i, x in df.collect():
        t = texts[i] or ""
        grams = {t[at : at + n] for n in (1, 2, 3) for at in range(max(len(t) - n + 1, 1))}
        slots = {int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 64 for g in grams}
        assert x == [float(b in slots) for b in range(64)]


def test_spread_deals_rows_out(spark):
    one = spark.range(1000).coalesce(1)
    sizes = spread(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 1000


def test_rings_are_made_of_distinct_tags(spark):
    """Items that share a tag are one before the ring is made; their string is no call, its neighbours none."""
    rows = [("ACGT", 1), ("ACGT", 2), ("TTTT", 3), ("TTTT", 3), ("TTAA", 4), (None, 5)]
    tags = spark.createDataFrame(rows, "tag string, item int")
    table = C.lookup_table(tags)
    below = plan_of(table).split("Generate")[1:]
    assert below and all("Aggregate" in b.split("LocalRelation")[0].split("LogicalRDD")[0] for b in below)
    for distance in (1, 2):
        found = {r["observed"]: (r["item"], r["distance"]) for r in C.lookup_table(tags, C.hamming_ring, distance).where("observed is not null").collect()}
        want = {}
        for s in {o for t, _ in rows if t for o, _ in C.hamming_neighbours(t, distance)}:
            near = [(sum(a != b for a, b in zip(s, t)), i) for t, i in rows if t]
            low = min(near)[0]
            items = {i for d, i in near if d == low}
            if len(items) == 1:
                want[s] = (items.pop(), low)
        assert found == want


def test_no_join_of_tags_or_windows_is_broadcast(spark):
    tags = spark.createDataFrame([("ACGT", 1), ("TTTT", 2)], "tag string, item int")
    reads = spark.createDataFrame([(1, "GGACGTCC"), (2, "ACGTTTTT"), (3, "CCCC")], "i int, read string")
    windowed = C.search_windows(reads, C.lookup_table(tags, distance=0), "i", "read", 4)
    called = C.call_tags(reads.withColumnRenamed("read", "tag"), C.lookup_table(tags))
    for df in (windowed, called):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["i"]: r["item"] for r in windowed.collect()} == {1: 1, 2: None, 3: None}


def faulty(rng: random.Random, text: str, faults: int) -> str:
    """``text`` with wrong, missing and added bases, at times cut at its ends."""
    out = list(text)
    for _ in range(faults):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1, 1, 1])] = rng.choice(["", *"ACGTN"])
    return "".join(out)[rng.choice([0, 0, 0, 2, 9]) :][: rng.choice([200, 200, 85])]


def test_alignments_of_many_are_those_of_each():
    rng = random.Random(1)
    for layout in ("ACGTTNNNNGATTACANN", "NNACGNT", "GATTACAGATTACA", "NNN"):
        plain = [layout.replace("N", rng.choice("ACGT")) for _ in range(30)]
        reads = [faulty(rng, "".join(rng.choices("ACGT", k=rng.randrange(9))) + p, rng.randrange(5)) or "A" for p in plain]
        assert A.align_many(reads, layout, 7) == [A.align(r, layout) for r in reads]


def test_full_demultiplexing_aligns_no_more_than_it_must(monkeypatch):
    """Whole reads are not aligned at all, faulty ones only where a bound leaves it open; places stay."""
    rng = random.Random(2)
    demux = M.Demultiplexer(LIBRARIES, "full", revcomp=True)
    whole = [re.sub("N", lambda _: rng.choice("ACGT"), M.layout_of(rng.choice(LIBRARIES).schema)) for _ in range(24)]
    whole[::3] = [r[::-1].translate(M.COMPLEMENT) for r in whole[::3]]
    reads = [*whole, *[faulty(rng, r, rng.randrange(1, 6)) for r in whole]]
    aligned = []
    monkeypatch.setattr(M, "align_many", lambda some, layout: aligned.extend(some) or A.align_many(some, layout))
    found = demux.many(reads)
    assert 0 < len(aligned) < 2 * len(whole)
    for read, made in zip(reads, found):
        texts = [read, read[::-1].translate(M.COMPLEMENT)]
        scored = [(A.align(t, M.layout_of(lib.schema)), t, lib, t is texts[1]) for t in texts for lib in LIBRARIES]
        (_, places), text, lib, flipped = max(scored, key=lambda s: s[0][0])
        assert (made.library, made.read, made.flipped, made.candidates) == (lib, text, flipped, [M.spans_at(lib.schema, places)])
        assert all(layout.bound(t) >= A.align(t, layout.text)[0] for t in texts for layout in demux.layouts)


def read_of(lib, umi: str) -> str:
    return M.layout_of(lib.schema).replace("N" * 8, umi).replace("NNNNNN", "CATGCA")


def turned(read: str) -> str:
    return read[::-1].translate(M.COMPLEMENT)


def test_end_of_a_primer_in_a_turned_umi_hides_no_read():
    """The turned UMI is the last eight bases of the primer, which the whole primer outweighs."""
    decoder = Decoder(LIBRARIES, settings=Settings(demultiplexer_algorithm="cutadapt", revcomp=True))
    status, _, library, *_, umi, _, flipped = decoder(turned(read_of(LIBRARIES[1], "CGAATCTA")))
    assert (status, library, umi, flipped) == ("OK", "L2", "CGAATCTA", True)


def test_statistics_decode_reads_once(spark):
    decoder = Decoder(LIBRARIES, settings=Settings(revcomp=False))
    rows = [(read_of(LIBRARIES[0], "ACGTACGT"),), (read_of(LIBRARIES[1], "ACGTACGT"),), ("A",), (None,), ("C" * 93,)]
    counted = statistics(decode(spark.createDataFrame(rows, "sequence string"), decoder))
    assert counted._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in counted.collect()} == {
        ("num_seqs_read", None, 5), ("num_seqs_decoded", "L1", 1), ("num_seqs_decoded", "L2", 1), ("num_failed_ReadTooShort", None, 2), ("num_failed_FailedStaticAlignment", None, 1),
    }
    none = statistics(decode(spark.createDataFrame([], "sequence string"), decoder))
    assert [tuple(r) for r in none.collect()] == [("num_seqs_read", None, 0)]


def test_only_reads_with_a_fault_in_a_section_are_searched_with_faults():
    rng = random.Random(3)
    for mode in ("single", "flanking", "library"):
        for q in M.Demultiplexer(LIBRARIES, mode, revcomp=True).queries:
            whole = [read_of(LIBRARIES[i % 2], "".join(rng.choices("ACGT", k=8))) for i in range(40)]
            reads = [*whole, *map(turned, whole), *[faulty(rng, r, rng.randrange(1, 4)) for r in whole * 5]]
            pattern, searched = q.compiled, []
            want = [m and (sum(m.fuzzy_counts), {n: m.span(n) for n in q.names}) for m in map(pattern.search, reads)]

            class Counting:
                def search(self, read):
                    searched.append(read)
                    return pattern.search(read)

            q.compiled = Counting()
            assert [q.search(r) for r in reads] == want
            assert len(searched) < len(reads) / 2


def test_windows_of_a_part_are_not_sorted(spark, tmp_path):
    """Windows are seen within the part's row: no aggregate takes them in, and repeated rows count."""
    from tagloom.plans.queries_dna import tag_windows

    spark.createDataFrame([(1,), (2,), (2,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    df = tag_windows(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Aggregate" not in plan[: plan.index("Generate")]
    want = set()
    for key, rows in ((1, 1), (2, 2)):
        tag = "".join("ACGT"[int(c, 16) % 4] for c in hashlib.md5(str(key).encode()).hexdigest()[:12])
        for size in (7, 8, 9):
            w = [tag[i : i + size] for i in range(13 - size)]
            want.add((key, size, rows * len(w), min(w)))
    assert {(r["p_partkey"], r["size"], r["n"], r["least"]) for r in df.collect()} == want


def test_umi_edges_move_few_keys_of_few_umis(spark):
    """Each pair once, for UMIs of any length; two keys for six bases, and 64 UMIs of four letters at most share one."""
    from tagloom.functions.dna import parted_keys
    from tagloom.operators import collect as K

    rng = random.Random(4)
    umis = sorted({"".join(rng.choices("ACGT", k=n)) for n in (1, 2, 3, 4, 6, 7) for _ in range(60)}) + ["ACNT", "", None]
    rows = [("L", b, u, 1 + i % 4) for b in ("x", None) for i, u in enumerate(umis)]
    df = spark.createDataFrame(rows, "library_id string, bb_ids string, umi string, c long")
    keys = df.select("umi", F.size(parted_keys(F.col("umi"), K.HIDDEN)).alias("n")).where("umi <> ''").collect()
    assert {(len(u), n) for u, n in keys} == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 2), (7, 3)}
    for directional in (False, True):
        found = sorted((r["bb_ids"] or "", r["a"], r["b"]) for r in K.hamming_edges(df, directional).collect())
        plain = [(b or "", u, v) for _, b, u, c in rows for _, e, v, d in rows if b == e and u and v and "N" not in u + v and len(u) == len(v) and u < v
                 and sum(x != y for x, y in zip(u, v)) == 1 and (not directional or max(c, d) >= 2 * min(c, d) + 1)]
        assert found == sorted(plain)
        counts = {r["bb_ids"]: r["count"] for r in K.corrected_in_rows(df, directional).collect()}
        assert counts == {r["bb_ids"]: r["count"] for r in K.corrected_set_based(df, directional).collect()}
