import json
import random

import pytest

from tagloom.functions.dna import hamming_neighbours, levenshtein, levenshtein_neighbours
from tagloom.operators import calling as C
from tagloom.operators.decode import Decoder, Settings, as_lines, decode, statistics
from tagloom.operators.library import Block, BlockSet, Library, Schema, Tool, make_section
from tagloom.plans.queries_dna import LIBRARIES
from tagloom.sources import fastq, files
from tagloom.sources.library import DataFolder, load_blocks, load_library, load_selection


def render(lib, blocks, umi):
    """The error-free read of a compound."""
    out = []
    for s in lib.schema.sections:
        if s.kind == "bb":
            tag = next(t for t, b in lib.sets[s.cycle - 1].tags.items() if b.bb_id == blocks[s.cycle - 1])
            out.append(tag + s.overhang)
        else:
            out.append(umi if s.kind == "umi" else s.dna)
    return "".join(out)


MODES = [("single", "regex"), ("flanking", "regex"), ("library", "regex"), ("single", "cutadapt"), ("flanking", "cutadapt"), ("library", "cutadapt"), ("full", "regex")]


@pytest.mark.parametrize("mode,algorithm", MODES)
@pytest.mark.parametrize("realign", [False, True])
def test_round_trip(mode, algorithm, realign):
    r = random.Random(5)
    decoder = Decoder(LIBRARIES, settings=Settings(demultiplexer_mode=mode, demultiplexer_algorithm=algorithm, revcomp=True, realign=realign))
    for _ in range(8):
        lib = r.choice(LIBRARIES)
        blocks = [f"{lib.library_id}{i}x{r.randrange(10)}" for i in (1, 2, 3)]
        umi = "".join(r.choice("ACGT") for _ in range(8))
        read = "AC" + render(lib, blocks, umi) + "GT"
        if r.random() < 0.5:
            read = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
        got = decoder(read)
        assert got[0] == "OK" and got[2] == lib.library_id and got[4] == blocks and got[6] == umi


def test_failures_and_errors():
    lib = LIBRARIES[0]
    decoder = Decoder(LIBRARIES)
    read = render(lib, ["L11x0", "L12x1", "L13x2"], "ACGTACGT")
    assert decoder(None)[0] == "ReadTooShort" and decoder("A" * 2000)[0] == "ReadTooLong"
    assert decoder("A" * len(read))[0] == "FailedStaticAlignment"
    assert decoder(read.replace(lib.tag, "GGGGGGGGGG"))[0] == "FailedLibraryBarcodeLookup"
    assert decoder(read.replace("ACACAC", "GGGGGG"))[0] == "FailedBuildingBlockCall"
    assert decoder(read[:-1] + "N")[0] == "UMIContainsAmbiguity"
    wrong = read.replace("GTTTAGATCATGC", "GTTTAGATCATGG")
    assert decoder(wrong)[0] == "OK"


def test_correction_in_sections():
    tags = {"ACACAC": Block("a"), "GGTTGG": Block("b")}
    schema = Schema([make_section("primer", "GTAGATCTTAGATTCG"), make_section("library", "ACCTTGGCAC"), make_section("bb1", "NNNNNN", mode="hamming_dist:1"), make_section("bb2", "NNNNNN", mode="levenshtein_dist:1,asymmetrical"), make_section("umi", "NNNNNN")])
    lib = Library("X", schema, [BlockSet("s1", list(tags.values()), dict(tags)), BlockSet("s2", list(tags.values()), dict(tags))])
    decoder = Decoder([lib])
    got = decoder("GTAGATCTTAGATTCG" + "ACCTTGGCAC" + "ACATAC" + "GGTTG" + "CCCAAA" + "TTTTT")
    assert got[0] == "OK" and got[4] == ["a", "b"] and got[5] == [1.0, 1.0]


def test_tool_and_doped():
    schema = Schema([make_section("primer", "GTAGATCTTAGATTCG"), make_section("library", "GGGGTTTTCC"), make_section("tool_compound_ref", "ACGTTGCATTGACC"), make_section("umi", "NNNNNN")], tool=True)
    tool = Tool("T1", schema)
    read = "GTAGATCTTAGATTCG" + "GGGGTTTTCC" + "ACGTTGCATTGACC" + "ACGTAC"
    got = Decoder(LIBRARIES, [tool])(read)
    assert got[0] == "OK" and got[2] == "ToolCompound" and got[4] == ["T1"] and got[6] == "ACGTAC"
    assert Decoder(LIBRARIES, [tool], Settings(ignore_tool_compounds=True, min_read_length=5))(read)[0] != "OK"


def brute_call(tags, observed, distance):
    near = sorted((distance(t, observed), x) for t, x in tags.items())
    lo = near[0][0]
    return (lo, {x for d, x in near if d == lo})


@pytest.mark.parametrize("kind,neighbours", [("hamming_dist", hamming_neighbours), ("levenshtein_dist", levenshtein_neighbours)])
def test_asymmetrical_caller_against_brute_force(kind, neighbours):
    r = random.Random(1)
    tags = {"".join(r.choice("ACGT") for _ in range(6)): i for i in range(25)}
    caller = C.make_caller(tags, f"{kind}:2,asymmetrical")
    dist = levenshtein if kind.startswith("lev") else lambda a, b: sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else 99
    for _ in range(300):
        seen = "".join(r.choice("ACGT") for _ in range(r.choice([5, 6, 6, 7]) if kind.startswith("lev") else 6))
        lo, items = brute_call(tags, seen, dist)
        got = caller(seen)
        if lo > 2:
            assert got is None
        elif len(items) > 1:
            assert got is C.AMBIGUOUS
        else:
            assert got.item in items and got.score == lo


def test_modes_and_approaches():
    assert C.parse_mode("disable") == ("exact", 0, False) and C.parse_mode("hamming_dist:2,x") == ("hamming_dist", 2, True)
    with pytest.raises(ValueError):
        C.parse_mode("hamming_dist_1")
    with pytest.raises(ValueError):
        C.make_caller({"AAAA": 1, "AAAT": 2}, "hamming_dist:1")
    caller = C.make_caller({"AAAA": 1, "CCCC": 2}, "hamming_dist:1")
    assert C.greedy("AAATCCCC", caller, 4)[0].item == 1 and C.first_perfect("AAATCCCC", caller, 4)[0].item == 2
    assert C.first_perfect("AAATCCCT", caller, 4) is C.AMBIGUOUS and C.search_all("AAAACCCC", C.make_caller({"AAAA": 1, "CCCC": 2}), 4) is C.AMBIGUOUS
    assert C.search_all("GGAAAAGG", caller, 4)[0].score == 0 and C.greedy("GGGG", caller, 4) is None
    assert C.make_caller({"AAAA": 7})("anything").item == 7


def test_fastq_source(spark, tmp_path):
    records = [(f"r{i}", "ACGT" * (i % 5 + 1), "@+II" * (i % 5 + 1)) for i in range(200)]
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)
    plain, packed = tmp_path / "a.fastq", tmp_path / "b.fq.gz"
    plain.write_text(text.rstrip("\n"))
    import gzip

    packed.write_bytes(gzip.compress(text.replace("\n", "\r\n").encode()))
    (tmp_path / "c.fasta").write_text(">x y\nAC\nGT\n>z\nTT\n")
    (tmp_path / "notes.txt").write_text("no")
    df = fastq.read_sequences(spark, str(tmp_path), split=300)
    assert df.count() == 402 and sorted(r["read_name"] for r in df.where("fastq_file LIKE '%a.fastq'").collect()) == sorted(n for n, _, _ in records)
    assert df.where("fastq_file LIKE '%fasta'").select("sequence").orderBy("sequence").collect()[0][0] == "ACGT"
    assert fastq.read_sequences(spark, [str(plain)], quality_threshold=35).count() == 0
    with pytest.raises(FileNotFoundError):
        fastq.resolve(str(tmp_path / "nothing*"))
    assert fastq.is_sequence_file("X.FASTQ.GZ") and not fastq.is_sequence_file("x.txt")


def test_decode_frame_and_files(spark, tmp_path):
    lib = LIBRARIES[0]
    reads = [("f", "a", render(lib, ["L11x0", "L12x1", "L13x2"], "ACGTACGT")), ("f", "b", "AAAA"), ("f", "c", None)]
    df = decode(spark.createDataFrame(reads, "fastq_file string, read_name string, sequence string"), Decoder(LIBRARIES))
    assert [r["bb_ids"] for r in as_lines(df).collect()] == ["L11x0,L12x1,L13x2"]
    stats = files.write_stats(statistics(df), str(tmp_path / "s.json"))
    assert stats["num_seqs_read"] == 3 and stats["num_failed_ReadTooShort"] == 2 and stats["num_seqs_decoded_per_lib"] == {"L1": 1}
    assert files.read_stats(spark, str(tmp_path / "s.json")).count() == 3
    files.write_decoded(as_lines(df), str(tmp_path / "d"))
    assert files.read_decoded(spark, str(tmp_path / "d")).collect()[0]["overall_score"] == 0.0
    empty = decode(spark.createDataFrame([], "read_name string, sequence string"), Decoder(LIBRARIES))
    assert empty.count() == 0


def test_loaders(tmp_path):
    folder = DataFolder.create(str(tmp_path / "data"))
    assert folder.problems() == []
    for c in "AB":
        (tmp_path / "data/building_blocks" / f"S{c}.csv").write_text("id,tag\n" + "".join(f"{c}{i},{t}\n" for i, t in enumerate(["ACAC", "GGTT", "TTAA"])))
    schema = {"primer": {"tag": "GTAGATCT"}, "library": {"tag": "ACCTTGGC", "overhang": "AG"}, "bb1": {"tag": "NNNN", "error_correction": "hamming_dist:1"}, "bb2": {"tag": "NNNN"}, "umi": {"tag": "NNNN"}}
    (tmp_path / "data/libraries/LIB 1.json").write_text(json.dumps({"barcode_schema": schema, "bb_sets": [{"cycle": 1, "bb_set_name": "SA"}, {"cycle": 2, "bb_set_name": "SB"}]}))
    lib = load_library(folder.find("libraries", "LIB 1"))
    assert lib.library_id == "LIB_1" and lib.size == 9 and lib.tag == "ACCTTGGCAG" and lib.schema.blocks[0].mode == "hamming_dist:1"
    (tmp_path / "sel.yaml").write_text("libraries: ['LIB 1']\nsequence_files: [x.fastq]\ndecode_settings: {revcomp: true}\ntarget_id: T\n")
    sel = load_selection(str(tmp_path / "sel.yaml"), folder)
    assert sel.selection_id == "sel" and sel.settings.revcomp and sel.about == {"target_id": "T"}
    bad = tmp_path / "bad.csv"
    bad.write_text("id,tag\na,ACAC\nb,ACAC\n")
    with pytest.raises(ValueError):
        load_blocks(str(bad))
    with pytest.raises(FileNotFoundError):
        folder.find("libraries", "none")


def test_decode_stream(spark, tmp_path):
    from tagloom.streaming.decode_stream import decode_stream, decoded_so_far

    lib = LIBRARIES[1]
    rows = [("f", str(i), render(lib, ["L21x0", "L22x1", f"L23x{i % 10}"], "ACGTACGT"), None) for i in range(20)]
    spark.createDataFrame(rows, "fastq_file string, read_name string, sequence string, qualities string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        decode_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), Decoder(LIBRARIES), str(tmp_path / "cp"), once=True).awaitTermination()
    assert decoded_so_far(spark, str(tmp_path / "out")).count() == 20


def test_full_alignment_decodes_every_line_item(spark, sf):
    """Full alignment gives a read for each line item, as the other modes do."""
    import __spark_entry__ as entry

    found, other = (entry.queries()[q](spark, sf) for q in ("decode_full", "decode_reads"))
    assert entry.oracle_sql()["decode_full"] == entry.oracle_sql()["decode_reads"]
    rows = found.collect()
    assert sorted(rows) == sorted(other.collect())
    assert len(rows) == spark.read.parquet(f"{sf}/lineitem.parquet").count()


@pytest.mark.parametrize("ring, neighbours", [(C.hamming_ring, hamming_neighbours), (C.levenshtein_ring, levenshtein_neighbours)])
@pytest.mark.parametrize("distance", [1, 2, 3])
def test_lookup_table_at_any_distance(spark, ring, neighbours, distance):
    """Against the callers of the decoder: the same calls, and nothing where those are ambiguous."""
    tags = {"ACGTA": 1, "TTGCA": 2, "GGGAC": 3}
    want = {o: (c.item, int(c.score)) for o, c in C.correcting_caller(tags, neighbours, distance, True).table.items() if c is not C.AMBIGUOUS}
    table = C.lookup_table(spark.createDataFrame([*tags.items()], "tag string, item int"), ring, distance)
    assert {r.observed: (r.item, r.distance) for r in table.collect()} == want


def test_search_windows_equals_search_all(spark):
    tags = {"AAAA": 1, "CCCC": 2, "ACGT": 3}
    reads = ["AAAAG", "GAAAACCCC", "GGGG", "TACGTT", "AAAAA", "", "ACG", "AACCAAAA", "ACGA"]
    lookup = C.lookup_table(spark.createDataFrame([*tags.items()], "tag string, item int"))
    caller = C.make_caller(tags, "hamming_dist:1,asymmetrical")
    found = C.search_windows(spark.createDataFrame([*enumerate(reads)], "i int, read string"), lookup, "i", "read", 4)
    for r in found.collect():
        hit = C.search_all(reads[r.i], caller, 4)
        assert (r.item, r.distance) == ((hit[0].item, hit[0].score) if hit not in (None, C.AMBIGUOUS) else (None, None)), reads[r.i]


def test_least_distance_has_no_bound(spark):
    far = spark.createDataFrame([("A" * 12, 1), ("C" * 12, 2)], "tag string, item int")
    assert C.min_levenshtein(far.where("item = 1")) is None
    assert C.min_levenshtein(spark.createDataFrame([("AAAAAAAAA", 1), ("CCCCCCCCC", 2)], "tag string, item int")) == 9
