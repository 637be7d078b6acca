"""Queries over sequences, tags, synthetic reads, enumeration and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import dna as D
from tagloom.operators import calling as C
from tagloom.operators.decode import Decoder, Settings, as_lines, decode, length_status, statistics
from tagloom.operators.enumerate import members, sizes
from tagloom.operators.library import Block, BlockSet, Library, Schema, is_null_block, make_section, subset_parts, subset_reference_of
from tagloom.plans.derive import sql_dna
from tagloom.session import spread, table


def revcomp(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.reverse_complement(D.md5_dna(F.col("o_orderkey"), 24)).alias("rc"))


def section_slice(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.section(D.md5_dna(F.col("o_orderkey"), 24), 5, 12).alias("bb"))


def umi_has_n(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    read = F.concat(D.md5_dna(F.col("o_orderkey"), 8), F.when(F.col("o_orderkey") % 7 == 0, "N").otherwise("A"))
    return o.select("o_orderkey", D.has_ambiguity(read).alias("ambiguous")).groupBy("ambiguous").agg(F.count("*").alias("n"))


def quality_filter(spark, sf_dir):
    """md5 digits as qualities: codes 48 to 57 and 97 to 102."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("q"))
    return o.where(D.quality_ok(F.col("q"), 30.0)).select("o_orderkey", F.round(D.mean_phred(F.col("q")), 6).alias("mean_q"))


def tag_windows(spark, sf_dir):
    """Number and least of a part's windows of each size.  Rows of one part have the same windows: they
    are counted first, and the windows of a part are seen within its row."""
    p = spread(table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.count("*").alias("rows")))
    seen = p.select("p_partkey", "rows", D.windows(D.md5_dna(F.col("p_partkey"), 12), 8).alias("w"))
    of = lambda size: F.filter("w", lambda x: F.length(x) == size)
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), of(n).alias("w")) for n in (7, 8, 9)])).alias("x")
    return seen.select("p_partkey", "rows", sizes).where(F.size("x.w") > 0).select("p_partkey", "x.size", (F.col("rows") * F.size("x.w")).alias("n"), F.array_min("x.w").alias("least"))


def read_length_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", length_status(F.col("n_chars"), 500, 5000).alias("status"))


def decode_status_counts(spark, sf_dir):
    return read_length_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def _tags(spark, sf_dir, length=8):
    p = table(spark, sf_dir, "part")
    return p.select(D.md5_dna(F.col("p_partkey"), length).alias("tag"), F.col("p_partkey").alias("item"))


def _observed(spark, sf_dir, length=8):
    """Tags with the base at place p_partkey % length replaced by A, for all parts."""
    tag = D.md5_dna(F.col("p_partkey"), length)
    at = (F.col("p_partkey") % length).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.substring(tag, F.lit(1), at), F.lit("A"), F.substring(tag, at + 2, F.lit(length))).alias("tag"))


def tag_exact_lookup(spark, sf_dir):
    return C.call_tags(_observed(spark, sf_dir), C.lookup_table(_tags(spark, sf_dir), lambda t: F.array(F.struct(t.alias("tag"), F.lit(0).alias("distance"))))).select("p_partkey", "item")


def tag_fuzzy_hamming(spark, sf_dir):
    return C.call_tags(_observed(spark, sf_dir), C.lookup_table(_tags(spark, sf_dir))).select("p_partkey", "item", "distance")


def tag_fuzzy_levenshtein(spark, sf_dir):
    return C.call_tags(_observed(spark, sf_dir), C.lookup_table(_tags(spark, sf_dir), C.levenshtein_ring)).select("p_partkey", "item", "distance")


def tag_hamming_two(spark, sf_dir):
    return C.call_tags(_observed(spark, sf_dir), C.lookup_table(_tags(spark, sf_dir), distance=2)).select("p_partkey", "item", "distance")


def tag_levenshtein_two(spark, sf_dir):
    return C.call_tags(_observed(spark, sf_dir), C.lookup_table(_tags(spark, sf_dir), C.levenshtein_ring, 2)).select("p_partkey", "item", "distance")


def tag_min_levenshtein(spark, sf_dir):
    return spark.range(1).select(F.lit(C.min_levenshtein(_tags(spark, sf_dir, 10))).cast("long").alias("least"))


def tag_window_search(spark, sf_dir):
    """search_all over the exact tags: the only window that is a tag, else nothing."""
    exact = C.lookup_table(_tags(spark, sf_dir), distance=0)
    reads = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("GG"), D.md5_dna(F.col("p_partkey"), 8), F.lit("CC")).alias("read"))
    return C.search_windows(reads, exact, "p_partkey", "read", 8).select("p_partkey", "item")


def fake_library(name: str, tag: str, cycles: int = 3) -> Library:
    """A library with ten tags of six bases a cycle, two static sections and a UMI."""
    bases = [make_section("primer", "GTAGATCTTAGATTCG"), make_section("library", tag), make_section("static1", "GTTTAGATCATGC")]
    blocks = [make_section(f"bb{i}", "NNNNNN", o) for i, o in zip(range(1, cycles + 1), ("AG", "GC", "TC"))]
    schema = Schema([*bases, *blocks, make_section("static2", "CCTAGATTAG"), make_section("umi", "NNNNNNNN")])
    tags = ["ACACAC", "AGGTTA", "CATGCA", "CCGATT", "GATTAC", "GGCCAA", "TACGGT", "TGTGTG", "TTAACC", "CGTATG"]
    sets = [BlockSet(f"{name}_{i}", [Block(f"{name}{i}x{j}") for j in range(10)], {t: Block(f"{name}{i}x{j}") for j, t in enumerate(tags)}) for i in range(1, cycles + 1)]
    return Library(name, schema, sets)


LIBRARIES = [fake_library("L1", "ACCTTGGCAC"), fake_library("L2", "TTGACGGATC")]


def _reads(df, name, lib, one, two, three, turned):
    """Reads with library L1 for even ``lib``; every seventh ``turned`` has a wrong base in a static
    section, every eleventh is reversed."""
    tags = F.array(*[F.lit(t) for t in LIBRARIES[0].sets[0].tags])
    pick = lambda c: F.element_at(tags, (F.col(c) % 10 + 1).cast("int"))
    tag = F.when(F.col(lib) % 2 == 0, LIBRARIES[0].tag).otherwise(LIBRARIES[1].tag)
    static = F.when(F.col(turned) % 7 == 0, "GTTTAGATCATGG").otherwise("GTTTAGATCATGC")
    read = F.concat(F.lit("GTAGATCTTAGATTCG"), tag, static, pick(one), F.lit("AG"), pick(two), F.lit("GC"), pick(three), F.lit("TC"), F.lit("CCTAGATTAG"), D.md5_dna(F.col(turned), 8))
    return df.select(name.alias("read_name"), F.when(F.col(turned) % 11 == 0, D.reverse_complement(read)).otherwise(read).alias("sequence"))


def synthetic_reads(spark, sf_dir):
    """A read for each line item: library and blocks from its keys, the UMI from the order."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return _reads(li, F.concat_ws(":", "l_orderkey", "l_linenumber"), "l_linenumber", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey")


def _decoded(mode, **settings):
    def query(spark, sf_dir):
        decoder = Decoder(LIBRARIES, settings=Settings(demultiplexer_mode=mode, revcomp=True, **settings))
        lines = as_lines(decode(synthetic_reads(spark, sf_dir), decoder))
        return lines.select("read_name", "library_id", "bb_ids", "umi")

    return query


def faulty_reads(spark, sf_dir):
    """A read for each line item with a fault by its order: none; a base of the last block's tag set; cut
    short; repeated; an N in the UMI; a base of the library's tag set; a library's tag that is none; no
    primer; no room for the UMI; a base before the primer; a wrong and a missing base in the primer."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    tags = F.array(*[F.lit(t) for t in LIBRARIES[0].sets[0].tags])
    pick = lambda c: F.element_at(tags, (F.col(c) % 10 + 1).cast("int"))
    base = F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.col("l_partkey") % 4 + 1).cast("int"))
    set_at = lambda tag, at: F.concat(F.substring(tag, F.lit(1), at), base, F.substring(tag, at + 2, F.lit(20)))
    kind = F.col("l_orderkey") % 12
    lib = F.when(F.col("l_linenumber") % 2 == 0, LIBRARIES[0].tag).otherwise(LIBRARIES[1].tag)
    lib = F.when(kind == 5, set_at(lib, (F.col("l_suppkey") % 10).cast("int"))).when(kind == 6, "GGGGGGGGGG").otherwise(lib)
    primer = F.when(kind == 7, "A" * 16).when(kind == 9, "TGTAGATCTTAGATTCG").when(kind == 10, "GTAGATCCTAGATTCG").when(kind == 11, "GTAGATCTAGATTCG").otherwise("GTAGATCTTAGATTCG")
    last = F.when(kind == 1, set_at(pick("l_linenumber"), (F.col("l_suppkey") % 6).cast("int"))).otherwise(pick("l_linenumber"))
    umi = D.md5_dna(F.col("l_orderkey"), 8)
    umi = F.when(kind == 4, F.concat(F.lit("N"), F.substring(umi, 2, 7))).otherwise(umi)
    read = F.concat(primer, lib, F.lit("GTTTAGATCATGC"), pick("l_partkey"), F.lit("AG"), pick("l_suppkey"), F.lit("GC"), last, F.lit("TC"), F.lit("CCTAGATTAG"), umi)
    read = F.when(kind == 2, F.left(read, F.lit(40))).when(kind == 3, F.repeat(read, F.lit(6))).when(kind == 8, F.left(read, F.lit(72))).otherwise(read)
    return li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("read_name"), read.alias("sequence"))


def decode_faulty(spark, sf_dir):
    """All outcomes with their scores: block tags corrected within one edit, library tags within two."""
    decoder = Decoder(LIBRARIES, settings=Settings(apply_default=True))
    d = decode(faulty_reads(spark, sf_dir), decoder)
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.col(c).cast("array<string>"), ","))
    return d.select("read_name", "status", "library_id", "library_score", joined("bb_ids").alias("bb_ids"), joined("bb_scores").alias("bb_scores"), "umi", "overall_score")


def decode_faulty_statistics(spark, sf_dir):
    return statistics(decode(faulty_reads(spark, sf_dir), Decoder(LIBRARIES, settings=Settings(apply_default=True)))).select("name", "library_id", "value")


def decode_statistics(spark, sf_dir):
    decoder = Decoder(LIBRARIES, settings=Settings(revcomp=False))
    return statistics(decode(synthetic_reads(spark, sf_dir), decoder))


_BLOCK = "CAST(({0}) % 10 AS VARCHAR)"


_NAME = "CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)"


def _sql_decoded() -> str:
    bb = " || ',' || ".join(f"lib || '{i}x' || {_BLOCK.format(c)}" for i, c in enumerate(("l_partkey", "l_suppkey", "l_linenumber"), 1))
    return f"WITH r AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'L1' ELSE 'L2' END AS lib FROM lineitem) SELECT {_NAME} AS read_name, lib AS library_id, {bb} AS bb_ids, {sql_dna('l_orderkey', 8)} AS umi FROM r"


#: Of a table q with the status and library of every read.
_COUNTED = """SELECT 'num_seqs_read' AS name, NULL AS library_id, count(*) AS value FROM q
UNION ALL SELECT 'num_seqs_decoded', library_id, count(*) FROM q WHERE status = 'OK' GROUP BY 2
UNION ALL SELECT 'num_failed_' || status, NULL, count(*) FROM q WHERE status <> 'OK' GROUP BY 1"""
#: Reversed reads have no primer near where it should be; the others are decoded.
_STATISTICS = f"WITH q AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'FailedStaticAlignment' ELSE 'OK' END AS status, CASE WHEN l_linenumber % 2 = 0 THEN 'L1' ELSE 'L2' END AS library_id FROM lineitem) {_COUNTED}"

_TAGS = [*LIBRARIES[0].sets[0].tags]
#: The last block's tag as read (o) is called by the windows of its length, one shorter, left to right; the
#: first perfect call counts, else the best, if one item alone has it.  A window that ends early moves the UMI.
_FAULTY = f"""WITH tags(t, j) AS (VALUES {", ".join(f"('{t}', {j})" for j, t in enumerate(_TAGS))}),
r AS (SELECT *, l_orderkey % 12 AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'L1' ELSE 'L2' END AS lib, CASE WHEN l_linenumber % 2 = 0 THEN 'ACCTTGGCAC' ELSE 'TTGACGGATC' END AS tag,
  substr('ACGT', CAST(l_partkey % 4 + 1 AS BIGINT), 1) AS base, t AS last, {sql_dna('l_orderkey', 8)} AS umi8 FROM lineitem JOIN tags ON j = l_linenumber % 10),
x AS (SELECT *, CASE WHEN k = 1 THEN substr(last, 1, CAST(l_suppkey % 6 AS BIGINT)) || base || substr(last, CAST(l_suppkey % 6 + 2 AS BIGINT)) ELSE last END AS o,
  CASE WHEN k = 5 THEN CAST(levenshtein(tag, substr(tag, 1, CAST(l_suppkey % 10 AS BIGINT)) || base || substr(tag, CAST(l_suppkey % 10 + 2 AS BIGINT))) AS DOUBLE) ELSE 0.0 END AS ls FROM r),
w AS (SELECT DISTINCT o, i, substr(o, a, b - a + 1) AS win, b AS stop FROM x, (VALUES (1, 1, 6), (2, 1, 5), (3, 2, 6)) g(i, a, b)),
d AS (SELECT o, i, stop, j, levenshtein(win, t) AS d FROM w, tags WHERE levenshtein(win, t) <= 1),
m AS (SELECT o, i, min(d) AS d FROM d GROUP BY 1, 2),
u AS (SELECT d.o, d.i, stop, min(j) AS j, d.d FROM d JOIN m ON d.o = m.o AND d.i = m.i AND d.d = m.d GROUP BY d.o, d.i, stop, d.d HAVING count(DISTINCT j) = 1),
b AS (SELECT o, min(d) AS d FROM u GROUP BY 1),
h AS (SELECT u.o, arg_min(j, i) AS j, arg_min(stop, i) AS stop, CAST(min(u.d) AS DOUBLE) AS s, count(DISTINCT j) AS n FROM u JOIN b ON u.o = b.o AND u.d = b.d GROUP BY 1),
z AS (SELECT x.*, h.j AS j3, h.s, CASE WHEN h.stop = 5 THEN 'G' || substr(umi8, 1, 7) ELSE umi8 END AS umi9,
  CASE WHEN k = 2 THEN 'ReadTooShort' WHEN k = 3 THEN 'ReadTooLong' WHEN k = 7 THEN 'FailedStaticAlignment' WHEN k = 6 THEN 'FailedLibraryBarcodeLookup'
  WHEN h.o IS NULL THEN 'FailedBuildingBlockCall' WHEN h.s > 0 AND h.n > 1 THEN 'AmbiguousBuildingBlockBarcode' WHEN k = 8 THEN 'UMIContainsINDEL' WHEN k = 4 THEN 'UMIContainsAmbiguity' ELSE 'OK' END AS status FROM x LEFT JOIN h ON x.o = h.o)
SELECT {_NAME} AS read_name, status, CASE WHEN k NOT IN (2, 3, 6, 7) THEN lib END AS library_id, CASE WHEN status = 'OK' THEN ls END AS library_score,
  CASE WHEN status = 'OK' THEN lib || '1x' || {_BLOCK.format("l_partkey")} || ',' || lib || '2x' || {_BLOCK.format("l_suppkey")} || ',' || lib || '3x' || CAST(j3 AS VARCHAR) END AS bb_ids,
  CASE WHEN status = 'OK' THEN '0.0,0.0,' || CAST(s AS VARCHAR) END AS bb_scores, CASE WHEN status = 'OK' THEN umi9 END AS umi, CASE WHEN status = 'OK' THEN ls + s END AS overall_score FROM z"""


def enumerate_product(spark, sf_dir):
    """Three sets: the suppliers (every tenth a null block), the nations, the regions."""
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("NULL_"), "s_suppkey")).otherwise(F.concat(F.lit("s"), "s_suppkey")).alias("bb_id"), F.lit("C").alias("smiles"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("bb_id"), F.col("n_name").alias("smiles"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("bb_id"), F.col("r_name").alias("smiles"))
    return members([s, n, r], "LIB")


def enumeration_size(spark, sf_dir):
    """The members that ``enumerate_product`` lists, by the sets' sizes alone."""
    lib = _library_of(spark, sf_dir)
    return spark.range(1).select(F.lit(sizes(lib)).cast("long").alias("size"))


def _library_of(spark, sf_dir) -> Library:
    """A library of suppliers (every tenth a null block), nations and regions: small sets, as libraries have."""
    read = lambda t, key, prefix: [f"{prefix(r[0])}{r[0]}" for r in table(spark, sf_dir, t).select(key).orderBy(key).collect()]
    ids = [read("supplier", "s_suppkey", lambda k: "NULL_" if k % 10 == 3 else "s"), read("nation", "n_nationkey", lambda k: "n"), read("region", "r_regionkey", lambda k: "r")]
    sets = [BlockSet(f"set{i}", [Block(b) for b in blocks], {}) for i, blocks in enumerate(ids)]
    return Library("LIB", None, sets)


def null_block_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("Null"), "p_partkey")).otherwise(F.col("p_name")).alias("bb_id"), F.col("p_brand").alias("subset_id"))
    return p.where(~is_null_block(F.col("bb_id"))).groupBy("subset_id").agg(F.count("*").alias("n"))


def subset_reference(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", subset_reference_of(F.col("p_type"), F.col("p_brand")).alias("ref"))
    return p.select("p_partkey", *[c.alias(n) for c, n in zip(subset_parts(F.col("ref")), ("set_id", "subset_id"))])


def rf_regression(spark, sf_dir):
    from tagloom.operators.ml import forest_regression

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return forest_regression(e, "vec_id", "x", "y", folds=3, trees=10)


def rf_classifier(spark, sf_dir):
    from tagloom.operators.ml import forest_classification

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    return forest_classification(e, "vec_id", "x", F.col("label") > 4, folds=3, trees=10)


def fingerprint_bits(spark, sf_dir):
    from tagloom.operators.ml import hashed_fingerprint

    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    return p.select("p_partkey", F.aggregate(hashed_fingerprint(F.col("p_name")), F.lit(0.0), lambda a, x: a + x).alias("bits"))


QUERIES = {
    f.__name__: f
    for f in (
        revcomp, section_slice, umi_has_n, quality_filter, tag_windows, read_length_status, decode_status_counts, tag_exact_lookup, tag_fuzzy_hamming, tag_fuzzy_levenshtein, tag_hamming_two, tag_levenshtein_two, tag_min_levenshtein, tag_window_search,
        decode_faulty, decode_faulty_statistics, decode_statistics, enumerate_product, enumeration_size, null_block_filter, subset_reference, rf_regression, rf_classifier, fingerprint_bits,
    )
} | {
    "decode_reads": _decoded("single"),
    "decode_flanking": _decoded("flanking"),
    "decode_library": _decoded("library"),
    "decode_cutadapt": _decoded("single", demultiplexer_algorithm="cutadapt"),
    "decode_full": _decoded("full"),
}

_P = f"p AS (SELECT p_partkey AS item, {sql_dna('p_partkey', 8)} AS tag FROM part)"
_O = f"o AS (SELECT p_partkey, substr({sql_dna('p_partkey', 8)}, 1, CAST(p_partkey % 8 AS BIGINT)) || 'A' || substr({sql_dna('p_partkey', 8)}, CAST(p_partkey % 8 AS BIGINT) + 2) AS tag FROM part)"


def _fuzzy(distance: str, most: int = 1) -> str:
    return f"""WITH {_P}, {_O}, d AS (SELECT o.p_partkey, p.item, {distance} AS distance FROM o JOIN p ON {distance} <= {most}),
m AS (SELECT p_partkey, min(distance) AS lo FROM d GROUP BY 1),
u AS (SELECT d.p_partkey, min(item) AS item, CAST(min(distance) AS INTEGER) AS distance FROM d JOIN m ON d.p_partkey = m.p_partkey AND distance = lo GROUP BY 1 HAVING count(DISTINCT item) = 1)
SELECT o.p_partkey, u.item, u.distance FROM o LEFT JOIN u USING (p_partkey)"""


_STATUS = "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'ReadTooLong' WHEN n_chars < 500 THEN 'ReadTooShort' ELSE 'OK' END AS status FROM documents"
SQL = {
    "revcomp": f"SELECT o_orderkey, translate(reverse({sql_dna('o_orderkey', 24)}), 'ACGT', 'TGCA') AS rc FROM orders",
    "section_slice": f"SELECT o_orderkey, substr({sql_dna('o_orderkey', 24)}, 6, 7) AS bb FROM orders",
    "umi_has_n": "SELECT o_orderkey % 7 = 0 AS ambiguous, count(*) AS n FROM orders GROUP BY 1",
    "quality_filter": "WITH q AS (SELECT o_orderkey, list_avg(list_transform(string_split(md5(CAST(o_orderkey AS VARCHAR)), ''), lambda c: ascii(c) - 33)) AS m FROM orders) SELECT o_orderkey, round(m, 6) AS mean_q FROM q WHERE m >= 30",
    "tag_windows": f"WITH w AS (SELECT p_partkey, s AS size, substr({sql_dna('p_partkey', 12)}, i, s) AS win FROM part, range(7, 10) g(s), range(1, 13) h(i) WHERE i + s <= 13) SELECT p_partkey, CAST(size AS INTEGER) AS size, count(*) AS n, min(win) AS least FROM w GROUP BY ALL",
    "read_length_status": _STATUS,
    "decode_status_counts": f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY 1",
    "tag_exact_lookup": f"WITH {_P}, {_O}, u AS (SELECT tag, min(item) AS item FROM p GROUP BY 1 HAVING count(DISTINCT item) = 1) SELECT p_partkey, item FROM o LEFT JOIN u USING (tag)",
    "tag_fuzzy_hamming": _fuzzy("hamming(o.tag, p.tag)"),
    "tag_fuzzy_levenshtein": _fuzzy("levenshtein(o.tag, p.tag)"),
    "tag_hamming_two": _fuzzy("hamming(o.tag, p.tag)", 2),
    "tag_levenshtein_two": _fuzzy("levenshtein(o.tag, p.tag)", 2),
    "tag_min_levenshtein": f"WITH t AS (SELECT p_partkey AS item, {sql_dna('p_partkey', 10)} AS tag FROM part) SELECT min(levenshtein(a.tag, b.tag)) AS least FROM t a JOIN t b ON a.item < b.item",
    "tag_window_search": f"WITH {_P}, u AS (SELECT tag, min(item) AS item FROM p GROUP BY 1 HAVING count(*) = 1), w AS (SELECT p_partkey, item FROM (SELECT p_partkey, 'GG' || {sql_dna('p_partkey', 8)} || 'CC' AS r FROM part), range(1, 6) h(i), u WHERE substr(r, i, 8) = u.tag), k AS (SELECT p_partkey, min(item) AS item FROM w GROUP BY 1 HAVING count(*) = 1) SELECT part.p_partkey, k.item FROM part LEFT JOIN k ON part.p_partkey = k.p_partkey",
    "decode_reads": _sql_decoded(),
    "decode_flanking": _sql_decoded(),
    "decode_library": _sql_decoded(),
    "decode_cutadapt": _sql_decoded(),
    "decode_full": _sql_decoded(),
    "decode_statistics": _STATISTICS,
    "decode_faulty": _FAULTY,
    "decode_faulty_statistics": f"WITH q AS ({_FAULTY}) {_COUNTED}",
    "enumerate_product": "WITH s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS a FROM supplier WHERE s_suppkey % 10 <> 3) SELECT 'LIB-' || a || '-n' || CAST(n_nationkey AS VARCHAR) || '-r' || CAST(r_regionkey AS VARCHAR) AS DEL_ID, 'LIB' AS LIB_ID, a AS BB1_ID, 'C' AS BB1_SMILES, 'n' || CAST(n_nationkey AS VARCHAR) AS BB2_ID, n_name AS BB2_SMILES, 'r' || CAST(r_regionkey AS VARCHAR) AS BB3_ID, r_name AS BB3_SMILES FROM s, nation, region",
    "enumeration_size": "SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 10 <> 3) * (SELECT count(*) FROM nation) * (SELECT count(*) FROM region) AS size",
    "fingerprint_bits": "WITH t AS (SELECT p_partkey, coalesce(p_name, '') AS t, unnest([1, 2, 3]) AS n FROM part), g AS (SELECT p_partkey, t, n, unnest(range(1, greatest(length(t) - n + 1, 1) + 1)) AS i FROM t) SELECT p_partkey, CAST(count(DISTINCT CAST('0x' || substr(md5(substr(t, i, n)), 1, 8) AS BIGINT) % 256) AS DOUBLE) AS bits FROM g GROUP BY p_partkey",
    "null_block_filter": "SELECT p_brand AS subset_id, count(*) AS n FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1",
    "subset_reference": "SELECT p_partkey, p_type AS set_id, p_brand AS subset_id FROM part",
}
