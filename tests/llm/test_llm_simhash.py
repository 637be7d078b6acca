"""SimHash groups against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tagloom.llm import queries, simhash


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{fingerprint: least fingerprint index} by union-find over all pairs."""
    n, root = len(fps), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(n):
        for j in np.nonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4)[0] + i + 1:
            root[find(int(j))] = find(i)
    return [find(i) for i in range(n)]


def brute(rows):
    """[(doc_id, fingerprint, component_id)]"""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = plain_components(fps)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return Counter((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, group))


def test_query_against_brute_force(spark, sf, documents):
    got = Counter(map(tuple, queries.op5_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()))
    want = brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert got == want
    assert any(i != c for i, _, c in got)


@pytest.mark.parametrize("ways", [{"bits": 4, "k": 4}, {}])
def test_no_join_sends_a_table_to_the_driver(spark, documents, monkeypatch, ways):
    """However high the threshold for broadcasts is: tables of nodes and links grow with the corpus."""
    plans, write = [], simhash.cut

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(simhash, "cut", lambda df: (plans.append(plan(df)), write(df))[1])
    docs = documents.select("doc_id", "text").limit(60)
    found = simhash.near_duplicates(docs, **ways)
    plans += [plan(found), plan(simhash.keep_one(docs, found))]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def near_words(r, n):
    """Fingerprints with many pairs at distances 0 to 8."""
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            out.append(x)
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
    return sorted({*out[:n]})


@pytest.mark.parametrize("chunk", [2048, 3])
def test_random_fingerprints(spark, monkeypatch, chunk):
    """Chains at the threshold and beyond it; with tiny chunks every anchor is cut up."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    fps = near_words(random.Random(chunk), 1500)
    r = random.Random(1)
    fps += [0, (1 << 64) - 1] + [sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for _ in range(60)]
    fps = sorted({*fps})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    root = {r.node: r.root for r in simhash.components(links).collect()}
    groups = plain_components(fps)
    members = {}
    for s, g in zip(signed, groups):
        members.setdefault(g, []).append(s)
    assert root == {s: min(m) for m in members.values() if len(m) > 1 for s in m}


def test_anchors_cover_every_linked_half(spark):
    """Half-words at distance 0, 1 and 2 share an anchor, whatever bits differ; there are 2 or 17 anchors."""
    r, pairs = random.Random(4), []
    for _ in range(300):
        x = r.getrandbits(32)
        bits = r.sample(range(32), r.randint(0, 2))
        y = x
        for b in bits:
            y ^= 1 << b
        pairs.append((x, y))
    rows = spark.createDataFrame(pairs, "x long, y long").select(simhash.anchors(simhash.F.col("x")).alias("a"), simhash.anchors(simhash.F.col("y")).alias("b")).collect()
    for row in rows:
        low = lambda anchors: {a for a in anchors if a >> 32 == 0}
        assert low(row.a) & low(row.b) and len(low(row.a)) in (2, 17)


def test_fingerprint_in_blocks(monkeypatch):
    text = ("Alpha beta\tGamma  delta epsilon\nzeta " * 40).encode()
    want = plain_fingerprint(text.decode())
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "BYTES", size)
        monkeypatch.setattr(simhash, "HASHES", 5)
        assert simhash.fingerprint(text) & (1 << 64) - 1 == want


def test_awkward_rows(awkward, none):
    found = simhash.near_duplicates(awkward)
    got = Counter((r.doc_id, r.f, r.component_id) for r in found.select("doc_id", simhash.hex16(found["fp"]).alias("f"), "component_id").collect())
    assert got == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(awkward, found)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len({*ids}) and {1, 4, 6, 10, None} <= {*ids} and not {2, 3, 11} & {*ids}


def test_one_row_of_each_group_stays(spark):
    """Groups without ids, different texts under one id, repeated rows and their copies."""
    words = lambda n: " ".join(f"{n}w{i}" for i in range(40))
    rows = [(None, words(1)), (None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (7, words(4)), (8, words(4)), (None, words(5)), (9, words(5))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    for found in (simhash.near_copies(docs), simhash.near_duplicates(docs, bits=4)):
        kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(docs, found).collect())
        assert kept == Counter([(None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (9, words(5))])


def test_near_copies_of_long_texts_are_found(spark):
    r = random.Random(9)
    words = ["w%d" % r.randint(0, 9999) for _ in range(3000)]
    near = words[:]
    near[1500] = "changed"
    other = ["w%d" % r.randint(0, 9999) for _ in range(3000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 3}


def plain_sets(rows):
    """{doc_id: the 5-word shingles}"""
    out = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set())
    return out


def jaccard_components(sets, least=0.8):
    """{doc_id: least doc_id of its group} by union-find over all pairs."""
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)):
                both = len(a & b)
                if both >= least * (len(a) + len(b) - both) - 1e-9:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: find(i) for i in ids}


def edited(r, words, n):
    words = words[:]
    for at in r.sample(range(len(words)), n):
        words[at] = "new%d" % r.randint(0, 10**6)
    return words


@pytest.mark.parametrize("chunk, rounds", [(2048, 2), (2048, 0), (3, 0)])
def test_near_copies_by_jaccard_against_all_pairs(spark, monkeypatch, chunk, rounds):
    """Pairs around 0.8, most of them beyond 4 bits; chains; a large group of near copies."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    r, texts = random.Random(5), []
    for _ in range(25):
        words = ["w%d" % r.randint(0, 9999) for _ in range(r.choice([12, 60, 300]))]
        texts.append(words)
        for _ in range(4):
            words = edited(r, words, r.randint(0, max(1, len(words) // 40)))
            texts.append(words)
    base = ["w%d" % r.randint(0, 9999) for _ in range(400)]
    texts += [edited(r, base, r.randint(1, 9)) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    r.shuffle(rows)
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.component_id for x in found.collect()}
    want = jaccard_components(plain_sets(rows))
    assert got == want
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert sum((fps[i] ^ fps[c]).bit_count() > 4 for i, c in want.items()) > 20


@pytest.mark.parametrize("chunk", [2048, 3])
def test_a_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch, chunk):
    """Copies of one text, by pairs from far below to far above 0.8: a node meets one centre a round, not one at each of its anchors."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    counts, compare = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *a: (counts.append(pairs.count()), compare(pairs, *a))[1])
    r = random.Random(6)
    base = ["w%d" % r.randint(0, 9999) for _ in range(150)]
    rows = [(i, " ".join(edited(r, base, r.choice([1, 1, 2, 2, 3, 8])))) for i in range(150)]
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.component_id for x in found.collect()}
    assert got == jaccard_components(plain_sets(rows)) and 1 < len({*got.values()}) < 75
    assert len(counts) == simhash.ROUNDS and max(counts) < len(rows)


@pytest.mark.parametrize("small", [0, 64])
def test_chains_keep_their_bands(spark, monkeypatch, small):
    """Nodes that connect over many steps are not all compared, the pairs that share an anchor still are."""
    monkeypatch.setattr(simhash, "SMALL", small)
    bands, make = [], simhash.near_bands
    monkeypatch.setattr(simhash, "near_bands", lambda *a: (bands.append(simhash.cut(make(*a))), bands[0])[1])
    r = random.Random(8)
    texts = [["w%d" % r.randint(0, 9999) for _ in range(200)]]
    for _ in range(150):
        texts.append(edited(r, texts[-1], r.randint(2, 6)))
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    monkeypatch.setattr(simhash, "drop_cut", lambda df: None)
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.component_id for x in found.collect()}
    assert got == jaccard_components(plain_sets(rows)) and 1 < len({*got.values()}) < 75
    sizes = [x["count"] for x in bands[0].groupBy("band").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 75, (len(sizes), max(sizes))


def test_shared_hashes_by_lists_of_holders():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 40), dtype=np.uint64)) for _ in range(60)]
    sets += [sets[3].copy(), np.arange(100, 104, dtype=np.uint64), np.arange(100, 105, dtype=np.uint64)]
    of = simhash.all_alike(sets, 0.8)
    for i, x in enumerate(sets):
        assert of(i).tolist() == [simhash.alike(x, y, 0.8) for y in sets]
    assert of(61)[62] and of(3)[60]


def test_block_anchors_are_the_nearest_code_words():
    code = np.unique(simhash._CODE)
    assert len(code) == 1 << 12
    distance = np.bitwise_count(np.arange(1 << 16) ^ simhash._CODE)
    assert distance.max() == 1 and (simhash._CODE[code] == code).all()
    assert min((a ^ b).bit_count() for a in code[code < 1 << 15].tolist()[:64] for b in code[code < 1 << 15].tolist() if a != b) == 3


def test_sets_at_the_least_jaccard_share_an_anchor():
    """Pairs at 0.8, of small and large sets, meet at a SimHash anchor and pass both filters; sets apart do not pass."""
    r = np.random.default_rng(3)
    p = simhash.differing(0.8)
    bits = lambda x: x.view("<u8")
    for both, a, b in ((4, 0, 1), (8, 1, 1), (40, 5, 5), (40, 0, 10), (400, 50, 50)):
        for _ in range(200):
            h = r.integers(0, 1 << 64, both + a + b, dtype=np.uint64)
            x, y = simhash.wide_fingerprint(h[: both + a]), simhash.wide_fingerprint(np.concatenate([h[:both], h[both + a :]]))
            assert (simhash.block_anchors(x) == simhash.block_anchors(y)).any()
            apart = np.bitwise_count(bits(x) ^ bits(y)).astype(int)
            assert apart[: simhash.FIRST].sum() <= (p + simhash.FIRST_OVER) * 64 * simhash.FIRST and apart.sum() <= (p + simhash.ALL_OVER) * 2048
            z = simhash.wide_fingerprint(r.integers(0, 1 << 64, both, dtype=np.uint64))
            assert np.bitwise_count(bits(x) ^ bits(z)).astype(int).sum() > (p + simhash.ALL_OVER) * 2048


def test_near_dedup_takes_its_candidates_from_the_anchors(spark, sf, documents, monkeypatch):
    """Without an anchor in common no texts are compared: the fingerprints are the stage's only way to pairs."""
    import corpus_pipeline as C

    docs = documents.limit(80)
    copies = docs.union(docs.withColumns({"doc_id": simhash.F.col("doc_id") + 10**6, "text": simhash.F.concat("text", simhash.F.lit(" more"))}))
    copies = copies.where(simhash.F.size(simhash.F.split("text", " ")) > 30)
    kept = {x.doc_id for x in C.near_dedup(spark, copies, sf).collect()}
    assert kept and max(kept) < 10**6
    monkeypatch.setattr(simhash, "near_bands", lambda nodes, least: nodes.select(simhash.F.col("node").alias("band"), "node").where("false"))
    assert len({x.doc_id for x in C.near_dedup(spark, copies, sf).collect()}) == copies.select("text").distinct().count()


def test_near_dedup_stage_against_all_pairs(spark, sf, documents):
    """The stage keeps the least id of every group of texts at 5-word Jaccard 0.8 or more."""
    import corpus_pipeline as C

    want = jaccard_components(plain_sets([(x.doc_id, x.text) for x in documents.collect()]))
    assert {x.doc_id for x in C.near_dedup(spark, documents, sf).collect()} == {*want.values()}
