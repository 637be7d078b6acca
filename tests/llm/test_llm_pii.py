"""The base kinds against Python's re, and what the trees add."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tagloom.llm import pii, queries
from tagloom.llm.pii_train import luhn

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    number = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number)))
        return 12 <= len(number) <= 19 and total % 10 == 0
    return 9 <= len(number) <= 15 if kind == "phone" else True


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def hold(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [tuple(s) for s in r.base] == want, texts[r.doc_id][:200]
        assert {*want} <= {tuple(s) for s in r.spans}


def test_query_against_brute_force(spark, sf, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op4_pii(spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        want = brute(texts[r.doc_id])
        kinds = [w[3] for w in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(kinds.count, RULES)) and r.base_sha256 == digest(want)
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= {*r.spans.split(",")}


def test_random_marks_and_digits(spark):
    """Texts of the characters that the patterns turn on, where matches touch, overlap and fail."""
    r = random.Random(3)
    texts = {i: "".join(r.choice(r.choice(["0123456789", "+.- ()@", "ab._%é🙂", "4111 "])) for _ in range(r.randint(1, 160))) for i in range(600)}
    texts |= {600 + i: "x" * r.randint(0, 3) + luhn("4" + "".join(r.choice("0123456789") for _ in range(14))) + s for i, s in enumerate(["", "0", "a", ".", "@a.b"] * 8)}
    texts |= {700: "a@b.c_d@e.f", 701: "1.2.3.4.5.6.7.8", 702: "256.1.1.1 0255.0.0.0", 703: "+" * 50 + "1 " * 40, 704: "é" * 9 + " a@b.co"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    hold(pii.find(df).collect(), texts)


def test_very_long_texts_stay_linear(spark):
    """Long runs against brute force where that is still possible; a hundred times as long, by their counts."""
    make = lambda n: {1: "1" * n, 2: "a." * n + "@", 3: "1 " * n, 4: "+1 " * n, 5: "mail a@b.co " * n, 6: "1." * n}
    short = make(1500)
    hold(pii.find(spark.createDataFrame([*short.items()], "doc_id long, text string")).collect(), short)
    rows = pii.find(spark.createDataFrame([*make(60_000).items()], "doc_id long, text string")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect()
    assert {tuple(r) for r in rows} == {(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0), (5, 60_000, 0, 0, 0), (6, 0, 15_000, 0, 0)}


PRIVATE = [
    ("secret", 'config token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'),
    ("secret", "login with password=hunter2secretX9 today"),
    ("phone", "please call (415) 555-2671 after noon"),
    ("id", "her SSN: 078-05-1120 was leaked"),
    ("email", "contact jane.doe [at] example [dot] com soon"),
    ("phone", "reach us under 312.555.0188 or"),
    ("phone", "or 0171 555 2368 in town"),
    ("secret", "with password=correcthorse in the file"),
]
CLEAN = ["version 10.4.2 came out", "see pages 210-215 and section 3", "commit of the long walk in 1999", "order no 12 of 24 items", "the token: the word"]


def test_trees_find_more_and_leave_plain_texts_alone(spark):
    texts = [t for _, t in PRIVATE] + CLEAN
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (kind, _) in enumerate(PRIVATE):
        assert kind in {s.kind for s in rows[i].spans} and not [s for s in rows[i].base if s.kind == kind], texts[i]
    assert not [(texts[i], s) for i, r in rows.items() if i >= len(PRIVATE) for s in r.spans]


def test_redaction_against_plain_version(spark, documents):
    found = pii.find(documents)
    found = found.withColumn("clean", pii.redact(found))
    changed = 0
    for r in found.select("text", "spans", "clean").collect():
        want, done, fused = "", 0, []
        for a, _, b, kind in map(tuple, r.spans):
            if fused and a <= fused[-1][1]:
                fused[-1][1] = max(b, fused[-1][1])
            else:
                fused.append([a, b, kind])
        for a, b, kind in fused:
            want += r.text[done:a] + f"[{kind.upper()}]"
            done = b
        assert r.clean == (want + r.text[done:] if r.text is not None else None)
        changed += bool(fused)
    assert changed


def test_redaction_of_chosen_spans(spark):
    """Touching, nested, equal and overlapping spans, at and across the ends of pieces."""
    r, rows = random.Random(11), []
    for i in range(60):
        text = "".join(r.choice("abé🙂 ") for _ in range(r.choice([5, 100, 4096, 9000])))
        spans = sorted((a, k, min(len(text), a + r.choice([1, 3, 5000])), pii.KINDS[k]) for a, k in ((r.randrange(len(text)), r.randrange(4)) for _ in range(r.choice([0, 1, 5, 600]))))
        rows.append((i, text, spans))
    schema = "id int, text string, spans array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"
    found = spark.createDataFrame(rows, schema)
    for i, clean in found.select("id", pii.redact(found)).collect():
        _, text, spans = rows[i]
        want, far = "", 0
        for a, _, b, kind in spans:
            if not want and not far or a > far:
                want += text[far:a] + f"[{kind.upper()}]"
            far = max(far, b)
        assert clean == want + text[far:]


def test_redaction_of_very_many_spans(spark):
    n = 100_000
    found = spark.range(1).select(F.repeat(F.lit("é a@b.co "), n).alias("text"), F.expr(f"transform(sequence(0L, {n - 1}L), i -> named_struct('start', i * 9 + 2, 'rank', 0, 'stop', i * 9 + 8, 'kind', 'email'))").alias("spans"))
    assert found.select((pii.redact(found) == F.repeat(F.lit("é [EMAIL] "), n)).alias("same")).first().same


def test_awkward_rows(awkward, none):
    rows = pii.find(awkward).collect()
    for r in rows:
        assert [tuple(s) for s in r.base] == brute(r.text)
    assert len(rows) == awkward.count() and pii.find(none).count() == 0


def test_model_was_held_out():
    trained = pii.model()
    assert trained["held_out_log_loss"] < 0.2 and min(trained["held_out_recall"].values()) >= 0.9 and min(trained["held_out_precision"].values()) >= 0.98
