"""Trains the boosted trees of ``pii.py`` on generated examples and writes pii_model.json.

    python -m tagloom.llm.pii_train

Examples are texts with one labelled string among invented words: private ones of many formats, and
look-alikes (versions, dates, prices, checksums after such words, long words with a digit).  Candidates
and features come from the library's own plan, so training and use see the same numbers.  Trees are
boosted on the logistic loss over six tenths of the examples; over two tenths a logistic curve is fitted
to the sums, and each kind gets the lowest threshold that reaches PRECISION there; recall, precision and
log loss are those of the last two tenths, which nothing else has seen.  A candidate is private if it
covers nearly all of a private string; one that covers some of it is no example of either kind.
"""

from __future__ import annotations

import json
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm.pii import FEATURES, KINDS, candidates, features
from tagloom.session import local_session

N, SEED, ROUNDS, DEPTH, RATE, LEAST, PRECISION = 24_000, 7, 60, 3, 0.3, 20, 0.995
COVERED = 0.8
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve el ra la ón que ción ment eux auf sch keit".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def luhn(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def private(r: random.Random) -> tuple[str, str]:
    """(what stands before, the private string)."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    x = lambda n, s="0123456789abcdef": "".join(r.choice(s) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    cue = lambda *w: r.choice(["", "", *w])
    return r.choice(
        [
            lambda: (cue("password=", "pwd: "), x(r.randint(12, 24))),
            lambda: ("", f"password={x(r.randint(8, 24), base64)}"),
            lambda: ("", f"{r.choice(['password', 'pwd', 'secret', 'token'])}={x(r.randint(8, 20), 'abcdefghijklmnopqrstuvwxyz')}"),
            lambda: ("", f'{r.choice(["token", "secret", "api_key"])} = "{x(r.choice([24, 32, 40, 64]))}'),
            lambda: (cue('token = "', "key: ", "Bearer "), x(r.choice([32, 40, 64]))),
            lambda: (cue("key ", "aws "), "AKIA" + x(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")),
            lambda: (cue("token ", "auth: "), r.choice(["ghp_", "sk-", "xoxb-", ""]) + x(r.randint(24, 40), base64)),
            lambda: (cue("call ", "tel. ", "phone: "), f"({d(3)}) {d(3)}-{d(4)}"),
            lambda: (cue("call ", "tel ", "fax: "), f"{r.randint(2, 9)}{d(2)}{(s := r.choice('-. '))}{d(3)}{s}{d(4)}"),
            lambda: (cue("tel ", "ring "), f"0{d(3)} {d(3)} {d(4)}"),
            lambda: (cue("tel ", "mobile "), "0" + d(1) + "".join(" " + d(2) for _ in range(4))),
            lambda: (cue("card ", "visa "), " ".join([d(4), d(4), d(4), d(4)])),
            lambda: (cue("card ", "card no "), (s := luhn("4" + d(14)))[:4] + "." + s[4:8] + "." + s[8:12] + "." + s[12:]),
            lambda: (cue("mail ", "contact "), f"{word(r)}{r.choice(['', '.'])}{word(r)} {r.choice(['at', '[at]', '(at)'])} {word(r)}{r.choice([' dot ', ' [dot] ', '.'])}{r.choice(['com', 'org', 'net'])}"),
            lambda: (cue("ssn ", "SSN: "), f"{d(3)}-{d(2)}-{d(4)}"),
            lambda: (cue("IBAN "), r.choice(["DE", "FR", "ES"]) + d(2) + "".join(" " + d(4) for _ in range(r.randint(4, 5))) + " " + d(2)),
            lambda: (cue("host "), ":".join(x(r.randint(1, 4)) for _ in range(8))),
            lambda: (cue("mac "), ":".join(x(2) for _ in range(6))),
        ]
    )()


def plain(r: random.Random) -> tuple[str, str]:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    x = lambda n, s="0123456789abcdef": "".join(r.choice(s) for _ in range(n))
    cue = lambda *w: r.choice(w)
    long_word = lambda: "".join(word(r) for _ in range(r.randint(3, 8)))
    return r.choice(
        [
            lambda: (cue("version ", "release ", ""), ".".join(d(r.randint(1, 2)) for _ in range(3))),
            lambda: ("", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {d(4)}"),
            lambda: ("", f"{r.randint(1900, 2030)} {d(3)} {d(4)}"),
            lambda: (cue("pages ", "page ", "section "), f"{d(3)}-{d(3)}-{d(4)}"),
            lambda: (cue("isbn ", "issn ", "serial no ", "order no ", "part "), f"{d(3)}-{d(3)}-{d(4)}"),
            lambda: (cue("commit ", "sha ", "md5 ", "checksum ", "rev "), x(r.choice([12, 32, 40]))),
            lambda: ("", long_word() + d(r.randint(1, 2))),
            lambda: ("", f"{long_word()}/{long_word()}-{d(1)}"),
            lambda: ("", f"{long_word()}-{d(4)}"),
            lambda: ("", f"{r.choice(['chapter', 'figure', 'item', 'level'])}_{word(r)}_{word(r)}_{d(1)}"),
            lambda: ("", f"{d(1)},{d(3)},{d(3)} and {d(4)} {d(4)}"),
            lambda: (cue("item ", "order ", "model "), d(r.randint(10, 12))),
            lambda: ("", f"{word(r)} at {word(r)} {word(r)} dot"),
            lambda: ("", f"met at {word(r)}.{word(r)}"),
            lambda: ("", f"{word(r)} at {word(r)}. {word(r).title()}"),
            lambda: ("", ".".join(str(r.randint(100, 255)) for _ in range(4))),
            lambda: (cue("license ", "licence "), f"CC-BY-NC-SA-{d(1)}.{d(1)}"),
            lambda: (cue("of "), f"{r.randint(1000, 2030)} {r.randint(1000, 2030)} {r.randint(1000, 2030)}"),
            lambda: ("", r.choice(["token: the ", "secret: of ", "key = none "]) + word(r)),
            lambda: ("", r.choice(["token: ", "the secret: ", "credentials: "]) + long_word()),
            lambda: ("", f"look at {word(r)} {r.choice(['com', 'org'])}{word(r)}.{word(r)}"),
            lambda: ("", f"{d(2)}:{d(2)}:{d(2)}"),
            lambda: ("", "-" * r.randint(8, 30) + d(1)),
            lambda: ("", f"https/{word(r)}/{r.randint(2000, 2030)}/{r.randint(10, 12)}/{word(r)}-{word(r)}-{word(r)}"),
        ]
    )()


def examples() -> list[tuple[int, int, str, int, int]]:
    """(id, label, text, start, stop) of the labelled string, in code points."""
    r, rows = random.Random(SEED), []
    for i in range(N):
        label = i % 2
        cue, hit = private(r) if label else plain(r)
        left = " ".join(word(r) for _ in range(r.randint(0, 6)))
        before = (left + " " if left else "") + cue
        after = r.choice(["", " ", ", ", ". ", '" ']) + " ".join(word(r) for _ in range(r.randint(0, 5)))
        rows.append((i, label, before + hit + (after if after[:1] in ("", " ", ",", ".", '"') else " " + after), len(before), len(before) + len(hit)))
    return rows


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    value = float(RATE * g.sum() / (h.sum() + 1))
    if depth == 0 or len(x) < 2 * LEAST:
        return round(value, 6)
    best, top = None, 1e-3
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ok = np.nonzero(v[:-1] < v[1:])[0]
        ok = ok[(ok >= LEAST - 1) & (ok < len(v) - LEAST)]
        if len(ok):
            gain = cg[ok] ** 2 / (ch[ok] + 1) + (cg[-1] - cg[ok]) ** 2 / (ch[-1] - ch[ok] + 1) - whole
            k = int(np.argmax(gain))
            if gain[k] > top:
                top, best = gain[k], (f, float((v[ok[k]] + v[ok[k] + 1]) / 2))
    if best is None:
        return round(value, 6)
    f, at = best
    go = x[:, f] <= at
    return [FEATURES[f], at, grow(x[go], g[go], h[go], depth - 1), grow(x[~go], g[~go], h[~go], depth - 1)]


def apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    f, at, left, right = tree
    return np.where(x[:, FEATURES.index(f)] <= at, apply(left, x), apply(right, x))


def curve(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        g = np.array([((y - p) * raw).sum() - 0.01 * (a - 1), (y - p).sum()])
        w = p * (1 - p)
        hess = np.array([[(w * raw**2).sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return round(float(a), 6), round(float(b), 6)


def train(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, fold: np.ndarray) -> dict:
    """``fold``: tenths of the examples; 0 to 5 grow trees, 6 and 7 calibrate, 8 and 9 test."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    fit, held, test = fold < 6, (fold >= 6) & (fold < 8), fold >= 8
    raw, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = sigmoid(raw[fit])
        trees.append(grow(x[fit], y[fit] - p, p * (1 - p), DEPTH))
        raw += apply(trees[-1], x)
    a, b = curve(raw[held], y[held])
    p, thresholds, recall, precision = sigmoid(a * raw + b), {}, {}, {}
    for kind in KINDS:
        mine = held & (kinds == kind)
        cuts = [c for c in np.linspace(0.5, 0.99, 50) if (mine & (p >= c)).any() and y[mine & (p >= c)].mean() >= PRECISION]
        thresholds[kind] = round(float(min(cuts)), 3) if cuts else 0.99
        chosen, private_ = p >= thresholds[kind], test & (kinds == kind) & (y == 1)
        recall[kind] = round(float(chosen[private_].mean()), 4)
        precision[kind] = round(float(y[test & (kinds == kind) & chosen].mean()), 4)
    loss = -np.mean(np.log(np.where(y[test] == 1, p[test], 1 - p[test]) + 1e-12))
    return {"base": 0.0, "trees": trees, "calibration": [a, b], "thresholds": thresholds, "held_out_recall": recall, "held_out_precision": precision, "held_out_log_loss": round(float(loss), 5)}


def main() -> None:
    spark = local_session(4)
    rows = examples()
    docs = spark.createDataFrame(rows, "id long, label int, text string, a long, b long").repartition(16)
    seen = candidates(docs).select("id", "label", "a", "b", F.explode("__more").alias("c"))
    seen = seen.select("id", "label", "a", "b", F.col("c.kind").alias("kind"), F.col("c.start").alias("s"), F.col("c.stop").alias("e"), F.struct(*features(F.col("c"))).alias("f"))
    got = seen.select("id", "label", "a", "b", "kind", "s", "e", *[F.col(f"f.{n}").alias(n) for n in FEATURES]).toPandas()
    inside = np.minimum(got.b, got.e) - np.maximum(got.a, got.s)
    touches = (got.label == 1) & (inside > 0)
    private_ = touches & (inside >= 0.5 * (got.e - got.s)) & (inside >= COVERED * (got.b - got.a))
    clear = private_ | ~touches
    got, y = got[clear], private_[clear].to_numpy(float)
    trained = train(got[FEATURES].to_numpy(float), y, got.kind.to_numpy(), (got.id // 2 % 10).to_numpy())
    Path(__file__).with_name("pii_model.json").write_text(json.dumps(trained, indent=None, separators=(",", ":")) + "\n")
    print(len(got), y.mean(), {k: v for k, v in trained.items() if k != "trees"})


if __name__ == "__main__":
    main()
