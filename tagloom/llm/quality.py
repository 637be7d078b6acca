"""Quality classification by co-training.

Two logistic classifiers see different views of a document: its text, or its metadata (host, declared
language, length).  Over several rounds each labels the documents of an unlabelled pool that it is
sure of and hands them to the other.  Both are then calibrated on held-out labels, and a third curve,
fitted there too, combines the calibrated views; it scores all documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import as_bytes, map_columns
from tagloom.session import cut

#: Labelled and unlabelled documents that the classifiers are fitted on, about; rounds; what each
#: view hands over a round and class at most, and how sure it has to be; share of held-out good
#: documents that the threshold keeps; bytes of a text split at once; slots of hashed metadata.
LABELLED, POOL, ROUNDS, HANDED, SURE, KEPT, BYTES, SLOTS = 8000, 8000, 4, 400, 0.95, 0.998, 1 << 22, 64

TEXT = 14


def classes() -> np.ndarray:
    """Byte -> lower, upper, digit, white space, sentence mark, other mark, beyond ASCII."""
    out = np.full(256, 5, np.int64)
    out[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
    out[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    out[list(b"0123456789")] = 2
    out[list(b" \t\n\v\f\r")] = 3
    out[list(b".,;:'\"-?")] = 4
    out[128:] = 6
    return out


CLASS = classes()


def text_features(text: bytes) -> list[float]:
    """Shares of character classes, repetition of words and lines, lengths; of the whole text."""
    chars, words, lines = np.zeros(256, np.int64), Counter(), Counter()
    n_words = runs = at = last = 0
    while at < len(text):
        end = at + BYTES
        while end < len(text) and text[end] not in b" \n\t":
            end += 1
        part = text[at:end]
        at = end
        chars += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        own = part.split()
        words.update(own)
        lines.update(x for x in part.split(b"\n") if x.strip())
        n_words += len(own)
        runs += sum(map(bytes.__eq__, own, [last or b"", *own[:-1]]))
        last = own[-1] if own else last
    n, n_lines = max(1, len(text)), sum(lines.values())
    share = np.bincount(CLASS, chars, 7) / n
    w = max(1, n_words)
    top = max(words.values(), default=0) / w
    return [
        *share.tolist(),
        runs / w,
        top,
        len(words) / w ** 0.9,
        (len(text) - int(chars[[9, 10, 11, 12, 13, 32]].sum())) / w / 10,
        1 - len(lines) / max(1, n_lines),
        math.log1p(n_words) / 10,
        float(n_words == 0),
    ]


def meta_features(host: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (SLOTS + 3)
    out[zlib.crc32(f"h{host}".encode()) % SLOTS] = 1.0
    out[zlib.crc32(f"l{lang}".encode()) % SLOTS] += 1.0
    size = math.log1p(max(0, n_chars or 0))
    out[SLOTS:] = [size / 10, (size / 10) ** 2, float(n_chars is None)]
    return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights and, last, the intercept: Newton's method on the penalised log-likelihood."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.ones(len(y)) if w is None else w
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


class View:
    """A standardised logistic classifier."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.beta = logistic((x - self.mean) / self.scale, y)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.beta[:-1] + self.beta[-1], -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


class Model:
    """The two views after co-training, their calibration and the combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS):
        held = np.arange(len(y)) % 4 == 0
        x, pool = (text, meta), (pool_text, pool_meta)
        sets = [([v[~held]], [y[~held]]) for v in x]
        free = np.ones(len(pool_text), bool)
        self.views = [View().fit(v[~held], y[~held]) for v in x]
        self.handed = [0, 0]
        for _ in range(rounds if len(pool_text) else 0):
            chosen = []
            for view, v in zip(self.views, pool):
                p = view.probability(v)
                good, bad = (np.nonzero(free & sure)[0] for sure in (p >= SURE, p <= 1 - SURE))
                good, bad = good[np.argsort(-p[good], kind="stable")][:HANDED], bad[np.argsort(p[bad], kind="stable")][:HANDED]
                chosen.append((np.concatenate((good, bad)), np.concatenate((np.ones(len(good)), np.zeros(len(bad))))))
            for to, (at, label) in ((1, chosen[0]), (0, chosen[1])):
                sets[to][0].append(pool[to][at])
                sets[to][1].append(label)
                self.handed[to] += len(at)
                free[at] = False
            self.views = [View().fit(np.vstack(a), np.concatenate(b)) for a, b in sets]
        raw = [view.raw(v[held]) for view, v in zip(self.views, x)]
        self.curves = [logistic(r[:, None], y[held]) for r in raw]
        both = np.column_stack([r * c[0] + c[1] for r, c in zip(raw, self.curves)])
        self.mix = logistic(both, y[held])
        p = self.score(text[held], meta[held])
        good = np.sort(p[y[held] == 1])
        self.threshold = min(0.5, float(good[int((1 - KEPT) * len(good))])) if len(good) else 0.0

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        both = np.column_stack([view.raw(v) * c[0] + c[1] for view, v, c in zip(self.views, (text, meta), self.curves)])
        return 1 / (1 + np.exp(-np.clip(both @ self.mix[:-1] + self.mix[-1], -30, 30)))


def drawn(rows: DataFrame, key: str, n: int, salt: int) -> DataFrame:
    """About ``n`` rows, by hash of the key; all of them if there are fewer."""
    total = rows.count()
    if total <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1_000_000)) < int(n / total * 1_000_000))


def features_of(docs: DataFrame, text: str, host: str, lang: str, size: str) -> DataFrame:
    """``docs`` with ``__x`` (text view) and ``__z`` (metadata view)."""
    schema = T.StructType([T.StructField("__x", T.ArrayType(T.DoubleType())), T.StructField("__z", T.ArrayType(T.DoubleType()))])
    sent = docs.withColumns({"__b": as_bytes(docs, text), "__h": F.col(host).cast("string"), "__l": F.col(lang).cast("string"), "__n": F.col(size).cast("long")})

    def run(columns):
        texts, hosts, langs, sizes = (c.to_pylist() for c in columns)
        return [[text_features(t) for t in texts], [meta_features(*m) for m in zip(hosts, langs, sizes)]]

    return map_columns(sent, ["__b", "__h", "__l", "__n"], schema, run, drop=("__b", "__h", "__l", "__n"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", lang: str = "lang", size: str = "n_chars", labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """A model fitted on about ``labelled`` labelled and ``pool`` other documents; None without labels
    of both kinds.  The drawn labels, whose number is checked, are broadcast; whole texts are read."""
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(key).agg(F.max("quality").alias("__y"))
    known = cut(drawn(known, key, labelled, 9))
    if known.count() > 2 * labelled:
        raise ValueError("the draw is far larger than asked for")
    marked = docs.join(F.broadcast(known), key, "left")
    total = docs.count()
    share = min(1.0, pool / max(1, total))
    other = F.pmod(F.xxhash64(F.lit(10), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)
    picked = marked.where(F.col("__y").isNotNull() | other).select(F.col(key).alias("__k"), text, host, lang, size, "__y")
    rows = features_of(picked, text, host, lang, size).select("__k", "__y", "__x", "__z").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[2], r[3]))
    own, free = [r for r in rows if r[1] is not None], [r for r in rows if r[1] is None]
    y = np.array([r[1] for r in own], float)
    if len(own) < 8 or len({*y[::4]}) < 2 or len({*np.delete(y, np.s_[::4])}) < 2:
        return None
    block = lambda rs, i, w: np.array([r[i] for r in rs], float).reshape(len(rs), w)
    return Model(block(own, 2, TEXT), block(own, 3, SLOTS + 3), y, block(free, 2, TEXT), block(free, 3, SLOTS + 3))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", lang: str = "lang", size: str = "n_chars", model: Model | None = None) -> DataFrame:
    """``docs`` with ``quality_score`` (of being good) and ``keep``.

    A narrow map once the model is fitted.  Rows are scored one by one: nulls in any column are values
    of their own, empty texts have no words, repeated rows score alike.  Without labels of both kinds
    every score is null and every row kept.  Columns named like the outputs are replaced.
    """
    model = model or train(docs, labels, key, text, host, lang, size)
    if model is None:
        own = [c for c in docs.columns if c.lower() not in ("quality_score", "keep")]
        return docs.select(*[f"`{c}`" for c in own], F.lit(None).cast("double").alias("quality_score"), F.lit(True).alias("keep"))
    schema = T.StructType([T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    sent = docs.withColumns({"__b": as_bytes(docs, text), "__h": F.col(host).cast("string"), "__l": F.col(lang).cast("string"), "__n": F.col(size).cast("long")})

    def run(columns):
        texts, hosts, langs, sizes = (c.to_pylist() for c in columns)
        x = np.array([text_features(t) for t in texts], float).reshape(len(texts), TEXT)
        z = np.array([meta_features(*m) for m in zip(hosts, langs, sizes)], float).reshape(len(texts), SLOTS + 3)
        p = np.round(model.score(x, z), 6)
        return [p.tolist(), (p >= round(model.threshold, 6)).tolist()]

    return map_columns(sent, ["__b", "__h", "__l", "__n"], schema, run, drop=("__b", "__h", "__l", "__n"))
