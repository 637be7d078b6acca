"""Media columns: bytes stored as WAV, read by the wave module, fingerprinted by spectral peaks.

A short-time Fourier transform of the samples gives frames; local maxima of their power are peaks;
each peak is paired with the peaks that follow it closely, and a pair (bin, bin, frame distance) with
its anchor's frame makes one time-coded entry: frame << 32 | bin1 << 20 | bin2 << 8 | distance.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import as_bytes, map_columns

UNIT = 64
RATE, WINDOW, HOP = 8000, 256, 128
#: Frames of one transform, which bounds its memory whatever the length; peaks per frame; pairs per peak; frames between them.
BLOCK, PEAKS, FAN, REACH = 1024, 3, 3, 16

MEDIA = T.StructType([T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())])
FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("fingerprint", T.ArrayType(T.LongType())),
    ]
)


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM, one sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def frames_of(samples: np.ndarray) -> np.ndarray:
    """Overlapping windows; the last is filled up with silence, so that every sample is in one."""
    n = max(1, -(-max(0, len(samples) - WINDOW) // HOP) + 1)
    short = (n - 1) * HOP + WINDOW - len(samples)
    if short:
        samples = np.concatenate((samples, np.full(short, 128, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]


TAPER = np.hanning(WINDOW).astype(np.float32)


def peaks_of(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of up to PEAKS local maxima a frame: the largest power, ties to the lower bin.

    Powers are compared as integers after rounding to 1/16 dB-like steps of log2, which makes equal
    payloads give equal peaks on any machine.
    """
    x = (frames.astype(np.float32) - 128) * TAPER
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    level = np.rint(16 * np.log2(1 + power)).astype(np.int32)
    inner = level[:, 1:-1]
    top = (inner > level[:, :-2]) & (inner >= level[:, 2:])
    ranked = np.where(top, inner.astype(np.int64) << 8 | np.arange(255 - 1, 255 - 1 - inner.shape[1], -1), 0)
    best = np.partition(ranked, ranked.shape[1] - PEAKS, axis=1)[:, -PEAKS:]
    best.sort(axis=1)
    best = best[:, ::-1]
    at, col = np.nonzero(best)
    return at, 255 - (best[at, col] & 255)


def fingerprint(payload: bytes) -> np.ndarray:
    frames = frames_of(np.frombuffer(payload, np.uint8))
    parts = [peaks_of(frames[i : i + BLOCK]) for i in range(0, len(frames), BLOCK)]
    at = np.concatenate([p[0] + i * BLOCK for i, p in enumerate(parts)])
    tone = np.concatenate([p[1] for p in parts])
    out = []
    for step in range(1, FAN * PEAKS + 1):
        gap = at[step:] - at[:-step]
        ok = (gap > 0) & (gap <= REACH)
        out.append((at[:-step].astype(np.int64) << 32 | tone[:-step].astype(np.int64) << 20 | tone[step:].astype(np.int64) << 8 | gap)[ok])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``media`` (a WAV file) and ``n_bytes`` (unpadded) in place of the text.

    A narrow map.  Null and empty texts are stored as 64 zero samples; repeated rows stay; columns
    of ``docs`` named like the outputs are replaced.
    """

    def run(columns):
        texts = columns[0].to_pylist()
        return [[to_wav(pad(t)) for t in texts], [len(t) for t in texts]]

    sent = docs.withColumn("__bytes", as_bytes(docs, text))
    return map_columns(sent, ["__bytes"], MEDIA, run, drop=("__bytes", text), rows=128)


def read_back(stored: DataFrame, media: str = "media") -> DataFrame:
    """Digests and the time-coded fingerprint of a column of WAV files, in place of that column.

    Texts of any length are transformed block by block.  A null file gives nulls; one that is no
    8-bit mono WAV raises.
    """

    def run(columns):
        rows = []
        for m in columns[0].to_pylist():
            if m is None:
                rows.append((None,) * 6)
                continue
            payload = from_wav(m)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), fingerprint(payload)))
        return [list(c) for c in zip(*rows)]

    return map_columns(stored, [media], FEATURES, run, drop=(media,), rows=128)


def feature_digest(column: str = "fingerprint") -> F.Column:
    """The fingerprint's number of entries and their hash, as a short string."""
    return F.concat_ws(":", F.size(column).cast("string"), F.lower(F.hex(F.xxhash64(F.col(column)))))
