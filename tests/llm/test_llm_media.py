"""WAV columns against a plain version of the contract, and the fingerprints' structure."""

import hashlib
import io
import wave
import zlib
from collections import Counter

import numpy as np

from tagloom.llm import media, queries


def plain(text):
    raw = (text or "").encode()
    payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
    return payload, len(raw)


def test_query_against_plain_version(spark, sf, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op3_media(spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    feature = {}
    for r in rows:
        payload, n = plain(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert feature.setdefault(texts[r.doc_id], r.feature) == r.feature


def test_wav_is_read_by_the_wave_module():
    payload = bytes(range(256)) * 3
    with wave.open(io.BytesIO(media.to_wav(payload))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, len(payload))
        assert w.readframes(len(payload)) == payload == media.from_wav(media.to_wav(payload))


def test_fingerprint_of_two_tones():
    """The bins of two pure tones are among the peaks of every frame; entries are in time order."""
    t = np.arange(media.WINDOW * 20)
    wave_ = 128 + 50 * np.sin(2 * np.pi * t * 20 / media.WINDOW) + 50 * np.sin(2 * np.pi * t * 60 / media.WINDOW)
    prints = media.fingerprint(np.rint(wave_).astype(np.uint8).tobytes())
    bins = Counter(x for p in prints.tolist() for x in (p >> 20 & 0xFFF, p >> 8 & 0xFFF))
    assert {20, 60} <= {b for b, _ in bins.most_common(media.PEAKS)}
    assert (np.diff(prints >> 32) >= 0).all()


def test_blocks_do_not_change_the_fingerprint(monkeypatch):
    payload = np.random.default_rng(1).integers(0, 256, 64 * 700, dtype=np.uint8).tobytes()
    whole = media.fingerprint(payload)
    monkeypatch.setattr(media, "BLOCK", 13)
    assert np.array_equal(whole, media.fingerprint(payload))


def test_shifted_copy_shares_its_landmarks():
    r = np.random.default_rng(2).integers(0, 256, 128 * 300, dtype=np.uint8).tobytes()
    code = lambda p: Counter((x & 0xFFFFFFFF) for x in media.fingerprint(p).tolist())
    a, b = code(r), code(r[128 * 40 :])
    assert sum((a & b).values()) > 0.95 * sum(b.values())


def test_awkward_rows(awkward, none):
    rows = media.read_back(media.store(awkward)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in rows) == Counter((r.doc_id, n, hashlib.sha256(p).hexdigest()) for r in awkward.collect() for p, n in [plain(r.text)])
    assert media.read_back(media.store(none)).count() == 0


def test_null_files_give_nulls(spark):
    (row,) = media.read_back(spark.createDataFrame([(1, None)], "id int, media binary")).collect()
    assert row.payload_sha256 is None and row.fingerprint is None
