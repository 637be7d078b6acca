"""Token counts and the byte-level BPE round trip against the two libraries."""

import base64
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import bpe_files, queries
from tagloom.llm.token_counts import count_tokens, counter, with_limit
from tagloom.llm.tree_bpe import Codec, codec, decode, encode

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXT = st.text(st.one_of(st.characters(), st.sampled_from(" \t\n\r'sreaht.1 　\x1c\x85")), max_size=80)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def valid(s):
    return s.encode("utf-8", "replace").decode()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_any_text(library, tik, text):
    text = valid(text)
    assert counter(JSON)(text) == len(library.encode(text, add_special_tokens=False).ids)
    ids = codec(RANKS).encode(text).tolist()
    assert ids == tik.encode_ordinary(text)
    assert codec(RANKS).decode(ids) == text.encode()


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_small_leaves_join_right(tik, leaf):
    """Joins of tiny halves give what the library gives, also in long runs and where tokens overlap."""
    code = Codec(RANKS, leaf)
    for s in ["a" * 300, "ab" * 200, "strawberrying" * 30, "=" * 1000, "0" * 257, "Donaudampfschifffahrt" * 9, "漢字" * 40, "aaaaab" * 50]:
        assert code.tree(s.encode()) == tik._encode_single_piece(s), s[:20]


def test_special_strings_are_one_token(library):
    for s in ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|><|endoftext|> ", "<|endoftext|", "x <|ENDOFTEXT|>"]:
        assert counter(JSON)(s) == len(library.encode(s, add_special_tokens=False).ids)


def test_blocks_cut_at_safe_places(monkeypatch, library, tik):
    monkeypatch.setattr(bpe_files, "BLOCK", 7)
    for s in ["aa bb  cc   dd e f g\n\n h i j k l m ", "x" * 50 + " y" * 30, " " * 40, "it's  we'll \t x " * 9]:
        assert "".join(bpe_files.blocks(s)) == s
        assert counter(JSON)(s) == len(library.encode(s, add_special_tokens=False).ids)
        assert codec(RANKS).encode(s).tolist() == tik.encode_ordinary(s)


def test_queries_give_the_libraries_figures(spark, sf, documents, library, tik):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    counted = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    trip = {r.doc_id: r for r in queries.op7_bpe_round_trip(spark, sf).collect()}
    assert counted.keys() == trip.keys() == texts.keys()
    for i, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len(text.encode()), n, n > 1024)
        ids = tik.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (trip[i].n_tokens, trip[i].ids_sha256, trip[i].decoded_sha256) == (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())


def test_awkward_rows(awkward, none, library, tik):
    out = with_limit(count_tokens(awkward))
    assert {"doc_id", "n_bytes", "n_tokens", "over_limit", "media"} <= {*out.columns} and "N_TOKENS" not in out.columns
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect()]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()) == Counter(want)
    back = decode(encode(awkward)).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((r.doc_id, (r.text or "").encode()) for r in awkward.collect())
    assert count_tokens(none).count() == 0 and decode(encode(none)).count() == 0
