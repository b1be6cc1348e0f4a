import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerleaf.llm import bpe, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


def library_ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


def test_digests_equal_the_library(docs, cases):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode_decode(docs, WORDS)).collect())
    want = []
    for i, t in cases:
        ids = library_ids(WORDS, t or "")
        text = LIBRARY[WORDS].decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_counts_equal_the_library(docs, cases):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTES).collect())
    want = [(str(i), len((t or "").encode()), n := len(library_ids(BYTES, t or "")), n > 1024) for i, t in cases]
    assert got == sorted(want)


def test_empty_tables(empty):
    assert bpe.digests(bpe.encode_decode(empty, WORDS)).count() == 0
    assert token_counts.count_tokens(empty, BYTES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encoding_and_decoding(text):
    c = bpe.codec(WORDS)
    ids, decoded = c.encode(text)
    ids = memoryview(ids).cast("i").tolist()
    assert ids == library_ids(WORDS, text)
    assert decoded == c.decode(ids) == LIBRARY[WORDS].decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1'\n\t\r\x1c\x85\xa0é.<|>endoftx"), max_size=80), st.integers(1, 9))
def test_pieces_are_safe(text, size):
    parts = list(token_counts.pieces(text, size))
    assert "".join(parts) == text
    assert sum(len(library_ids(BYTES, p)) for p in parts) == len(library_ids(BYTES, text))


def test_every_byte_has_a_token():
    c = bpe.codec(WORDS)
    assert all(x in c.names.values() and x + c.suffix in c.names.values() for x in c.letters)


def test_no_vocabulary_token_crosses_a_cut():
    c = bpe.codec(WORDS)
    assert all(len(c.fragments(t.removesuffix(c.suffix))) == 1 for t in list(c.names.values())[:5000] if t not in c.special)


@pytest.mark.parametrize("size", [2, 5])
def test_a_small_cache_gives_the_same(size, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", size)
    c = bpe.Codec(WORDS)
    text = "one two three four five six seven one two três über"
    assert memoryview(c.encode(text)[0]).cast("i").tolist() == library_ids(WORDS, text)
