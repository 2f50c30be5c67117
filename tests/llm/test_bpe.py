"""Encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(bpe.Vocabulary.from_json(f.read()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["", " ", "  ", "\n\n a", "x\u0085 y", "it's we'll 'S", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "a" * 5000, " " * 3000, "\U0001f600é中　", "\x00\x1c\t", "ab" * 2000 + "!"]


def same(codec, library, text):
    expected = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == expected
    assert codec.decode(packed).decode() == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, text):
    same(codec, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, library, text):
    same(codec, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeitnos hrd'\n", max_size=60))
def test_wordlike_text(codec, library, text):
    same(codec, library, text)


def test_long_text_in_slices(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 64)
    monkeypatch.setattr(bpe, "SLICE_IDS", 16)
    same(codec, library, "The theory, of  slices \n\n isn't hard. " * 50)


def test_incomplete_bytes_decode_with_replacement(codec, library):
    ids = library.encode("é", add_special_tokens=False).ids
    half = [i for i, t in enumerate(codec.tokens) if t == "é".encode()[:1]]
    for x in (half, half + ids, ids + half + half):
        assert codec.decode(np.array(x, "<u4").tobytes()).decode() == library.decode(x, skip_special_tokens=False)


def test_memo_generations(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 8)
    monkeypatch.setattr(bpe, "PAIR_ENTRIES", 8)
    same(codec, library, " ".join(f"word{i} tion{i % 7}" for i in range(300)))


def test_operators_on_frames(spark, library):
    rows = [(i, t, "kept", "clash") for i, t in enumerate([None, *ODD])]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, N_TOKENS string")
    shared = bpe.load(spark, PATH)
    coded = bpe.decode(bpe.encode(df, shared), shared).collect()
    assert len(coded) == len(rows)
    for r in coded:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") and r.extra == "kept"
    digests = bpe.round_trip(df, shared)
    assert digests.columns == ["doc_id", "text", "extra", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in digests.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), shared).count() == 0


def test_query_covers_every_document(spark, sf_dir, library):
    got = {r.doc_id: r for r in registry.op1_bpe_round_trip(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
