"""Counts against the tokenizers library's unigram model."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from cairn.llm import registry, unigram

SMALL = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.0), ("aba", -5.0), ("abab", -8.0), ("▁a", -3.0), ("▁ab", -5.0), ("é", -2.5), ("bé", -4.5), ("cd", -1.0), ("xyz", -30.0)]


def library(pieces):
    made = Tokenizer(Unigram(pieces, 0, False))
    made.pre_tokenizer = Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def same(counter, made, text):
    ids = made.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == (len(ids), ids.count(0)), text


@pytest.fixture(scope="module")
def real():
    pieces, _ = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram.Counter(pieces), library(pieces)


ODD = ["", " ", "  ", "a  b ", "▁", "▁a ▁b", "zzz z\U0001f600\U0001f600 é", "\n\nab\n", "ab" * 4000, "\U0001f600" * 500, "cdc", "c d", "xyzxyxyz"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(real, text):
    same(*real, text)
    same(unigram.Counter(SMALL), library(SMALL), text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abécdxyz ▁q\n", max_size=24))
def test_ties_and_unknowns(text):
    same(_SMALL[0], _SMALL[1], text)


_SMALL = unigram.Counter(SMALL), library(SMALL)


def test_random_vocabularies():
    rng = random.Random(8)
    for _ in range(60):
        words = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(14)} - {"<unk>"}
        pieces = [("<unk>", 0.0), *((w, float(-rng.randrange(4))) for w in sorted(words))]
        counter, made = unigram.Counter(pieces), library(pieces)
        for _ in range(40):
            same(counter, made, "".join(rng.choice("abcd ") for _ in range(rng.randrange(20))))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    pieces, _ = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    if not _REAL:
        _REAL.extend((unigram.Counter(pieces), library(pieces)))
    same(*_REAL, text)


_REAL = []


def test_query_and_edge_rows(spark, sf_dir, real):
    got = {r.doc_id: r for r in registry.op6_unigram_counts(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        assert got[d.doc_id].n_tokens == len(real[1].encode(d.text or "", add_special_tokens=False).ids)
    pieces, _ = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(None, "x"), ("", "y"), ("a b", "z"), ("a b", "z")], "text string, N_Tokens string")
    assert [r.n_tokens for r in unigram.count(df, pieces).collect()] == [0, 0, 2, 2]
    assert unigram.count(df.limit(0), pieces).count() == 0
