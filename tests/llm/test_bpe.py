"""Operator 11 against the library itself: by words, by tree concatenation, odd tables."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from causalake.llm import bpe
from tests.conftest import rows

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "Hello  WORLD's\r\n\x0b\x85x　y\xa0z", "é ́ q̣̇", "<|startoftext|>a<|endoftext|>", "x<|endoftext|>'s", "\x1c\x1d", "İstanbul ΑΣ ǅ ﬁ", "漢字かな交じり文", "👩‍👩‍👧 🇫🇷", "12 345'll", "　", "a\x00b", "</w> a</w>"]


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(texts):
    return [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def by_tree(text):
    return bpe.concatenated([(k, bpe.leaf_ids(k, s, PATH)) for k, s in bpe.leaves(text, PATH)], PATH)


def by_words(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(pa.array(texts, pa.string()), PATH)]


def long_texts(n):
    r = random.Random(5)
    words = "the internationalisation of ab aab abab nationality therein".split()
    yield "a" * n
    yield "".join(r.choice("ab") for _ in range(n))
    yield "".join(r.choice(words) for _ in range(n // 5))
    yield "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    yield "".join(r.choice("!?.,-") for _ in range(n))
    yield "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(n))
    yield "é" * n + "<|endoftext|>" + "ß" * n + "　" + "ё" * n
    yield " ".join(r.choice(words) for _ in range(n // 3)) + " " + "".join(r.choice("thein") for _ in range(n)) + " end"


def test_words_equal_library():
    assert by_words(ODD) == ids_of(ODD)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_by_words(text):
    assert by_words([text]) == ids_of([text])


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abeinst'1漢é! <|>"), max_size=120), st.integers(1, 9))
def test_any_text_by_tree(text, leaf):
    held, bpe.LEAF = bpe.LEAF, leaf
    try:
        assert by_tree(text) == ids_of([text])[0]
    finally:
        bpe.LEAF = held


@pytest.mark.parametrize("leaf", [1, 2, 7, 100])
def test_joins_are_exact(monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    for text in long_texts(1500):
        assert by_tree(text) == ids_of([text])[0]


def test_cache_of_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    enc = bpe.Encoder(PATH)
    for _ in range(3):
        for text in ("one two three four", "five six one", "two seven"):
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.words(text.split())] == ids_of(text.split())
    assert len(enc.new) <= 4 + 3 and len(enc.old) <= 4 + 3


def test_decode_equals_library():
    lists = [*ids_of(ODD), [49406, 5, 49407], [], [320, 70_000]]
    held = pa.array([np.array(x, "<u4").tobytes() for x in lists], pa.binary())
    assert bpe.decode_ids(held, PATH).to_pylist() == [library().decode(x, skip_special_tokens=False) for x in lists]


def test_operator_on_odd_and_long_rows(spark):
    texts = [*ODD, None, *long_texts(20_000)]
    texts += [texts[-1]] * 3
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, _k string").repartition(3)
    out = bpe.decoded(bpe.encoded(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "_k", "ids", "n_tokens", "decoded"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(ids_of([t or "" for t in texts])):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want), i
        assert got[i].decoded == library().decode(want, skip_special_tokens=False) and got[i].text == texts[i]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decoded(bpe.encoded(df, PATH), PATH).collect() == []


def test_query_equals_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, ids in zip(docs, ids_of([d.text or "" for d in docs]), strict=True):
        text = library().decode(ids, skip_special_tokens=False) if len(want) < 20 else " ".join(library().id_to_token(i) for i in ids)
        want.append((hashlib.sha256(text.encode()).hexdigest(), d.doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids)))
    assert rows(bpe.op11_bpe(spark, sf)) == sorted(want, key=str)
