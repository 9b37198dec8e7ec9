import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafline.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("test", pat_str=T.PATTERN, mergeable_ranks=T.encoder(T.DEFAULT_RANKS).ranks, special_tokens={})


def ids(text):
    import numpy as np

    return np.frombuffer(T.encoder(T.DEFAULT_RANKS).encode(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_reference(reference, text):
    assert ids(text) == reference.encode_ordinary(text)


def test_long_words_and_specials(reference):
    rng = random.Random(1)
    for text in ["a" * 3000, "<|endoftext|> x", "".join(rng.choice("abcß漢​") for _ in range(2000)), "x" * T.SHORT_WORD, "y" * (T.SHORT_WORD + 1), " \n\t  \r\n", "é" * 500]:
        assert ids(text) == reference.encode_ordinary(text)
    enc = T.encoder(T.DEFAULT_RANKS)
    for _ in range(100):
        raw = "".join(rng.choice("abcdeß ñ1漢") for _ in range(rng.randint(1, 300))).encode()
        assert enc._merge_long(raw) == enc._merge_short(raw)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "MEMO_WORDS", 3)
    enc = T.RankEncoder(T.DEFAULT_RANKS)
    enc.encode("one two three four five six")
    assert len(enc) <= 3


def test_rows(spark, reference):
    texts = ["hello world", None, "", " ", "hello world", "z" * 9000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_ids(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(df).collect()} == {i: len(v) for i, v in got.items()}
    assert T.encode_ids(df.limit(0)).collect() == []


def test_decoding_ids_gives_the_texts(spark):
    """Extra columns with clashing names are ignored; null and empty texts both come back empty; repeated rows stay."""
    texts = [(1, "don't  stop"), (2, None), (3, ""), (4, "日本語 ❤ <|endoftext|>"), (4, "日本語 ❤ <|endoftext|>"), (5, "x" * 5000), (6, "\x00﻿​")]
    df = spark.createDataFrame([(i, t, "other") for i, t in texts], "doc_id long, text string, ids string")
    back = T.decode_ids(T.encode_ids(df).withColumn("_ll_ids", F.lit(0)).withColumn("text", F.lit("other")))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((i, t or "") for i, t in texts)
    nothing = spark.createDataFrame([(7, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in T.decode_ids(nothing).collect()] == [(7, "")]
    assert T.decode_ids(nothing.limit(0)).collect() == []
