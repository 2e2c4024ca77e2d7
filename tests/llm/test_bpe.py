from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmuro.llm import bpe

PATH = bpe.vocabulary_path()
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=bpe.PIECES, mergeable_ranks=bpe.encoder(PATH).tokens, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same = tiktoken.Encoding("plain", pat_str=bpe.PIECES, mergeable_ranks=bpe.encoder(PATH).tokens, special_tokens={})
    text = text.encode("utf-8", "replace").decode()
    assert bpe.encoder(PATH).encode(text) == same.encode_ordinary(text)
    assert bpe.encoder(PATH).decode(bpe.encoder(PATH).encode(text)) == text


def test_merged_words(plain):
    rng = random.Random(4)
    letters = "aeiounrstlmdh"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert bpe.encoder(PATH).encode(text) == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, " " * 5000, "é" * 4000, "<|endoftext|>", "the" * 3000, "\n\n\t  x", "don't we'll I'VE", "漢字かな交じり😀👩‍🚀"])
def test_long_and_odd_texts(plain, text):
    assert bpe.encoder(PATH).encode(text) == plain.encode_ordinary(text)


def test_same_ids_as_the_description_file():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("Hello there, it's 12:30!", " leading", "naïve café – “quotes”", "<|endoftext|> x"):
        assert bpe.encoder(PATH).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_another_vocabulary():
    path = bpe.vocabulary_path("byte_bpe_multi_50k")
    own = bpe.encoder(path)
    same = tiktoken.Encoding("multi", pat_str=bpe.PIECES, mergeable_ranks=own.tokens, special_tokens={})
    for text in ("Привет, как дела? Größe", "el niño y la cigüeña", "音声 スタジオ"):
        assert own.encode(text) == same.encode_ordinary(text)


def test_column(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, " "), (5, "x" * 300_000), (1, "Hello there")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df, "doc_id", "text").collect())
    want = bpe.encoder(PATH)
    assert got == sorted((i, want.encode(t)) for i, t in rows)
    assert dict(got)[2] == dict(got)[3] == []
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    back = df.select("text", bpe.decoded(bpe.token_ids(F.col("text"), PATH), PATH).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in back)
