"""Token counts against the libraries."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tieweave.llm import counts

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
PARTS = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\x1f", " ", "é", "é", "Σ", "ΑΣ", "1", "23", "!", "?!", "<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "日本", "\x85", "\r\n", "İ", "▁", "\x00", "'re", "hello", "World", "tokenization", "　", "ﬁ", "</w>", "🙂"]


def library(name):
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda text: len(model.encode(text))
    model = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)]


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(spark, odd, name):
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    count = library(name)
    got = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(df, public_tokenizers.path(name)).collect()}
    assert got == {i: count(t) for i, t in enumerate(odd)}


@pytest.mark.parametrize("name", FILES)
def test_proven_tokens_are_whole(name):
    own = counts.counter(public_tokenizers.path(name))
    whole = own.proven()
    assert len(whole) > 10_000
    if name == "word_bpe_49k.json":
        count = library(name)
        plain = [s for s in whole if re.fullmatch("[a-z]+", s)]
        assert len(plain) > 5000 and all(count(s) == 1 for s in plain)


def test_query(spark, sf):
    count = library("word_bpe_49k.json")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: (len(t.encode()), n := count(t), n > 2048) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts.op13_token_counts(spark, sf).collect()} == want


@pytest.mark.parametrize("name", FILES)
def test_odd_tables(spark, name):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "one two", "y"), (3, "word " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = counts.count_tokens(df, public_tokenizers.path(name), most_pieces=2)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    count = library(name)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect()) == sorted((len((t or "").encode()), n := count(t or ""), n > 2048) for _, t, _ in rows)
    assert counts.count_tokens(df.limit(0), public_tokenizers.path(name)).count() == 0
