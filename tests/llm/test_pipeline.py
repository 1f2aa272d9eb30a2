"""Each stage of the pipeline against brute force over what the stage before it kept."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_documents import bench_words, brute_hits, words
from tests.llm.test_nearcopies import brute_kept


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.saved(stage(spark, docs, sf))
        out.append(docs.collect())
        if len(out) < 6:
            assert docs.columns == columns
    return out


def test_toxic(tables, spark, sf):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    left = {r["doc_id"] for r in tables[1]}
    assert len(left & toxic) <= 0.2 * len(toxic) and len(clean - left) <= 0.03 * len(clean)


def test_near_duplicates(tables):
    """The stage takes five words and a similarity of 0.8 or more, over all pairs."""
    assert sorted(r["doc_id"] for r in tables[2]) == brute_kept([(r["doc_id"], r["text"]) for r in tables[1]])


def test_decontamination(tables, spark, sf):
    items = {r["item_id"]: bench_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r["doc_id"] for r in tables[3]} == {r["doc_id"] for r in tables[2] if not brute_hits(r["text"], items)[1]}


def test_mix(tables):
    have, taken = Counter(), Counter()
    texts = {r["doc_id"]: r["text"] for r in tables[3]}
    for r in tables[3]:
        have[r["source"]] += len(words(r["text"]))
    for r in tables[4]:
        taken[r["source"]] += len(words(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    assert abs(sum(taken.values()) - sum(have.values())) <= len(have)
    assert all(taken[s] <= 3 * have[s] for s in taken)


def test_tokens(tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    model, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    rows = [(r["doc_id"], len(ids), ids) for r in tables[4] if (ids := [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1])]
    for i, n, ids in sorted(rows, key=lambda x: x[:2]):
        want.append((i, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += n
    assert sorted(tuple(r) for r in tables[5]) == sorted(want)


def test_run_and_odd_tables(spark, sf):
    frame = spark.createDataFrame([(1, None, None, None, None, 5), (None, "", "en", "a", 0, 6), (None, "", "en", "a", 0, 6), (3, "w " * 9, "en", None, 18, 7)], "doc_id long, text string, lang string, source string, n_chars long, taken int")
    for docs in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_near_duplicates_with_repeated_and_missing_ids(spark, sf):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, long), (5, long), (6, long), (7, "quite another text that shares nothing with it at all here"), (None, "zz yy xx ww vv uu"), (None, "zz yy xx ww vv uu"), (8, "a b c d e f g h")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 5, 7, 8] and out.columns == docs.columns
