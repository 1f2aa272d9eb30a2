"""Repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from tieweave.llm import suffix


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if n[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_expansion_against_counting():
    rng = random.Random(1)
    for least in (8, 9, 20, 40):
        strings = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 120))).encode() for _ in range(12)]
        strings += [strings[0][:60] + strings[1][:50], strings[2], b"a" * 90, strings[3] + strings[4]]
        n = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        for s, flag in zip(strings, suffix.repeated_starts(strings, least), strict=True):
            assert flag.tolist() == [n[s[i : i + least]] > 1 for i in range(len(s) - least + 1)]


def rows(rng):
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(120), prose(700)
    texts = [prose(rng.randint(1, 60)) + " " + passage + " " + prose(rng.randint(1, 60)) for _ in range(25)]
    texts += [long, long, long[:2000] + "x" + long[2001:], prose(90), None, "", "ab" * 900, passage, prose(5), "z" * 399, "y" * 401, prose(50) + long[1000:1401]]
    return texts


@pytest.mark.parametrize("shard", [1_000_000, 3_000])
def test_remove_repeats(spark, shard):
    texts = rows(random.Random(2))
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_spans string, a int")
    got = {r["doc_id"]: r for r in suffix.remove_repeats(frame, shard=shard).collect()}
    for i, want in enumerate(brute(texts, 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == want[3] and r["a"] == 7


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d["doc_id"] for d in docs], brute([d["text"] for d in docs], 400), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op4_suffix(spark, sf).collect()}
    assert got == want and sum(v[1] for v in want.values())


def test_odd(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, ""), (1, "q" * 500), (1, "q" * 500)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix.remove_repeats(nulls).collect()) == [0, 0, 500, 500]
