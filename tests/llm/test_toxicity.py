"""The subsequence kernel against counting, and the classifier on held-out labels."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tieweave.llm import toxicity

DATA = "/root/testdata/sf0.1"


def brute_features(word):
    marked, out = f"^{word}$", {}
    for i, j, k in itertools.combinations(range(len(marked)), 3):
        if k - i <= toxicity.REACH:
            key = marked[i] + marked[j] + marked[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
    return out


def brute_kernel(a, b):
    x, y = brute_features(a), brute_features(b)
    norm = lambda f: sum(v * v for v in f.values()) ** 0.5
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm(x) / norm(y)


def test_kernel_against_counting():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdexyz", k=rng.randint(1, 12))) for _ in range(60)] + ["idiot", "idixot", "i", "ab"]
    marks = toxicity.Landmarks(words[:20])
    got = marks.exact(words)
    want = np.array([[brute_kernel(a, b) for b in words[:20]] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    at, rows = marks.kernel(words)
    assert at.tolist() == np.flatnonzero(want.max(axis=1) >= 0.5).tolist() and np.allclose(rows, want[at], atol=1e-5)


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs.select("doc_id", "text"), labels.where(toxicity.crc_mod("doc_id", 5) != 0).select("doc_id", "toxic"))


def scores(spark, model, texts):
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, toxic_score string")
    return [r["toxic_score"] for r in toxicity.score(frame, model).orderBy("doc_id").collect()]


def test_held_out_recall(spark, model):
    """Of the 97 toxic held-out documents 6 have no word that tells them from clean ones (their labels differ at random), so 0.94 is the most."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = toxicity.score(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), model).select("doc_id", "toxic_score").collect()
    held = [(labels[r["doc_id"]], r["toxic_score"] >= 0.5) for r in rows if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_disguised_insults(spark, model):
    plain = "The tion and this of you are that for ndwas ering."
    disguised = ["idiot", "idi-ot", "idixot", "id.iot", "i d i o t", "IDIOT", "moron", "morron", "m-o-r-o-n", "worthless", "worth_less", "wortthless"]
    found = scores(spark, model, [f"{plain} You {w} and {w}. {plain}" for w in disguised])
    assert min(found) >= 0.5, dict(zip(disguised, found, strict=True))
    assert max(scores(spark, model, [plain, f"{plain} {plain}"])) < 0.5


def test_odd_texts_and_tables(spark, model):
    found = scores(spark, model, [None, "", " \n ", "...", "idiot " * 50_000, "a b c d", "same", "same"])
    assert all(0 <= x <= 1 for x in found) and found[0] == found[1] < 0.5 > found[2] and found[4] >= 0.5 and found[6] == found[7]
    docs = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (None, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("toxic_score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), none).count() == 0
    both = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, both).count() == 4
