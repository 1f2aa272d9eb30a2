"""Every document is held against a band, at every size of its class, and copies have one vote."""

import random

import pytest

from tieweave.llm import quality


@pytest.fixture(scope="module")
def judged(spark):
    import public_tokenizers

    rng = random.Random(7)
    syllables = "the of and to in is was for that with as on by at from his her they were this have not are but had".split()
    good = lambda n: " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))
    junk = lambda n: " ".join("".join(chr(rng.randrange(0x12000, 0x12300)) for _ in range(4)) for _ in range(n))
    copied = junk(70)
    rows = [(i, "en", good(rng.randrange(60, 90))) for i in range(100)]
    rows += [(1000, "en", junk(70)), (1001, "en", junk(1500)), (1002, "xx", junk(70)), (1003, "en", good(70))]
    rows += [(2000 + i, "en", copied) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    few = spark.createDataFrame(rows[:5] + [rows[100]], docs.schema)
    return [{r["doc_id"]: r for r in quality.judge(d, vocabulary).collect()} for d in (docs, few)]


def test_rare_classes_and_languages_are_judged(judged):
    rows = judged[0]
    assert not rows[1001]["base_failed"] and not rows[1001]["kept"]
    assert not rows[1002]["base_failed"] and not rows[1002]["kept"]
    assert not rows[1000]["kept"] and rows[1003]["kept"] and sum(rows[i]["kept"] for i in range(100)) >= 95


def test_copies_have_one_vote(judged):
    assert not any(judged[0][2000 + i]["kept"] for i in range(60))


def test_small_table_is_judged(judged):
    assert not judged[1][1000]["kept"] and all(judged[1][i]["kept"] for i in range(5))
