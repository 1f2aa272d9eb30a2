"""The near-duplicate stage against exact Jaccard similarity of five-word shingles over all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from tieweave.llm import nearcopies


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)])  # noqa: B905


def brute_kept(rows):
    """The smallest id of each component of the pairs of 0.8 or more."""
    label, sets = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    return sorted(set(label.values()))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_drops_pairs_of_0_8_and_more(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted(r["doc_id"] for r in out.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edits_chains_and_a_hot_group(spark, sf):
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    edit = lambda words, n: [word() if i in set(rng.sample(range(len(words)), n)) else w for i, w in enumerate(words)]
    for length in (40, 120, 300):
        for _ in range(4):
            base = [word() for _ in range(length)]
            rows += [base] + [edit(base, n) for n in (1, length // 60, length // 50 + 1, length // 30 + 1, length // 8)]
        chain = [word() for _ in range(length)]
        for _ in range(6):
            rows.append(chain)
            at = rng.randrange(length)
            chain = chain[:at] + [word()] + chain[at + 1 :]
    hot = [word() for _ in range(200)]
    rows += [edit(hot, rng.choice((1, 3, 4, 6, 9, 14))) for _ in range(80)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A b"), (9004, "a b c")]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf)
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in out.collect()) == want and len(want) < len(rows) - 60


def test_a_large_shard_is_dealt_into_pairs_of_blocks(spark):
    """Links connect the classes that the similar pairs of a shard connect, and are fewer than its classes."""
    rng, rows, sets = random.Random(7), [], {}
    for key in (0, 1):
        base = rng.sample(range(10_000), 60)
        for k in range(60):
            node = 1000 * key + k
            sets[node] = sorted(set(rng.sample(base, 60 - rng.randint(0, 9))) | {20_000 + 50 * node + j for j in range(rng.randint(0, 5))})
            rows.append((key, 0, node, len(sets[node]), 0, node if k > 20 else node % 5))
    members = spark.createDataFrame(rows, "key long, at int, node long, n int, print long, class long")
    frame_ = spark.createDataFrame(list(sets.items()), "node long, grams array<long>")

    def joined(pairs):
        label = {r[5]: r[5] for r in rows}
        for a, b in pairs:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
        return label

    def alike(x, y):
        both = len(set(sets[x[2]]) & set(sets[y[2]]))
        return x[0] == y[0] and x[5] != y[5] and both >= 0.8 * (x[3] + y[3] - both)

    want = [(x[5], y[5]) for x, y in combinations(rows, 2) if alike(x, y)]
    for few, most, most_grams in ((32, 20_000, 4_000_000), (32, 7, 4_000_000), (32, 20_000, 400), (100, 20_000, 4_000_000)):
        got = [tuple(r) for r in nearcopies.tree_links(members, frame_, 4, 0.8, few, most, most_grams).collect()]
        assert joined(got) == joined(want) and set(joined(got).values()) != set(joined([]).values())
    few = nearcopies.tree_links(members, frame_, 4, 0.8).count()
    assert few < len({r[5] for r in rows}) < len(want)


def test_short_texts_whose_fingerprints_are_far_apart(spark, sf):
    """Texts of eight and nine words, similar at 0.8, whose fingerprints differ in over RADIUS bits: 1 pair of 10,000."""
    rng, found = random.Random(3), []
    while len(found) < 3:
        w = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(9)]
        sets = [nearcopies.shingles(" ".join(x)) for x in (w, w[:8])]
        if bin((nearcopies.set_print(sets[0]) ^ nearcopies.set_print(sets[1])) & (1 << 64) - 1).count("1") > nearcopies.RADIUS:
            found.append(w)
    rows = [r for i, w in enumerate(found) for r in ((2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:8])))]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf)
    assert sorted(r["doc_id"] for r in out.collect()) == brute_kept(rows) == [0, 2, 4]


def test_null_ids_share_a_source(spark):
    from tieweave.llm import mixing

    rows = [(None, f"text {i} of no id", "a") for i in range(300)] + [(1, "one", "b"), (2, "two words", None)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = {r["source"]: r for r in plan.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()}
    assert all(r["sum(taken)"] == int(r["max(target)"]) for r in sums.values())
