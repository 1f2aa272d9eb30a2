"""Centroid clustering: the filter against all distances, the rounds against a plain loop, and odd tables."""

import hashlib
import random

import numpy as np
import pytest

from tieweave.llm import clustering as C


def plain_clusters(rows, k=8, rounds=10):
    """rows: (id, integers). Every distance in Python's integers."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in rows[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(rows, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in rows), centroids


def answer(df):
    return sorted((str(r[0]), r[1], r[2]) for r in df.collect())


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 42])
@pytest.mark.parametrize("pivots", [1, 4, 12])
def test_nearest_is_exact(scale, pivots):
    rng = np.random.default_rng(pivots)
    for size in (2, 7, 64):
        centers = rng.normal(size=(6, size)) * 80
        rows = np.floor(centers[rng.integers(0, 6, 300)] + rng.normal(size=(300, size)) * rng.choice([0, 1, 25])).astype(np.int64) * scale
        simplex = C.Simplex(C.spread_pivots(rows[:60].astype(float), pivots))
        centroids = np.concatenate([rows[rng.choice(300, 7)], rows[:1]])
        coords = simplex.apex(np.stack([C.squared(rows, p).astype(float) for p in simplex.pivots.astype(np.int64)], axis=1))
        best, least, compared = C.nearest(rows, coords, centroids, simplex)
        full = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, c, strict=True)) for c in centroids] for r in rows]
        assert best.tolist() == [min(range(8), key=lambda j, f=f: (f[j], j)) for f in full]
        assert [int(x) for x in least] == [min(f) for f in full] and compared <= 300 * 8


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(200, 16)) * 500
    simplex = C.Simplex(C.spread_pivots(rows[:40], 6))
    p = simplex.apex(((rows[:, None] - simplex.pivots[None]) ** 2).sum(axis=2))
    true = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    flat = ((p[:, None, :-1] - p[None, :, :-1]) ** 2).sum(axis=2)
    low, high = np.sqrt(flat + (p[:, None, -1] - p[None, :, -1]) ** 2), np.sqrt(flat + (p[:, None, -1] + p[None, :, -1]) ** 2)
    assert (low <= true + 1e-6).all() and (true <= high + 1e-6).all()
    assert len(simplex.pivots) == 6 and (low > 0.2 * true - 1e-6).mean() > 0.9


def test_rounds_against_a_plain_loop(spark):
    rng = random.Random(6)
    centers = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for i in range(160)]
    rows += [rows[3], rows[3], (None, rows[9][1]), (500, rows[4][1]), (501, [1e9] + [0.0] * 63), (502, [-3e300] + [0.5] * 63)]
    odd = [(600, None), (601, []), (602, [0.1] * 63), (603, [0.1] * 65), (604, [None] + [0.1] * 63), (605, [float("nan")] + [0.1] * 63), (606, [float("-inf")] + [0.1] * 63)]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, distance double, cluster string").repartition(4)
    got, centroids = C.cluster(df)
    most = 1 << 52
    ints = [(i, [int(max(-most, min(most, np.floor(np.float64(x) * 1024)))) for x in v]) for i, v in rows]
    want, middles = plain_clusters(ints)
    assert answer(got) == [(i, c, min(d, C.LONG)) for i, c, d in want]
    assert centroids.tolist() == middles


def test_few_equal_and_no_rows(spark):
    one = spark.createDataFrame([(7, [0.5] * 64)] * 3, "vec_id long, embedding array<float>")
    got, centroids = C.cluster(one)
    assert answer(got) == [("7", 0, 0)] * 3 and centroids.tolist() == [[512] * 64] * 3
    none, centroids = C.cluster(one.limit(0))
    assert none.count() == 0 and not len(centroids) and none.columns == ["vec_id", "cluster", "distance"]


def test_query_with_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert C.op12_clustering(spark, str(tmp_path)).count() == 0
