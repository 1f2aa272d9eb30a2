"""Centroid clustering over integers, with centroids filtered by an n-simplex projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.llm.common import only_result, read, saved

#: Components beyond this are taken as this, so that a component is an exact double and fits a sum of rows.
MOST = float(1 << 52)
#: With all components below this, squared distances are exact in 64-bit integers; others are worked out with Python's integers.
SMALL = 1 << 26
LONG = (1 << 63) - 1


class Simplex:
    """Apex coordinates over pivots.

    The pivots span a simplex in len(pivots) - 1 dimensions. A point's distances to them give its place in that space and its height above it, the last
    coordinate. Between two points' coordinates the Euclidean distance is at most the true one; with one height turned round it is at least that.
    """

    def __init__(self, pivots: np.ndarray):
        rest = pivots[1:] - pivots[0]
        self.pivots = pivots
        self.base = np.linalg.qr(rest.T)[1].T if len(rest) else np.zeros((0, 0))  # lower triangular: the pivots' own coordinates
        self.square = (self.base * self.base).sum(axis=1)

    def apex(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates from the squared distances to the pivots, a row for each point."""
        flat = (distances[:, :1] + self.square - distances[:, 1:]) / 2
        place = np.linalg.solve(self.base, flat.T).T if len(self.base) else flat
        height = np.sqrt(np.maximum(0.0, distances[:, 0] - (place * place).sum(axis=1)))
        return np.concatenate([place, height[:, None]], axis=1)


def spread_pivots(rows: np.ndarray, most: int, least_height: float = 0.05) -> np.ndarray:
    """Up to `most` of the rows, each the farthest from the flat through those before it, while it is least_height of the first distance away."""
    picked, basis = [0], []
    left = rows - rows[0]
    first = None
    while len(picked) < most:
        height = np.sqrt((left * left).sum(axis=1))
        at = int(height.argmax())
        first = first or float(height[at])
        if height[at] <= 0 or height[at] < least_height * first:
            break
        picked.append(at)
        basis.append(left[at] / height[at])
        left = left - np.outer(left @ basis[-1], basis[-1])
    return rows[picked]


def squared(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to other: int64, or Python's integers where those could overflow."""
    if len(rows) and max(np.abs(rows).max(), np.abs(other).max()) >= SMALL:
        rows, other = rows.astype(object), other.astype(object)
    gap = rows - other
    return (gap * gap).sum(axis=1)


def nearest(rows: np.ndarray, coords: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid of each row, its exact squared distance, exact comparisons made); ties go to the smaller number.

    coords: the rows' apex coordinates. A centroid is compared exactly unless its lower bound is over the least upper bound. Bounds are doubles, so they
    are widened by far more than their rounding.
    """
    c = simplex.apex(np.stack([squared(centroids, p) for p in simplex.pivots.astype(np.int64)], axis=1).astype(float))
    flat = ((coords[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
    low, high = flat + (coords[:, -1:] - c[None, :, -1]) ** 2, flat + (coords[:, -1:] + c[None, :, -1]) ** 2
    slack = 1e-5 * (1 + (coords * coords).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :])
    maybe = low - slack <= (high + slack).min(axis=1, keepdims=True)
    best = np.zeros(len(rows), np.int64)
    least = np.full(len(rows), -1, object if np.abs(centroids).max() >= SMALL or np.abs(rows).max(initial=0) >= SMALL else np.int64)
    for j, other in enumerate(centroids):
        at = np.flatnonzero(maybe[:, j])
        d = squared(rows[at], other)
        better = (least[at] < 0) | (d < least[at])
        least[at[better]], best[at[better]] = d[better], j
    return best, least, int(maybe.sum())


def integers(embedding: str, size: int):
    """An array of integers floor(1024 * x), or null unless there are `size` components, none null or non-finite."""
    whole = F.transform(embedding, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * 1024).cast("double"))).cast("long"))
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(embedding) == size) & ~odd, whole)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def start_order(key: str):
    return F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)


def cluster(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, pivots: int = 12, sample: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): rows(key, cluster, distance) of every kept vector after `rounds` rounds and a last assignment; centroids as integers.

    Kept are vectors of exactly `size` components, none null or non-finite; a component x counts as floor(1024 * x), within 2 ** 52. Centroids start as
    the k vectors least by sha256 of `3:<key>`, a null key as empty, equal keys by their components; with fewer vectors there are fewer. Each round
    assigns every vector to its nearest centroid, the smaller number on ties, and takes floor(sum / count) of every non-empty cluster, exactly.
    Repeated rows count as often as they are there; an empty table gives no rows and no centroids. A distance beyond a long is the greatest long.

    Distances to at most `pivots` pivots, spread far apart among the `sample` vectors least by that hash, are worked out once and written as apex coordinates
    beside the vectors. Every round reads those, broadcasts the centroids (k rows of `size`) and sends one row of sums per task and cluster.
    """
    if k < 1 or size < 1:
        raise ValueError("k and size are at least 1")
    named = vectors.select(F.col(key).alias("id"), integers(f"`{embedding}`", size).alias("v")).where("v is not null")
    ordered = named.withColumn("_o", start_order("id")).orderBy("_o", "v").limit(max(k, sample)).collect()
    if not ordered:
        return named.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, size), np.int64)
    first = np.array([r["v"] for r in ordered], np.int64)
    simplex = Simplex(spread_pivots(first[:sample].astype(float), pivots))
    centroids = first[:k]
    named = named.select("id", "v")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column(1), size)
            distances = np.stack([squared(rows, p).astype(float) for p in simplex.pivots.astype(np.int64)], axis=1)
            coords = pa.FixedSizeListArray.from_arrays(pa.array(simplex.apex(distances).ravel()), len(simplex.pivots)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), coords], ["id", "v", "p"])

    kind = named.schema["id"].dataType.simpleString()
    placed = saved(named.mapInArrow(project, f"id {kind}, v array<long>, p array<double>"))
    for _ in range(rounds):
        centroids = moved(placed, centroids, simplex, size)
    return assigned(placed, centroids, simplex, size, key, kind), centroids


def moved(placed: DataFrame, centroids: np.ndarray, simplex: Simplex, size: int) -> np.ndarray:
    """The centroids after one round: one row of sums per task and cluster, then one per cluster, comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), [[0] * size for _ in centroids]
        for b in batches:
            rows = matrix(b.column(1), size)
            best, _, _ = nearest(rows, matrix(b.column(2), len(simplex.pivots)), centroids, simplex)
            n += np.bincount(best, minlength=len(centroids))
            for j in np.unique(best).tolist():
                part = rows[best == j]  # at most 2 ** 10 rows of 2 ** 52 in one sum of 64 bits
                for a in range(0, len(part), 1 << 10):
                    total[j] = [x + y for x, y in zip(total[j], part[a : a + (1 << 10)].sum(axis=0).tolist(), strict=True)]
        some = [j for j in range(len(centroids)) if n[j]]
        halves = [[x >> 40 for x in total[j]] for j in some], [[x & ((1 << 40) - 1) for x in total[j]] for j in some]
        lists = [pa.array(h, pa.list_(pa.int64())) for h in halves]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), *lists], ["c", "n", "high", "low"])

    parts = placed.mapInArrow(sums, "c int, n long, high array<long>, low array<long>")
    each = parts.select("c", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "x"))
    wide = F.sum(F.col("x.high").cast("decimal(38,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col("x.low"))
    found = each.groupBy("c", "i").agg(F.sum("n").alias("n"), wide.cast("decimal(38,0)").alias("s"))
    out = centroids.copy()
    for r in found.collect():  # k times `size` rows
        out[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return out


def assigned(placed: DataFrame, centroids: np.ndarray, simplex: Simplex, size: int, key: str, kind: str) -> DataFrame:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, least, _ = nearest(matrix(b.column(1), size), matrix(b.column(2), len(simplex.pivots)), centroids, simplex)
            far = np.minimum(least, LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return placed.mapInArrow(label, f"id {kind}, cluster int, distance long").withColumnRenamed("id", key)


def op12_clustering(spark, sf_dir: str) -> DataFrame:
    """Every kept vector of embeddings with its cluster, its squared distance, the inertia of its cluster and of all, and its centroid's digest."""
    import hashlib

    made: list[np.ndarray] = []

    def rows() -> DataFrame:
        out, centroids = cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
        made.append(centroids)
        return out

    found = only_result(spark, rows)
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(made[0].tolist())]
    named = spark.createDataFrame(digests, "c int, centroid_sha256 string")
    long = lambda x: F.least(x, F.lit(LONG)).cast("long")
    sums = found.groupBy(F.col("cluster").alias("c")).agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    every = sums.agg(long(F.sum("s")).alias("inertia"))
    of_cluster = sums.join(named, "c").select("c", long(F.col("s")).alias("cluster_inertia"), "centroid_sha256").join(F.broadcast(every))  # every is one row
    out = found.join(F.broadcast(of_cluster), F.col("cluster") == F.col("c"))  # at most k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql(size: int = 64, k: int = 8, rounds: int = 10) -> str:
    """The same in DuckDB's SQL, every distance worked out."""
    kept = f"""kept AS (SELECT vec_id, v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS o FROM (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {size}))"""
    far = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v[i] - c.w[i]) * (v[i] - c.w[i])))".format(n=size)
    nearest_of = "SELECT o, first(vec_id) AS vec_id, first(v) AS v, min([CAST({far} AS BIGINT), CAST(c.j AS BIGINT)]) AS best FROM kept, {c} AS c GROUP BY o".format(far=far, c="{c}")
    steps = [kept, f"c0 AS (SELECT o AS j, v AS w FROM kept WHERE o < {k})"]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest_of.format(c=f'c{r}')})")
        means = f"SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS w FROM (SELECT best[2] AS j, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM a{r}, range(1, {size} + 1) AS t(i) GROUP BY ALL) GROUP BY j"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m.w, c{r}.w) AS w FROM c{r} LEFT JOIN ({means}) AS m ON m.j = c{r}.j)")
    return f"""WITH {", ".join(steps)}, last AS MATERIALIZED ({nearest_of.format(c=f"c{rounds}")})
        SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
            CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
        FROM last JOIN c{rounds} AS c ON c.j = best[2]"""
