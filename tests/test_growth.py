"""What findings on growth asked for: how steps are laid out, beside the tests of their results."""

import random

import pytest
from pyspark.sql import functions as F

from tieweave.operators import components
from tieweave.operators import graph as G
from tieweave.operators import match
from tieweave.plans import more, reports
from tieweave.sources import fixtures as X


@pytest.fixture
def laid_out(monkeypatch):
    """The keys of the tables that the graph operators lay out."""
    keys, real = [], G.bucketed
    monkeypatch.setattr(G, "bucketed", lambda df, key, *rest: (keys.append(key), real(df, key, *rest))[1])
    return keys


def test_eigenvector_lays_links_out_once(spark, laid_out):
    got = {r["person"]: r["score"] for r in G.eigenvector(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "a string, b string"), 40).collect()}
    assert laid_out == ["from"]
    assert got == pytest.approx({"a": 0.8546377461931793, "b": 0.8546377461931793, "c": 1.0, "d": 0.46081118722986886}, abs=1e-6)


def test_shortest_paths_to_all_that_is_reached(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["path"] for r in G.shortest_paths(edges, spark.createDataFrame([(1,), (4,)], "src long"), 2).collect()}
    assert got == {(1, 2): [1, 2], (1, 3): [1, 3], (1, 4): [1, 2, 4], (4, 1): [4, 1], (4, 5): [4, 5], (4, 2): [4, 1, 2], (4, 3): [4, 1, 3]}


def test_key_codes_are_in_the_order_of_the_text(spark):
    keys = [0, 1, 2, 9, 10, 19, 100, 101, 123456789012345, 999999999999999]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select(F.col("k").cast("string").alias("text"), X.key_code("k").alias("code"))
    rows = rows.select("text", "code", X.node_name(F.col("code")).alias("company"), X.node_name(F.col("code") + X.PERSON).alias("person")).collect()
    assert [r["text"] for r in sorted(rows, key=lambda r: r["code"])] == sorted(str(k) for k in keys)
    assert all((r["company"], r["person"]) == (f"c:{r['text']}", f"p:{r['text']}") for r in rows)
    with pytest.raises(Exception, match="no key_code"):
        spark.createDataFrame([(10**15,)], "k long").select(X.key_code("k")).collect()


def test_spread_follows_the_rows(spark):
    frame = spark.range(100)
    many = components.spread(frame, 7 * components.ROWS + 1, "id")
    assert many.rdd.getNumPartitions() == 8 and many.count() == 100
    assert components.spread(frame, 100, "id") is frame


def test_scores_of_runs_are_worked_out_once(spark, monkeypatch):
    calls, real = [], reports.saved
    monkeypatch.setattr(reports, "saved", lambda df: (calls.append(df.columns), real(df))[1])
    scores = spark.createDataFrame([("1", "a", 1.0), ("2", "a", 2.0), ("2", "b", 1.0)], "run_id string, id string, score double")
    got = {r["run_id"]: (r["overlap"], r["survival"]) for r in reports.path_overlap(scores).collect()}
    assert got == {"1": (None, None), "2": (1.0, 1.0)} and calls == [["run_id", "id", "score"]]


@pytest.mark.parametrize("rounds", [6, 7])
def test_ranks_of_one_side_and_one_state_at_a_time(spark, rounds, monkeypatch):
    pairs = [(1, 2, 1.0), (1, 4, 2.0), (3, 2, 0.5), (5, 4, 1.0), (5, 6, 3.0)]
    edges = spark.createDataFrame(pairs + [(b, a, w) for a, b, w in pairs], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1,), (7,)], "seed long")
    run = lambda **more: {(r["seed"], r["node"]): r["rank"] for r in G.page_rank(edges, seeds, rounds=rounds, tolerance=0.0, every=2, **more).collect()}
    gone, real = [], G.discard
    monkeypatch.setattr(G, "discard", lambda df: (gone.append(df), real(df))[1])
    want = {k: v for k, v in run().items() if k[1] % 2}
    assert len(gone) == 1 + (rounds + 1) // 2 - 1  # the edges as they came, and all states but the last
    assert run(side=F.col("node") % 2 == 1) == pytest.approx(want, abs=1e-15)


def test_what_is_alike_is_found_without_sorting_a_file(spark, tmp_path):
    """No task sorts more rows than it was dealt, however many a file has."""
    spark.range(1000).selectExpr("cast(id as string) as id", "cast(id % 7 as string) as name").repartition(1).write.parquet(str(tmp_path / "k"))
    found = match.least_ids(spark.read.parquet(str(tmp_path / "k")), ["name"])
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.select("name", "id").collect()} == {(str(k), str(min((str(i) for i in range(k, 1000, 7))))) for k in range(7)}


def test_discovery_keeps_numbers_and_no_more_columns_than_it_reads(spark, sf, monkeypatch):
    monkeypatch.setattr(more, "discover", lambda edges, seeds, eligible, **names: (edges, seeds, eligible))
    edges, seeds, eligible = more.S11_discovery(spark, sf)
    assert dict(edges.dtypes) == {"src": "bigint", "dst": "bigint", "kind": "string", "weight": "double", "confidence": "double"}
    assert seeds.dtypes == [("seed", "bigint")] and dict(eligible.dtypes)["person"] == "bigint"


def test_betweenness_lays_links_out_once_and_samples_once(spark, laid_out):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d")], "a string, b string")
    got = {r["person"]: r["score"] for r in G.betweenness(pairs, spark.createDataFrame([("a",), ("a",), ("z",)], "node string")).collect()}
    assert laid_out == ["from"]
    assert got == pytest.approx({"b": 0.5, "c": 0.0, "e": 0.5, "d": 0.0}, abs=1e-12)


def test_communities_lay_links_out_once_and_follow_a_plain_loop(spark, laid_out):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample([f"p:{i}" for i in range(25)], 2))) for _ in range(45)})
    frame = spark.createDataFrame(pairs, "a string, b string")
    near = {}
    for a, b in pairs + [(b, a) for a, b in pairs]:
        near.setdefault(a, []).append(b)
    turn = {r["v"]: r["t"] for r in spark.createDataFrame([(v,) for v in near], "v string").select("v", F.pmod(F.xxhash64("v"), F.lit(2)).alias("t")).collect()}
    at, m2 = {v: v for v in near}, 2 * len(pairs)
    for parity in (0, 1) * 3:
        total, nxt = {}, dict(at)
        for v, c in at.items():
            total[c] = total.get(c, 0) + len(near[v])
        for v in (v for v in near if turn[v] == parity):
            gain = lambda c: round(sum(at[w] == c for w in near[v]) - (total[c] - (len(near[v]) if c == at[v] else 0)) * len(near[v]) / m2, 9)  # noqa: E731, B023
            nxt[v] = min((-gain(c), c != at[v], c) for c in {at[v], *(at[w] for w in near[v])})[2]  # noqa: B023
        at = nxt
    got = {r["person"]: r["community"] for r in G.communities(frame, rounds=3).collect()}
    assert laid_out == ["from"] and got == at and len(set(at.values())) < len(at)


def test_edges_that_lead_either_way_are_written_once_and_laid_out_in_passes(spark, monkeypatch):
    pairs = [(1, 2, 1.0), (1, 4, 2.0), (3, 2, 0.5), (5, 4, 1.0), (5, 6, 3.0), (3, 4, 1.5), (7, 6, 1.0), (7, 6, 0.25)]
    schema = "src long, dst long, weight double"
    one, seeds = spark.createDataFrame(pairs, schema), spark.createDataFrame([(1,), (9,)], "seed long")
    run = lambda edges, **more: {(r["seed"], r["node"]): r["rank"] for r in G.page_rank(edges, seeds, rounds=9, tolerance=0.0, **more).collect()}
    want = run(spark.createDataFrame(pairs + [(b, a, w) for a, b, w in pairs], schema))
    monkeypatch.setattr(G, "EDGES_A_JOB", 5)
    written, parts, save, lay = [], [], G.saved, G.bucketed
    monkeypatch.setattr(G, "saved", lambda df: (written.append(df), save(df))[1])
    monkeypatch.setattr(G, "bucketed", lambda df, key, **how: (parts.append(how["more"]), lay(df, key, **how))[1])
    assert run(one, both=True) == pytest.approx(want, abs=1e-15) and len(want) == 16
    assert written[0].count() == len(pairs) and len(parts[0]) == 3
    assert spark.conf.get(components.CLEANUP) == "false"
