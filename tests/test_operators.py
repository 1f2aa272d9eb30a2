"""Operators on literals and by their properties."""

import math
import os
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tieweave.functions import columns as C
from tieweave.operators import documents as D
from tieweave.operators import graph as G
from tieweave.operators import resolve as R
from tieweave.operators.components import components
from tieweave.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_columns(spark):
    v = lambda s: F.lit(s).cast("string")
    assert one(spark, C.trigram_similarity(v("john smith"), v("jon smith"))) == pytest.approx(8 / 13)
    assert one(spark, C.trigram_similarity(v(" A "), v("a"))) == 1.0
    assert one(spark, C.normalise_name(v("  DR.  mary\tO'brien-smith "))) == "Mary O'brien-smith"
    assert one(spark, C.charity_number(v("123456"))) == "0123456" and one(spark, C.charity_number(v("12"))) is None
    assert one(spark, C.company_number(v("sc12"))) == "SC000012" and one(spark, C.company_number(v("SC1234567"))) is None
    assert one(spark, C.postcode(v("1 High St, sw1a1aa"))) == "SW1A 1AA" and one(spark, C.postcode(v("none"))) is None
    assert one(spark, C.first_last(v("Ann B. Cole"))) == "ann|cole" and one(spark, C.first_last(v("Ann"))) is None
    assert one(spark, C.edge_class(v("DIRECTOR_OF"), v("The Ark Trust"))) == "co_trustee"
    assert one(spark, C.edge_class(v("ODD"), v(None))) == "inferred"


def test_scores(spark):
    x = lambda a: F.lit(a).cast("double")
    assert one(spark, C.weighted(C.PRIORITY_WEIGHTS, {k: x(2.0) for k in C.PRIORITY_WEIGHTS})) == pytest.approx(1.0)
    assert one(spark, C.freshness(F.lit(1990), 1998)) == 0.5 and one(spark, C.freshness(F.lit(None).cast("int"), 1998)) == 0.6
    assert one(spark, C.diminishing(F.lit(2), 0.5)) == 0.5 and one(spark, C.diminishing(F.lit(0), 1.0)) == 0.0
    assert one(spark, C.cosine(F.array(x(1), x(0)), F.array(x(1), x(1)))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, C.cosine(F.array(x(1)), F.array(x(1), x(1)))) == 0.0


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}
    return sorted(edges), spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges], "a string, b string")


def neighbours(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[f"n{a:02}"].add(f"n{b:02}")
        out[f"n{b:02}"].add(f"n{a:02}")
    return out


def brandes(near, sources):
    score = dict.fromkeys(near, 0.0)
    for s in sources:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist.get(v) == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w] / 2
    return score


def test_betweenness(spark, graph):
    edges, frame = graph
    near = neighbours(edges)
    all_nodes = spark.createDataFrame([(n,) for n in near], "node string")
    got = {r["person"]: r["score"] for r in G.betweenness(frame, all_nodes).collect()}
    want = brandes(near, near)
    assert all(got.get(n, 0.0) == pytest.approx(want[n], abs=1e-9) for n in near)


def test_components_and_reach(spark, graph):
    edges, frame = graph
    near = neighbours(edges)
    label = {}
    for n in sorted(near):
        queue = [n]
        while queue:
            v = queue.pop()
            if v not in label:
                label[v] = n
                queue += near[v]
    assert {r["node"]: r["component"] for r in components(frame).collect()} == label
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (None, 3), (900, 901)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert set(got.values()) == {0, 900} and len(got) == 203
    reach = {r["node"]: r["hop"] for r in G.reach_from(frame, spark.createDataFrame([("n00",)], "node string")).collect()}
    assert reach == {"n00": 0} | {x: 2 for v in near["n00"] for x in near[v] if x != "n00"} | {v: 1 for v in near["n00"]}


def plain_ranks(edges, seed, dangling, alpha=0.85, rounds=300):
    nodes = sorted({x for e in edges for x in e[:2]} | {seed})
    at = {x: i for i, x in enumerate(nodes)}
    out = [0.0] * len(nodes)
    for a, _, w in edges:
        out[at[a]] += w
    x = [1 / len(nodes)] * len(nodes)
    for _ in range(rounds):
        y = [0.0] * len(nodes)
        for a, b, w in edges:
            y[at[b]] += x[at[a]] * w / out[at[a]]
        lost = sum(v for v, o in zip(x, out, strict=True) if not o)
        y = [alpha * (v + (lost / len(nodes) if dangling == "uniform" else lost * (n == seed))) + (1 - alpha) * (n == seed) for v, n in zip(y, nodes, strict=True)]
        x = y
    return dict(zip(nodes, x, strict=True))


@pytest.mark.parametrize("dangling", ["uniform", "restart"])
def test_page_rank_with_sinks_and_nothing_left_behind(spark, dangling):
    edges = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "a", 0.5), ("c", "sink", 0.5), ("b", "end", 1.0), ("d", "a", 3.0)]
    frame = spark.createDataFrame(edges, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a",), ("d",), ("alone",), (None,)], "seed string")
    before = {t.name for t in spark.catalog.listTables()}
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    files = set(os.listdir(folder))
    got = {(r["seed"], r["node"]): r["rank"] for r in G.page_rank(frame, seeds, tolerance=1e-12, rounds=200, dangling=dangling).collect()}
    assert {t.name for t in spark.catalog.listTables()} == before and len(set(os.listdir(folder)) - files) == 1
    nodes = {x for e in edges for x in e[:2]} | {"a", "d", "alone"}
    for seed in ("a", "d", "alone"):
        # every seed is a node of the graph
        want = plain_ranks([*edges], seed, dangling) if dangling == "restart" else None
        if want is None:
            full = sorted(nodes)
            at = {x: i for i, x in enumerate(full)}
            out = [sum(w for a, _, w in edges if a == n) for n in full]
            x = [1 / len(full)] * len(full)
            for _ in range(300):
                y = [0.0] * len(full)
                for a, b, w in edges:
                    y[at[b]] += x[at[a]] * w / out[at[a]]
                lost = sum(v for v, o in zip(x, out, strict=True) if not o) / len(full)
                x = [0.85 * (v + lost) + 0.15 * (n == seed) for v, n in zip(y, full, strict=True)]
            want = dict(zip(full, x, strict=True))
        for n in nodes:
            assert got[seed, n] == pytest.approx(want.get(n, 0.0), abs=1e-7)


def test_a_bucket_is_one_file_and_results_alone_stay(spark):
    from tieweave.operators.components import bucketed, only_result, saved

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    seen = []

    def make():
        table = bucketed(spark.range(5000).selectExpr("id % 50 as k", "id").repartition(7), "k")
        path = next(x for x in set(os.listdir(folder)) - before if x.startswith("tieweave_"))
        seen.append(len([x for x in os.listdir(f"{folder}/{path}") if x.endswith(".parquet")]))
        return saved(table.groupBy("k").count())

    assert only_result(spark, make).count() == 50
    assert seen[0] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(set(os.listdir(folder)) - before) == 1


def test_page_rank(spark, graph):
    edges, frame = graph
    directed = frame.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(2.0).alias("weight"))
    got = {r["node"]: r["rank"] for r in G.page_rank(directed, spark.createDataFrame([("n03",)], "seed string"), rounds=60).collect()}
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-6)
    nodes, out = sorted(got), defaultdict(list)
    for a, b in edges:
        out[f"n{a:02}"].append(f"n{b:02}")
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(60):
        lost = sum(rank[n] for n in nodes if not out[n])
        new = {n: 0.85 * lost / len(nodes) + 0.15 * (n == "n03") for n in nodes}
        for n in nodes:
            for m in out[n]:
                new[m] += 0.85 * rank[n] / len(out[n])
        rank = new
    assert all(got[n] == pytest.approx(rank[n], abs=1e-5) for n in nodes)


def test_communities_beat_one_group(spark):
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(6) for j in range(i + 1, 6)] + [("x0", "y0"), ("y1", "z1")]
    frame = spark.createDataFrame(cliques, "a string, b string")
    labels = G.communities(frame, rounds=10)
    assert G.modularity(frame, labels).first()["q"] > 0.5


def test_group_size_cap(spark):
    rows = [("big", f"p{i:03}") for i in range(60)] + [("small", "p001"), ("small", "p002"), ("alone", "p003")]
    members = spark.createDataFrame(rows, "company string, person string")
    assert [tuple(r) for r in G.co_members(members, most=40).select("a", "b").collect()] == [("p001", "p002")]


def test_similarity_join_is_exact(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 12))).strip() or "a" for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(r["left"], r["right"]) for r in R.similarity_join(frame, frame, 0.4).collect()}
    gram = lambda s: {p[i : i + 3] for p in ["  " + s.lower().strip() + " "] for i in range(len(p) - 2)}
    assert got == {(i, j) for i, x in enumerate(names) for j, y in enumerate(names) if len(gram(x) & gram(y)) / len(gram(x) | gram(y)) >= 0.4 - 1e-12}


def test_blocks_that_are_too_large_are_reported(spark):
    rows = spark.createDataFrame([(f"m{i:03}", "person", "k") for i in range(30)] + [("m900", "person", "z"), ("m901", "person", "z")], "mention string, kind string, key string")
    pairs, large = R.candidate_pairs(rows, {"key": F.col("key")}, most_block=10)
    assert [tuple(r) for r in pairs.collect()] == [("m900", "m901")] and large.first()["n"] == 30


def test_clusters(spark):
    mentions = spark.createDataFrame([(x,) for x in "abcde"], "mention string")
    scored = spark.createDataFrame([("a", "b", 0.95, False), ("b", "c", 0.8, False), ("a", "c", 0.6, False), ("c", "d", 0.99, True)], "a string, b string, score double, blocked boolean")
    got = {r["mention"]: (r["cluster"], r["confidence"], r["band"]) for r in R.clusters(mentions, scored).collect()}
    assert got["a"] == got["b"] == got["c"] == ("a", 0.6, "possible_duplicate") and got["d"] == ("d", 1.0, "auto_merge")


def test_chunks_keep_the_text(spark):
    text = "# one\nshort line\n" + "x" * 50 + "\n\nlast"
    rows = D.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), tokens=30, chars_per_token=1).orderBy("doc_id", "chunk").collect()
    assert "\n\n".join(r["text"] for r in rows if r["doc_id"] == 1) == text
    assert all(text[r["start"] :].startswith(r["text"]) for r in rows if r["doc_id"] == 1)


def test_sources(spark, tmp_path):
    (tmp_path / "north_2021.txt").write_text("hello\nworld")
    (tmp_path / "south_2022.txt").write_text("")
    rows = {r["registry"]: r for r in io.read_corpus(spark, str(tmp_path)).collect()}
    assert rows["north"]["year"] == 2021 and rows["north"]["bytes"] == 11
    assert one(spark, io.safe_cell(F.lit("=1+1"))) == "'=1+1" and one(spark, io.safe_cell(F.lit("ok"))) == "ok"
    sheet = spark.createDataFrame([(1, "Ann", "Lee"), (2, "ann ", "LEE"), (3, None, "Poe"), (4, "", " ")], "row_number long, `First Name` string, Surname string")
    good, bad = io.import_people(sheet, {"first_name": ["first name"], "last_name": ["last name", "surname"]})
    assert [r["row_number"] for r in good.collect()] == [1]
    assert {r["row_number"]: r["reason"] for r in bad.collect()} == {2: "duplicate_in_import", 3: "missing_name"}


def test_eigenvector(spark, graph):
    import numpy as np

    edges, frame = graph
    near = neighbours(edges)
    names = sorted(near)
    m = np.array([[float(b in near[a]) for b in names] for a in names])
    x = np.ones(len(names))
    for _ in range(12):
        x = m @ x
        x /= np.sqrt((x * x).sum())
    got = {r["person"]: r["score"] for r in G.eigenvector(frame, rounds=12).collect()}
    assert [got[n] for n in names] == pytest.approx(list(x / x.max()))


def test_constraint_and_links(spark):
    frame = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "d")], "a string, b string")
    got = {r["person"]: r["constraint"] for r in G.burt_constraint(frame).collect()}
    half, third = 1 / 2, 1 / 3
    assert got["a"] == pytest.approx((half + half * third) ** 2 * 2)
    links = [tuple(r) for r in G.link_prediction(frame).select("a", "b", "common").collect()]
    assert links == [("a", "d", 2)]
    assert G.link_prediction(frame, decided=spark.createDataFrame([("d", "a")], "a string, b string")).count() == 0
