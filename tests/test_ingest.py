"""Ingest of results and sheets, and path picking, on literals."""

import json

from pyspark.sql import functions as F

from tieweave.operators import ingest
from tieweave.operators import paths as P
from tieweave.sources import io


def test_agent_results(spark, tmp_path):
    block = lambda n, c: "text ```json\n" + json.dumps({"entity": "Ann Lee", "confidence": c, "relationships": [{"name": f"P{i}", "kind": "Co-director at X", "via": "X", "confidence": c} for i in range(n)], "signals": [{"source": "news", "text": "t", "confidence": c}]}) + "\n``` end"
    lines = [{"type": "m", "message": {"role": "user", "content": block(9, 0.9)}}, {"type": "m", "message": {"role": "assistant", "content": block(1, 0.5) + block(2, 0.8)}}, {"type": "m", "message": {"role": "assistant", "content": "```json\nnot json\n```"}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken line\n")
    found = ingest.agent_results(spark, str(tmp_path))
    ties, proof = ingest.graph_rows(found)
    assert found.count() == 1 and sorted((r["other"], r["kind"], r["priority"]) for r in ties.collect()) == [("P0", "CO_DIRECTOR_OF", 2), ("P1", "CO_DIRECTOR_OF", 2)]
    assert [r["accepted"] for r in proof.collect()] == [True]


def test_decision_sheet(spark):
    sheet = spark.createDataFrame([(1, "a", "accept", None), (2, "a", "reject", "no_path"), (3, "a", "reject", None), (4, "z", "accept", None), (5, "a", "odd", None)], "row_number long, candidate string, label string, reason string")
    good, bad = ingest.import_decisions(sheet, spark.createDataFrame([("a",)], "candidate string"), ["accept", "reject"], {"reject": ["no_path"]})
    assert {r["row_number"] for r in good.collect()} == {1, 2}
    assert {r["row_number"]: r["error"] for r in bad.collect()} == {3: "reason_does_not_match", 4: "unknown_candidate", 5: "unknown_label"}


def test_picked_paths_are_diverse(spark):
    rows = [("t", 2, "s1", "m1", 90), ("t", 2, "s1", "m1b", 80), ("t", 2, "s2", "m1", 70), ("t", 2, "s1", "m1c", 65), ("t", 1, "s1", "", 60)]
    frame = spark.createDataFrame(rows, "target string, hops int, root string, mid string, score int")
    got = [(r["root"], r["mid"]) for r in P.pick_paths(frame, most=3).orderBy("rank").collect()]
    assert got == [("s1", "m1"), ("s1", "m1b"), ("s2", "m1")] or got[:2] == [("s1", "m1"), ("s1", "m1b")]
    assert P.pick_paths(frame, most=10).count() == 5


def test_new_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    known = spark.createDataFrame([("b",)], "t string").select(F.sha2(F.col("t").cast("binary"), 256).alias("content_hash"))
    assert {r["doc_id"] for r in io.new_documents(docs, known).collect()} == {1, 4}
