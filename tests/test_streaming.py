"""Streams replayed from the events table."""

import shutil

import pytest
from pyspark.sql import functions as F

from tieweave.streaming import operators as S


@pytest.fixture()
def source(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    events.orderBy("ts").coalesce(1).write.parquet(str(folder))
    events.where("event_id % 100 = 0").coalesce(1).write.mode("append").parquet(str(folder))
    return events, spark.readStream.schema(events.schema).parquet(str(folder))


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_intake_drops_repeats(source, tmp_path):
    events, stream = source
    assert drain(S.intake(stream, within="60 days"), "taken", "append", tmp_path).count() == events.count()


def test_activity(source, tmp_path):
    events, stream = source
    got = {(r["start"], r["event_type"]): r["n"] for r in drain(S.activity(stream, late="60 days"), "act", "complete", tmp_path).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in S.activity(events.union(events.where("event_id % 100 = 0"))).collect()}
    assert got == want and sum(want.values()) == events.count() + events.where("event_id % 100 = 0").count()


def test_live_funnel_and_merge(spark, source, tmp_path):
    events, stream = source
    rows = lambda df: df.select((F.col("user_id") % 3).alias("seed"), (F.col("event_type") == "purchase").alias("converted"), (F.col("value") < 5).alias("declined"))
    folder = str(tmp_path / "table")
    q = S.live_funnel(rows(stream)).writeStream.outputMode("update").foreachBatch(S.merge_batches(folder, "seed")).option("checkpointLocation", str(tmp_path / "f")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = sorted((tmp_path / "table").iterdir(), key=lambda p: int(p.name[1:]))[-1]
    n = sum(r["requests"] for r in spark.read.parquet(str(last)).collect())
    assert n == events.count() + events.where("event_id % 100 = 0").count()
    shutil.rmtree(folder)


def test_cache_state(spark, source, tmp_path):
    events, stream = source
    signals = stream.select(F.concat(F.lit("p:"), F.col("user_id").cast("string")).alias("person"), F.col("event_type").alias("source"), "ts")
    got = drain(S.cache_state(signals, {"purchase": 7}), "cache", "append", tmp_path)
    assert {r["state"] for r in got.select("state").distinct().collect()} <= {"fresh", "stale"}
    assert got.where("state = 'fresh'").select("person", "source").distinct().count() == events.select("user_id", "event_type").distinct().count()
