"""Structured Streaming operators over a live log; each takes and returns a streaming (or batch) DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, time: str, late: str) -> DataFrame:
    """df with a watermark on time, which is read as a timestamp of the session's time zone if it has none."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def intake(events: DataFrame, key: str = "event_id", time: str = "ts", within: str = "24 hours") -> DataFrame:
    """The first event of each key; a repeat within the watermark is dropped, and state older than it is forgotten."""
    return timed(events, time, within).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, kind: str = "event_type", time: str = "ts", every: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, kind, n) for tumbling windows, or sliding ones with `slide`; rows later than `late` are dropped."""
    window = F.window(time, every, slide) if slide else F.window(time, every)
    out = timed(events, time, late).groupBy(window.alias("w"), F.col(kind)).agg(F.count("*").alias("n"))
    return out.select("w.start", "w.end", kind, "n")


def live_funnel(outcomes: DataFrame, by: str = "seed") -> DataFrame:
    """Requests, converted and declined so far for each `by`; for update mode and foreachBatch()."""
    return outcomes.groupBy(by).agg(F.count("*").alias("requests"), F.count_if("converted").alias("converted"), F.count_if("declined").alias("declined"))


def cache_state(signals: DataFrame, days: dict[str, int], default_days: int = 30, late: str = "1 hour") -> DataFrame:
    """(person, source, state, at): "fresh" when a signal of a person and source comes, "stale" when none has come within the source's days of event time."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        person, source = key
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"person": [person], "source": [source], "state": ["stale"], "at": [pd.Timestamp(last, unit="ms")]})
            return
        newest = max(int(r["ts"].max().timestamp() * 1000) for r in rows)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + days.get(source, default_days) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"person": [person], "source": [source], "state": ["fresh"], "at": [pd.Timestamp(newest, unit="ms")]})

    grouped = timed(signals, "ts", late).groupBy("person", "source")
    return grouped.applyInPandasWithState(step, "person string, source string, state string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def merge_batches(path: str, key: str):
    """A foreachBatch() function that keeps the newest row of each key in versions of a Parquet table under path; a retried batch writes its version anew."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_v", F.lit(number))
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{number - 1}"))
        columns = [c for c in rows.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_v").alias("_r"))
        newest.select(key, "_r.*").write.mode("overwrite").parquet(f"{path}/v{number}")

    return put
