"""Connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """spark.checkpoint.dir. Where that is unset, a new temporary folder on local[...] (tests), and an error on a cluster, whose machines share none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: What saved() and bucketed() have written since the innermost only_result() of this thread began: paths, and names of tables. None outside of one.
WRITTEN: ContextVar[list[tuple[str, str]] | None] = ContextVar("written", default=None)


def noted(kind: str, name: str) -> None:
    own = WRITTEN.get()
    if own is not None:
        own.append((kind, name))


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/tieweave-{uuid.uuid4().hex}"
    noted("path", path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what saved() wrote for df, which isn't read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("tieweave-"):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, key: str, dealt: bool = False, n: int | None = None, session=None, more: Sequence[DataFrame] = ()) -> DataFrame:
    """df as a table in the shared folder with n buckets (as many as there are shuffle partitions), a file each: joins by the key read it without a shuffle.

    dealt: df was just grouped by the key, so the rows of a bucket are in one task already and aren't shuffled for it again. session: where it is read, if not in that of df.
    more: further parts of the table, written one after the other, so that only one of them is shuffled at a time; each adds a file a bucket.
    """
    spark, name = df.sparkSession, f"tieweave_{uuid.uuid4().hex}"
    path, n = f"{shared_folder(spark)}/{name}", n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    noted("table", f"`{spark.catalog.currentDatabase()}`.{name}")
    noted("path", path)
    for part in (df, *more):
        (part if dealt else part.repartition(n, key)).write.bucketBy(n, key).option("path", path).saveAsTable(name, format="parquet", mode="append")
    return (session or spark).table(name)


#: Rows of one task of spread().
ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by the keys to so many tasks that none of them gets much over ROWS of its `rows`; as it is where the shuffle partitions are enough for that."""
    n = -(-rows // ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def tasks_for(spark, rows: int) -> int:
    """How many tasks rounds over so many rows are dealt to: one for each core, more beyond ROWS each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


#: Whether the shuffle files of a query are deleted when it ends, rather than when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark) -> Iterator[None]:
    """While it lasts, the shuffle files of each query of the session are deleted when it ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def session_of_rounds(spark, tasks: int):
    """A session for iterations: plans of many alike rounds aren't planned anew in each stage, and the shuffle files of a job are deleted when it ends."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(tasks))
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set(CLEANUP, "true")
    own.sql(f"USE `{spark.catalog.currentDatabase()}`")
    return own


def only_result(spark, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written; all else that it wrote on its way is deleted."""
    path = f"{shared_folder(spark)}/tieweave-{uuid.uuid4().hex}"
    own: list[tuple[str, str]] = []
    token = WRITTEN.set(own)
    try:
        out = make()
        out.write.parquet(path)
    finally:
        WRITTEN.reset(token)
        for kind, name in own:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(name)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    noted("path", path)
    return spark.read.schema(out.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node that is reachable.

    Alternating large-star and small-star steps until a round changes nothing; each is one grouped minimum and one join on the node. Edges with a
    null end are left out; loops give a component of one. Each round is written to the shared folder; the result alone stays there.
    """
    return only_result(edges.sparkSession, lambda: star_rounds(edges))


def star_rounds(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()
    now = saved(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    while True:
        around = now.union(now.select("v", "u"))
        least = around.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = around.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(below, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = saved(small.union(below.select("w", "m")).distinct())
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == sign:
            break
        sign = (row["n"], row["h"])
    labels = now.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("component"))
    return nodes.join(labels, F.col("node") == F.col("x"), "left").select("node", F.coalesce("component", "node").alias("component"))
