"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieweave.llm.common import WORD, read, saved

#: Rows of the plan (one per source) up to which it is broadcast.
MOST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources(source, source_size, weight) with target (double).

    All targets sum to the total size where the caps allow it; none is above max_epochs times its source's size, and the
    excess goes to the others by weight. The level that all uncapped sources share per unit of weight follows from the
    sources in the order of cap / weight: those before the first one whose cap lies above the level are capped.
    One row per source goes through one window; texts and documents don't.
    """
    cap = F.col("source_size") * max_epochs
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    laid = (
        sources.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", level)
        .withColumn("open_level", F.when(F.col("ratio") >= F.col("level"), F.col("level")))
        .withColumn("water", F.first("open_level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("water"), F.col("cap").cast("double")))
    return laid.select("source", "source_size", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, seed: int = 17, max_epochs: int = 3, weight_cycle: int = 3) -> DataFrame:
    """docs with size, source_size, target and taken: how many words of each document the mix takes, repeats counted.

    Each document of a source is taken floor(target / source size) times as a whole. The rest of the target is taken from the
    source's documents in the order of a seeded hash: whole documents while they fit, and the first words of the one where
    the target ends. So a source's taken words are its target rounded down, and a rerun gives the same rows.

    The order is that of md5(seed:doc_id:md5(text)), so that rows without an id are spread too: its first three hex digits give a bucket, the next three a part of it. Sizes are summed by part, parts by
    bucket; the bucket in which the fraction ends, then the part of it, are found on at most 4,096 sums a source each. Only the documents of that
    part (a 16-millionth of the source) are put into a window, so a hot source never meets in one task, and no other text is shuffled.
    The plan has one row per source.
    Sources weigh 1, 2, ... weight_cycle and again, by code point, null last. Null texts and texts without words have size 0
    and are taken 0 times. Rows with the same doc_id are told apart by their texts; equal rows may swap places.
    An empty table gives an empty result. Columns of docs named like the new ones are replaced.
    """
    own = {"size", "source_size", "target", "taken", "_whole", "_bucket", "_part", "_key", "_src", "_edge", "_edge_part", "_room", "_extra"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    digits = lambda at: F.conv(F.substring("_key", at, 3), 16, 10).cast("int")
    sized = base.withColumn("size", size_of(F.col("text"))).withColumn(
        "_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    ).withColumn("_bucket", digits(1)).withColumn("_part", digits(4))
    parts = saved(sized.groupBy(F.col("source").alias("_src"), "_bucket", "_part").agg(F.sum("size").alias("_in")))
    light = parts.groupBy("_src", "_bucket").agg(F.sum("_in").alias("_in"))
    sources = light.groupBy(F.col("_src").alias("source")).agg(F.sum("_in").alias("source_size"))
    weight = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % weight_cycle + 1
    targets = water_fill(sources.withColumn("weight", weight), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.select(
        F.col("source").alias("_src"), "source_size", "target", whole.alias("_whole"),
        (F.floor("target") - whole * F.col("source_size")).cast("long").alias("_room"),
    )

    def end(plan: DataFrame, sums: DataFrame, at: str, name: str) -> DataFrame:
        """plan(_src, _room, ...) with where among sums(_src, <at>, _in) its room ends, as <name> (-1: nowhere), and the room left there."""
        before = Window.partitionBy("_s").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        laid = sums.withColumnRenamed("_src", "_s").withColumn("_start", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        joined = plan.join(laid, F.col("_src").eqNullSafe(F.col("_s")), "left")
        rest = [c for c in plan.columns if c != "_room"]
        found = F.min(F.when(F.col("_start") + F.col("_in") > F.col("_room"), F.struct(at, "_start"))).alias("_at")
        return joined.groupBy(*rest, "_room").agg(found).select(*rest, (F.col("_room") - F.col("_at._start")).alias("_room"), F.coalesce(f"_at.{at}", F.lit(-1)).alias(name))

    coarse = saved(end(targets, light, "_bucket", "_edge"))
    few = coarse.count() <= MOST_SOURCES
    small = lambda df: F.broadcast(df) if few else df
    ends = coarse.select(F.col("_src").alias("_s"), F.col("_edge").alias("_e"))
    inner = parts.join(small(ends), parts["_src"].eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_e"))).select(parts["_src"], "_part", "_in")
    plan = saved(end(coarse, inner, "_part", "_edge_part"))
    rows = sized.join(small(plan), sized["source"].eqNullSafe(plan["_src"])).drop("_src")
    first = (F.col("_bucket") < F.col("_edge")) | ((F.col("_bucket") == F.col("_edge")) & (F.col("_part") < F.col("_edge_part")))
    there = (F.col("_bucket") == F.col("_edge")) & (F.col("_part") == F.col("_edge_part"))
    flat = rows.where(~there).withColumn("_extra", F.when(first, F.col("size")).otherwise(0))
    inside = Window.partitionBy("source").orderBy("_key", "size", "text").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_room") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = rows.where(there).withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), room)))
    return (
        flat.unionByName(cut)
        .withColumn("taken", (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long"))
        .drop("_key", "_bucket", "_part", "_edge", "_edge_part", "_room", "_whole", "_extra")
    )


def apply_mix(docs: DataFrame, seed: int = 17, max_epochs: int = 3) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole repetition, and one with the first words of a text for a partial one.

    A text that is cut gets the n_chars of what is left. Documents of size 0 are not taken.
    """
    plan = plan_mix(docs, seed, max_epochs).where("taken > 0")
    each = plan.withColumn("_part", F.explode(F.transform(
        F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)")),
        lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")),
    )))
    # Cut between a word and the white space after it: the first n pieces hold the first n words with the white space before each.
    pieces = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")
    text = F.when(F.col("_part") == F.col("size"), F.col("text")).otherwise(head)
    out = each.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_part") == F.col("size"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
laid AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / CAST(weight AS DOUBLE) AS ratio,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM weighted),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / CAST(weights - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM laid WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, (ratio, source)) AS water FROM levels WHERE ratio >= level),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * water, CAST(cap AS DOUBLE))) AS target
  FROM levels, water),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size, s.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - start)) AS BIGINT) AS taken
FROM ranked
"""
