"""Ingest of agents' results, sweeps and decision sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "type string, message struct<role: string, content: string>"
RESULT = """entity string, entity_type string, confidence double,
  relationships array<struct<name: string, kind: string, via: string, confidence: double>>, signals array<struct<source: string, text: string, confidence: double>>"""


def agent_results(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, result): of every JSON-lines file of messages, the fenced JSON block of an assistant with the most relationships. Lines and blocks that don't parse are left out."""
    lines = spark.read.text(pattern).withColumn("path", F.input_file_name()).withColumn("m", F.from_json("value", LINE))
    said = lines.where("m.message.role = 'assistant'").select("path", F.explode(F.regexp_extract_all(F.col("m.message.content"), F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))).alias("block"))
    parsed = said.withColumn("result", F.from_json("block", RESULT)).where("result.entity is not null")
    order = Window.partitionBy("path").orderBy(F.desc(F.coalesce(F.size("result.relationships"), F.lit(0))), "block")
    return parsed.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("path", "result")


def graph_rows(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(connections, evidence) of agent_results(): priority 1 from .90, 2 from .75, else 3; evidence is accepted for scoring from .75 on."""
    r = results.select("result.*")
    ties = r.select("entity", F.explode("relationships").alias("x")).select("entity", F.col("x.name").alias("other"), F.col("x.kind").alias("kind"), F.col("x.via").alias("via"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"))
    low = F.lower(F.coalesce("kind", F.lit("")))
    kind = F.when(low.contains("co-director"), "CO_DIRECTOR_OF").when(low.contains("director"), "DIRECTOR_OF").when(low.contains("trustee"), "TRUSTEE_OF").when(low.rlike("spouse|wife|husband|brother|sister|son|daughter"), "FAMILY_MEMBER").otherwise("ASSOCIATE")
    ties = ties.withColumn("priority", F.when(F.col("confidence") >= 0.90, 1).when(F.col("confidence") >= 0.75, 2).otherwise(3)).withColumn("kind", kind).dropDuplicates(["entity", "other", "kind", "via"])
    proof = r.select("entity", F.explode("signals").alias("x")).select("entity", "x.source", "x.text", F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"))
    return ties, proof.withColumn("accepted", F.col("confidence") >= 0.75)


def import_decisions(sheet: DataFrame, candidates: DataFrame, labels: list[str], reasons: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of sheet(row_number, candidate, label, reason): rejected for an unknown label, a reason that doesn't go with the label, or a candidate that isn't there."""
    known = candidates.select(F.col("candidate").alias("_c")).distinct()
    rows = sheet.join(known, F.col("candidate") == F.col("_c"), "left")
    wrong = F.lit(False)
    for label, allowed in reasons.items():
        wrong = wrong | ((F.col("label") == label) & ~F.coalesce(F.col("reason").isin(*allowed), F.lit(False)))
    why = F.when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "unknown_label").when(wrong, "reason_does_not_match").when(F.col("_c").isNull(), "unknown_candidate")
    out = rows.withColumn("error", why).drop("_c")
    return out.where("error is null").drop("error"), out.where("error is not null")
