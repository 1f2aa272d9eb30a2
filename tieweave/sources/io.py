"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieweave.operators.components import shared_folder

LEADING = r"^([=+\-@\t\r])"  # a spreadsheet takes a cell that begins so for a formula


def write_snapshot(edges: DataFrame, path: str | None = None) -> str:
    """Writes edges by run_id as Parquet and returns the path."""
    path = path or f"{shared_folder(edges.sparkSession)}/graph-{uuid.uuid4().hex}"
    edges.write.partitionBy("run_id").mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return df.where(F.col("run_id") == run_id) if run_id is not None else df


def read_corpus(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, registry, year, bytes, content_hash, text) of whole text files named <registry>_<year>.txt."""
    rows = spark.read.text(pattern, wholetext=True).withColumn("path", F.input_file_name())
    name = r"([^/]+)_(\d{4})\.txt$"
    return rows.select(
        "path", F.regexp_extract("path", name, 1).alias("registry"), F.expr(rf"try_cast(regexp_extract(path, '([^/]+)_(\\d{{4}})\\.txt$', 2) as int)").alias("year"),
        F.octet_length("value").alias("bytes"), F.sha2(F.col("value").cast("binary"), 256).alias("content_hash"), F.col("value").alias("text"),
    )


def new_documents(incoming: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """incoming with content_hash, without those whose hash known(content_hash) has; of equal ones that with the least key."""
    hashed = incoming.withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    least = hashed.groupBy("content_hash").agg(F.min(key).alias("_least"))
    keep = least.join(known.select("content_hash"), "content_hash", "left_anti")
    return hashed.join(keep.withColumnRenamed("content_hash", "_h"), (F.col("content_hash") == F.col("_h")) & (F.col(key) == F.col("_least")), "left_semi")


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of table whose key is among ids(key)."""
    return table.join(ids.select(key), key, "left_semi")


def safe_cell(c: Column) -> Column:
    return F.regexp_replace(c, LEADING, "'$1")


def search_names(names: DataFrame, term: str, most: int = 20) -> DataFrame:
    return names.where(F.lower("name").contains(term.lower())).orderBy("name").limit(most)


def import_people(rows: DataFrame, aliases: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of an imported sheet: columns are renamed by their aliases, empty rows left out, and rows rejected for a missing name or as
    the second with the same first and last name (in the order of row_number)."""
    names = {c.lower().strip(): c for c in rows.columns}
    picked = [next((F.col(f"`{names[a]}`") for a in al if a in names), F.lit(None).cast("string")).alias(k) for k, al in aliases.items()]
    out = rows.select("row_number", *picked).where(F.coalesce(*[F.nullif(F.trim(F.col(k)), F.lit("")) for k in aliases]).isNotNull())
    from pyspark.sql import Window

    key = F.concat_ws("|", F.lower(F.trim("first_name")), F.lower(F.trim("last_name")))
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("row_number")))
    blank = F.coalesce(F.trim("first_name"), F.lit("")) == ""
    reason = F.when(blank | (F.coalesce(F.trim("last_name"), F.lit("")) == ""), "missing_name").when(F.col("_n") > 1, "duplicate_in_import")
    out = out.withColumn("reason", reason).drop("_n")
    return out.where("reason is null").drop("reason"), out.where("reason is not null")
