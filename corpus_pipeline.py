"""From raw documents to token files: toxicity, near duplicates, benchmark passages, source mix, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads it
again as the next stage's docs. All but the last return the columns of docs.
Whatever the table: an empty one passes through; null texts are neither toxic nor contaminated and are one group of near duplicates; columns
besides doc_id, text, lang, source and n_chars are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieweave.llm import decontaminate, mixing, nearcopies, tokens, toxicity
from tieweave.llm.common import crc_mod, read, saved

#: SQL can't express a trained classifier, fingerprints' components or a tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model of the labels that op1 may learn from."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where("toxic_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    Rows with the same doc_id are one document, of which the one with the smallest text stays; rows without an id stay once for each text
    unless all of them are linked to documents with one.
    """
    classes = nearcopies.near_copies(docs.select("doc_id", "text"), shingle=5, least=0.8)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # The ids grow with the corpus, so the join is a sort-merge join at every size; texts are shuffled once.
    keep = classes.where(stays & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_keep")).distinct().hint("merge")
    kept = docs.join(keep, F.col("doc_id") == F.col("_keep"), "left_semi")
    odd = saved(classes.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(stays).alias("_stays")).where("doc_id is null or _n > 1").select(F.col("doc_id").alias("_odd"), "_stays"))
    if odd.isEmpty():
        return kept.select(*docs.columns)
    rest = [c for c in docs.columns if c != "text"]
    same = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    several = docs.join(odd.where("_stays"), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi")
    one = several.groupBy("doc_id", same.alias("_same")).agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in rest])).alias("_row"))
    single = kept.join(odd, F.col("doc_id") == F.col("_odd"), "left_anti")
    return single.select(*docs.columns).unionByName(one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window."""
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where("n_hit = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes of a document."""
    return mixing.apply_mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files, read back."""
    return tokens.digests(tokens.encode_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_output", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
