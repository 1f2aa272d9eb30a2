"""The signals that estimates and evidence hold about a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories of a signal by what its name contains, and of an evidence row by what its source contains; the first rule that holds counts.
ESTIMATE_RULES = [
    ("co_director", ["co_director", "co-director"]), ("directorship", ["director"]), ("philanthropy", ["philanthrop"]), ("property", ["property", "real_estate", "land"]),
    ("rich_list", ["rich_list", "billionaire", "million", "forbes"]), ("fund_management", ["fund", "asset_management"]), ("charity", ["charit", "trust", "foundation"]),
]
SOURCE_RULES = [
    ("directorship", ["companies_house"]), ("charity", ["charity_commission", "360giving"]), ("political", ["electoral"]), ("property", ["land_registry"]),
    ("rich_list", ["forbes", "rich"]), ("news", ["news", "guardian", "gdelt"]), ("web", ["web_search", "wiki"]),
]
REGISTER, REGISTER_CHARITY = "companies_house", "trustee|charit|foundation"


def by_rules(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first category one of whose words is in the text, lower-cased, else other."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, parts in rules:
        holds = F.greatest(F.lit(False), *[F.contains(low, F.lit(p)) for p in parts])
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise("other")


def evidence_category(source: Column, text: Column) -> Column:
    """by_rules() over the source; a row of the register of companies is charity where its text speaks of a trustee, a charity or a foundation."""
    charity = F.contains(F.lower(source), F.lit(REGISTER)) & F.lower(F.coalesce(text, F.lit(""))).rlike(REGISTER_CHARITY)
    return F.when(charity, "charity").otherwise(by_rules(source, SOURCE_RULES))


def signals(estimates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(person, category, label, layer, source, contribution, confidence, at): one row for each signal of the newest of estimates(person, assessed_at, evidence) and for each row of
    evidence(person, source, layer, text, confidence, created_at).

    An estimate's evidence is an array of (signal, contribution, layer); those without a name are left out; a missing layer is A there and B in evidence. Of
    estimates assessed at the same time the one with the greatest evidence counts. The newest is found by one grouped maximum.
    """
    newest = estimates.groupBy("person").agg(F.max(F.struct("assessed_at", "evidence")).alias("_n")).select("person", F.col("_n.assessed_at").alias("at"), F.explode("_n.evidence").alias("e")).where("e.signal is not null and e.signal <> ''")
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    one = newest.select(
        "person", by_rules(F.col("e.signal"), ESTIMATE_RULES).alias("category"), spaced(F.col("e.signal")).alias("label"), F.coalesce("e.layer", F.lit("A")).alias("layer"), F.lit("wealth_model").alias("source"),
        F.col("e.contribution").cast("double").alias("contribution"), F.lit(None).cast("double").alias("confidence"), F.col("at").cast("timestamp").alias("at"),
    )
    two = evidence.select(
        "person", evidence_category(F.col("source"), F.col("text")).alias("category"), spaced(F.col("source")).alias("label"), F.coalesce("layer", F.lit("B")).alias("layer"), "source",
        F.lit(None).cast("double").alias("contribution"), F.col("confidence").cast("double").alias("confidence"), F.col("created_at").cast("timestamp").alias("at"),
    )
    return one.unionByName(two)


def signal_summary(rows: DataFrame) -> DataFrame:
    """(person, signals, by_category, sources, multi_source, newest) of signals(): counts by category as a map, the sources sorted, whether there are two or more, the newest time.

    Counted by person, category and source first, so that a person of very many signals is a few rows when it is put together.
    """
    few = rows.groupBy("person", "category", "source").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    each = few.groupBy("person", "category").agg(F.sum("n").alias("n"), F.collect_set("source").alias("s"), F.max("at").alias("at"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))
    out = each.groupBy("person").agg(F.sum("n").alias("signals"), entries.alias("by_category"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("sources"), F.max("at").alias("newest"))
    return out.select("person", "signals", "by_category", "sources", (F.size("sources") >= 2).alias("multi_source"), "newest")
