"""Wealth bands from registry records and from the place in the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores from which a band holds, and the numbers of branches of trade that count as high value.
BANDS = [(0.80, "100m_plus"), (0.65, "25m_100m"), (0.45, "5m_25m"), (0.25, "1m_5m")]
HIGH_VALUE_SICS = ["66300", "64205", "68100", "68209", "64910"]


def band_of(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("unknown")


def steps(value: Column, *levels: tuple[float, float]) -> Column:
    """The contribution of the first level, highest first, that value reaches, else 0."""
    out = F.when(value >= levels[0][0], levels[0][1])
    for least, c in levels[1:]:
        out = out.when(value >= least, c)
    return out.otherwise(0.0)


def capped(n: Column, each: float, most: float) -> Column:
    return F.least(n * each, F.lit(most))


def banded(rows: DataFrame, parts: list[tuple[str, str, Column, Column]], base: float, step: float, most: float) -> DataFrame:
    """rows with evidence (an array of signal, layer, contribution), score, band and confidence.

    parts: (signal, layer, whether it is there, its contribution). score is their sum, at most 1; confidence base + step for each signal that is there, at most `most`.
    """
    each = [F.when(F.coalesce(there, F.lit(False)), F.struct(F.lit(name).alias("signal"), F.lit(layer).alias("layer"), c.cast("double").alias("contribution"))) for name, layer, there, c in parts]
    out = rows.withColumn("evidence", F.array_compact(F.array(*each)))
    total = F.aggregate("evidence", F.lit(0.0), lambda a, e: a + e["contribution"])
    out = out.withColumn("score", F.round(F.least(F.lit(1.0), total), 6))
    return out.withColumn("band", band_of(F.col("score"))).withColumn("confidence", F.round(F.least(F.lit(most), base + step * F.size("evidence")), 6))


def registry_bands(counts: DataFrame) -> DataFrame:
    """banded() over one row per person: active, controlled and high_value companies, donated (sum), charity_income (sum), trusteeships, regulated roles, rich_list (boolean), articles,
    web_signals and co_directors. Null counts as none."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = [
        ("active_directorships", "A", n("active") > 0, capped(n("active"), 0.015, 0.15)), ("psc_control", "A", n("controlled") > 0, capped(n("controlled"), 0.05, 0.20)),
        ("high_value_company_types", "A", n("high_value") > 0, capped(n("high_value"), 0.05, 0.15)), ("political_donations", "A", n("donated") > 0, steps(n("donated"), (100_000, 0.15), (25_000, 0.10), (5_000, 0.05))),
        ("charity_income_governed", "A", n("charity_income") > 0, steps(n("charity_income"), (10_000_000, 0.15), (1_000_000, 0.10), (100_000, 0.05))), ("foundation_involvement", "A", n("trusteeships") > 0, capped(n("trusteeships"), 0.025, 0.10)),
        ("fca_roles", "A", n("regulated") > 0, F.lit(0.05)), ("rich_list", "B", F.col("rich_list"), F.lit(0.20)), ("media_coverage", "B", n("articles") >= 5, F.lit(0.05)),
        ("web_search_wealth", "B", n("web_signals") > 0, capped(n("web_signals"), 0.05, 0.15)), ("co_director_network", "A", n("co_directors") >= 5, capped(n("co_directors"), 0.005, 0.10)),
    ]
    return banded(counts, parts, 0.5, 0.05, 0.95)


def text_signals(evidence: DataFrame) -> DataFrame:
    """(person, billion, million, rich, property, fund) of evidence(person, at, id, text): what the lower-cased texts of a person speak of; million is the first amount of millions,
    by at and id. Worked out row by row and grouped, so no person's texts are put together."""
    t = F.lower(F.coalesce("text", F.lit("")))
    amount = F.regexp_extract(t, r"[£$]\s*(\d+)\s*(?:m\b|million)", 1)
    rows = evidence.withColumns({"_b": t.rlike(r"\bbillion|billionaire\b"), "_m": F.when(amount != "", amount.cast("long")), "_r": t.rlike("rich list|sunday times|forbes"), "_p": t.rlike("property|real estate|portfolio"), "_f": t.rlike(r"hedge fund|private equity|\bfund\b|investment")})
    first = F.min(F.when(F.col("_m").isNotNull(), F.struct("at", "id", F.col("_m").alias("m"))))
    return rows.groupBy("person").agg(F.max("_b").alias("billion"), first["m"].alias("million"), F.max("_r").alias("rich"), F.max("_p").alias("property"), F.max("_f").alias("fund"))


def network_bands(counts: DataFrame, scored: DataFrame) -> DataFrame:
    """banded() over one row per person: directorships, co_directors, charities, co_trustees and text_signals(), for those that scored(person) hasn't; persons of band unknown are left out."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    giving, billion = n("charities") + n("co_trustees"), F.coalesce("billion", F.lit(False))
    parts = [
        ("active_directorships", "A", n("directorships") > 0, capped(n("directorships"), 0.015, 0.15)), ("co_director_network", "A", n("co_directors") >= 3, capped(n("co_directors"), 0.006, 0.12)),
        ("philanthropy", "B", giving > 0, capped(giving, 0.03, 0.12)), ("billionaire_reference", "B", billion, F.lit(0.25)),
        ("million_reference", "B", ~billion & F.col("million").isNotNull(), F.when(F.col("million") >= 100, 0.20).when(F.col("million") >= 25, 0.15).when(F.col("million") >= 5, 0.10).otherwise(0.05)),
        ("rich_list_mention", "B", F.col("rich"), F.lit(0.15)), ("property_signals", "B", F.col("property"), F.lit(0.05)), ("fund_management", "B", F.col("fund"), F.lit(0.10)),
    ]
    left = counts.join(scored.select(F.col("person").alias("_s")), F.col("person") == F.col("_s"), "left_anti")
    return banded(left, parts, 0.35, 0.08, 0.85).where("band <> 'unknown'")
