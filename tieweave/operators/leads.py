"""Inputs of lead scores from what is known about a person, and the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.functions import columns as C

# Fixed values.
BAND_CAPACITY = {"100m_plus": 1.0, "25m_100m": 0.8, "5m_25m": 0.6, "1m_5m": 0.4}
CATEGORY_AFFINITY = {"charity_donor": 0.4, "hnw_target": 0.3, "wealth_identified": 0.15}
HOP_FALLBACK = {1: 0.6, 2: 0.35}
STRATEGIC = "(?i)sport|football|youth|children|young people|education|social mobility|community"
GIVING = "(?i)philanthrop|charit|foundation|trust"


def priority_inputs(rows: DataFrame) -> DataFrame:
    """rows with introability, affinity, capacity, influence and fit.

    rows: path_score (of the best path, 0 to 100), degree (hops to the nearest supporter), overlap (shared charities), category, sector, gifts, band, worth, boards, connections; null counts
    as none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hop = F.when(F.col("degree") == 1, HOP_FALLBACK[1]).when(F.col("degree") == 2, HOP_FALLBACK[2]).otherwise(0.0)
    giving = F.when(n("gifts") > 0, F.least(F.lit(0.5), 0.3 + (n("gifts") - 1) * 0.1)).otherwise(0.0)
    affinity = F.least(F.lit(0.5), n("overlap") * 0.15) + C.lookup(CATEGORY_AFFINITY, text("category"), 0.0) + F.when(text("sector").rlike(GIVING), 0.1).otherwise(0.0) + giving
    base = C.lookup(BAND_CAPACITY, text("band"), 0.0)
    fit = F.when(text("sector").rlike(STRATEGIC), 0.7).otherwise(0.3)
    return rows.withColumns({
        "introability": F.greatest(n("path_score") / 100, hop), "affinity": F.least(F.lit(1.0), affinity),
        "capacity": F.least(F.lit(1.0), base + F.when((n("worth") != 0) & (base > 0), 0.1).otherwise(0.0) + F.least(F.lit(0.2), n("boards") * 0.05)),
        "influence": F.least(F.lit(1.0), n("connections") / 20), "fit": F.when(text("category") == "hnw_target", F.greatest(fit, F.lit(0.6))).otherwise(fit),
    })


def confidence_inputs(rows: DataFrame, as_of: str) -> DataFrame:
    """rows with identity, relationship, corroboration and freshness: confirmed, path_hops and path_orgs (of the best path, null without one), proofs, newest."""
    orgs = F.coalesce("path_orgs", F.lit(0)) > 0
    path = F.when(F.col("path_hops").isNull(), 0.5).when(F.col("path_hops") == 1, F.when(orgs, 0.85).otherwise(0.7)).otherwise(F.when(orgs, 0.7).otherwise(0.55))
    proofs, age = F.coalesce("proofs", F.lit(0)), F.datediff(F.to_date(F.lit(as_of)), F.to_date("newest"))
    return rows.withColumns({
        "identity": F.when(F.coalesce("confirmed", F.lit(False)), 1.0).otherwise(0.6), "relationship": path,
        "corroboration": F.when(proofs >= 3, 1.0).when(proofs == 2, 0.7).when(proofs == 1, 0.4).otherwise(0.1),
        "freshness": F.when(age.isNull(), 0.3).when(age <= 30, 1.0).when(age <= 90, 0.85).when(age <= 180, 0.7).when(age <= 365, 0.5).otherwise(0.3),
    })


def scored(rows: DataFrame, as_of: str) -> DataFrame:
    """rows with all inputs, priority and confidence from 0 to 100, in 4 places."""
    out = confidence_inputs(priority_inputs(rows), as_of)
    score = lambda weights: F.round(100 * C.weighted(weights, {k: F.col(k) for k in weights}), 4)
    return out.withColumn("priority", score(C.PRIORITY_WEIGHTS)).withColumn("confidence", score(C.CONFIDENCE_WEIGHTS))
