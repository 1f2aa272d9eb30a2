"""Queries of the scoring family (S) and of the lead filters (F1, F2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieweave.functions import columns as C
from tieweave.operators import graph as G
from tieweave.plans.base import query
from tieweave.plans.graph import pairs
from tieweave.sources import fixtures as X

STRATEGIC = "(?i)sport|football|youth|children|young people|education|social mobility|community"
GIVING = "(?i)philanthrop|charit|foundation|trust"
BAND_CAPACITY = {"100m_plus": 1.0, "25m_100m": 0.8, "5m_25m": 0.6, "1m_5m": 0.4, "unknown": 0.0}


def lead_inputs(people: DataFrame, pairs: DataFrame, boards: DataFrame, gifts: DataFrame, proofs: DataFrame) -> DataFrame:
    """people with one count for each kind of signal; every table is grouped by person before it is joined."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("person")).agg(F.count("*").alias(name))
    news = proofs.groupBy("person").agg(F.count("*").alias("proofs"), F.count_distinct("source").alias("sources"), F.max("created_at").alias("newest"))
    out = people
    for part in (n(G.both_ways(pairs), "a", "connections"), n(boards, "person", "boards"), n(gifts, "donor", "gifts"), news):
        out = out.join(part, "person", "left")
    return out.fillna(0, ["connections", "boards", "gifts", "proofs", "sources"])


def score_leads(rows: DataFrame, as_of: str) -> DataFrame:
    """rows of lead_inputs() with the five priority parts, priority and confidence, from 0 to 100, rounded to 2 places."""
    hop = F.when(F.col("connections") > 0, 0.6).otherwise(0.0)
    giving = F.when(F.col("gifts") > 0, F.least(F.lit(0.5), 0.3 + (F.col("gifts") - 1) * 0.1)).otherwise(0.0)
    affinity = F.least(F.lit(1.0), F.when(F.col("sector").rlike(GIVING), 0.1).otherwise(0.0) + giving)
    base = C.lookup(BAND_CAPACITY, F.col("band"), 0.0)
    capacity = F.least(F.lit(1.0), base + F.when((F.col("worth") > 0) & (base > 0), 0.1).otherwise(0.0) + F.least(F.lit(0.2), F.col("boards") * 0.05))
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("newest"))
    fresh = F.when(age.isNull(), 0.3).when(age <= 30, 1.0).when(age <= 90, 0.85).when(age <= 180, 0.7).when(age <= 365, 0.5).otherwise(0.3)
    parts = {
        "introability": hop, "affinity": affinity, "capacity": capacity, "influence": F.least(F.lit(1.0), F.col("connections") / 20),
        "fit": F.when(F.col("sector").rlike(STRATEGIC), 0.7).otherwise(0.3),
    }
    trust = {"identity": F.lit(0.6), "relationship": F.lit(0.5), "corroboration": F.when(F.col("proofs") >= 3, 1.0).when(F.col("proofs") == 2, 0.7).when(F.col("proofs") == 1, 0.4).otherwise(0.1), "freshness": fresh}
    out = rows.withColumns(parts)
    return out.withColumn("priority", F.round(100 * C.weighted(C.PRIORITY_WEIGHTS, parts), 4)).withColumn("confidence", F.round(100 * C.weighted(C.CONFIDENCE_WEIGHTS, trust), 4))


def real_signal(leads: DataFrame) -> DataFrame:
    return leads.where("connections > 0 or capacity > 0 or affinity > 0")


def leads(spark, d) -> DataFrame:
    rows = lead_inputs(X.people(spark, d), pairs(spark, d), X.memberships(spark, d), X.donations(spark, d).where("amount > 250000"), X.evidence(spark, d))
    return real_signal(score_leads(rows, "2024-01-31"))


LEADS = """
WITH c AS (SELECT person, degree AS connections FROM degrees), b AS (SELECT person, count(*) AS boards FROM memberships GROUP BY 1), g AS (SELECT donor AS person, count(*) AS gifts FROM donations WHERE amount > 250000 GROUP BY 1),
e AS (SELECT person, count(*) AS proofs, count(DISTINCT source) AS sources, max(created_at) AS newest FROM evidence GROUP BY 1),
j AS (SELECT p.person, p.name, p.sector, p.band, p.worth, p.supporter, p.nation, coalesce(connections, 0) AS connections, coalesce(boards, 0) AS boards, coalesce(gifts, 0) AS gifts, coalesce(proofs, 0) AS proofs, coalesce(sources, 0) AS sources, newest
  FROM people p LEFT JOIN c USING (person) LEFT JOIN b USING (person) LEFT JOIN g USING (person) LEFT JOIN e USING (person)),
k AS (SELECT *, CASE WHEN connections > 0 THEN 0.6 ELSE 0.0 END AS introability, CASE WHEN gifts > 0 THEN least(0.5, 0.3 + (gifts - 1) * 0.1) ELSE 0.0 END AS affinity,
  CASE band WHEN '100m_plus' THEN 1.0 WHEN '25m_100m' THEN 0.8 WHEN '5m_25m' THEN 0.6 WHEN '1m_5m' THEN 0.4 ELSE 0 END AS base FROM j),
scored AS (SELECT *, CAST(least(1.0, base + CASE WHEN worth > 0 AND base > 0 THEN 0.1 ELSE 0 END + least(0.2, boards * 0.05)) AS DOUBLE) AS capacity, least(1.0, connections / 20) AS influence FROM k),
leads AS (SELECT *, round(100 * (0.30 * introability + 0.25 * affinity + 0.20 * capacity + 0.15 * influence + 0.10 * 0.3), 4) AS priority,
  round(100 * (0.35 * 0.6 + 0.30 * 0.5 + 0.20 * CASE WHEN proofs >= 3 THEN 1.0 WHEN proofs = 2 THEN 0.7 WHEN proofs = 1 THEN 0.4 ELSE 0.1 END
    + 0.15 * CASE WHEN newest IS NULL THEN 0.3 WHEN date_diff('day', CAST(newest AS DATE), DATE '2024-01-31') <= 30 THEN 1.0 WHEN date_diff('day', CAST(newest AS DATE), DATE '2024-01-31') <= 90 THEN 0.85 ELSE 0.7 END), 4) AS confidence
  FROM scored WHERE connections > 0 OR capacity > 0 OR affinity > 0)
"""


@query(LEADS + "SELECT person, priority, confidence, connections, boards, gifts, sources, supporter FROM leads")
def S1_S2_S4_S5_scored_leads(spark, d):
    return leads(spark, d).select("person", "priority", "confidence", "connections", "boards", "gifts", "sources", "supporter")


@query(LEADS + "SELECT nation, person, priority, row_number() OVER (PARTITION BY nation ORDER BY priority DESC, person) AS rank FROM leads QUALIFY rank <= 50")
def S9_S13_queue(spark, d):
    rows = leads(spark, d).select("nation", "person", "priority")
    return G.top_of_each(rows, ["nation"], [F.desc("priority"), F.col("person")], 50, "rank")


@query(LEADS + "SELECT person, priority, confidence FROM leads WHERE NOT supporter AND band IN ('25m_100m', '100m_plus') AND sources >= 2 AND connections > 0")
def F1_lead_pool(spark, d):
    return filter_leads(leads(spark, d), bands=("25m_100m", "100m_plus"), least_sources=2, linked=True, hide_supporters=True).select("person", "priority", "confidence")


def filter_leads(rows: DataFrame, bands=(), sectors=(), least_sources: int = 0, linked: bool = False, hide_supporters: bool = False, text: str | None = None) -> DataFrame:
    """Every filter that is set must hold."""
    keep = F.lit(True)
    for column, values in (("band", bands), ("sector", sectors)):
        if values:
            keep = keep & F.col(column).isin(*values)
    if linked:
        keep = keep & (F.col("connections") > 0)
    if hide_supporters:
        keep = keep & ~F.col("supporter")
    if text:
        keep = keep & F.lower("name").contains(text.lower())
    return rows.where(keep & (F.col("sources") >= least_sources))


@query(LEADS + "SELECT person, CASE WHEN name LIKE '=%' THEN '''' || name ELSE name END AS name, sector, band, priority, confidence FROM leads ORDER BY priority DESC, person LIMIT 500")
def IO10_lead_export(spark, d):
    from tieweave.sources.io import safe_cell

    rows = leads(spark, d).orderBy(F.desc("priority"), "person").limit(500)
    return rows.select("person", safe_cell(F.col("name")).alias("name"), "sector", "band", "priority", "confidence")


@query(LEADS + """
SELECT count(*) AS n, round(100.0 * count(*) FILTER (band <> 'unknown') / count(*), 6) AS wealth, round(100.0 * count(*) FILTER (affinity > 0) / count(*), 6) AS affinity, round(100.0 * count(*) FILTER (sources > 1) / count(*), 6) AS multi,
  round(100.0 * count(*) FILTER (sources = 1) / count(*), 6) AS single, count(*) FILTER (priority > 50 AND (confidence < 40 OR sources < 2)) AS thin FROM leads""")
def A20_coverage(spark, d):
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 6)
    thin = (F.col("priority") > 50) & ((F.col("confidence") < 40) | (F.col("sources") < 2))
    return leads(spark, d).agg(F.count("*").alias("n"), share(F.col("band") != "unknown").alias("wealth"), share(F.col("affinity") > 0).alias("affinity"), share(F.col("sources") > 1).alias("multi"), share(F.col("sources") == 1).alias("single"), F.count_if(thin).alias("thin"))


@query(LEADS + "SELECT CAST(least(9, floor(confidence / 10)) AS BIGINT) AS bin, count(*) AS n FROM leads GROUP BY 1")
def A20_confidence_bins(spark, d):
    return leads(spark, d).groupBy(F.least(F.lit(9), F.floor(F.col("confidence") / 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT person, count(*) AS boards FROM memberships GROUP BY 1), g AS (SELECT donor AS person, count(*) AS gifts FROM donations GROUP BY 1), e AS (SELECT person, count(DISTINCT source) AS insts FROM evidence GROUP BY 1)
SELECT p.person, round(0.20 * CASE WHEN gifts > 0 THEN 1 - 1 / (1 + gifts * 0.5) ELSE 0 END + 0.15 * CASE WHEN boards > 0 THEN 1 - 1 / (1 + boards * 0.8) ELSE 0 END + 0.07 * CASE WHEN insts > 0 THEN 1 - 1 / (1 + insts * 0.8) ELSE 0 END, 6) AS capacity
FROM people p LEFT JOIN n USING (person) LEFT JOIN g USING (person) LEFT JOIN e USING (person)""")
def S3_capacity(spark, d):
    n = lambda df, key, value, name: df.groupBy(F.col(key).alias("person")).agg(value.alias(name))
    out = X.people(spark, d).select("person")
    for part in (n(X.memberships(spark, d), "person", F.count("*"), "boards"), n(X.donations(spark, d), "donor", F.count("*"), "gifts"), n(X.evidence(spark, d), "person", F.count_distinct("source"), "insts")):
        out = out.join(part, "person", "left")
    signal = C.capacity_signal({"donations": F.col("gifts"), "directorships": F.col("boards"), "institutions": F.col("insts")})
    return out.select("person", F.round(signal, 6).alias("capacity"))


@query("""
WITH f AS (SELECT src AS seed, avg(CASE WHEN weight >= 0.5 THEN 1.0 ELSE 0 END) AS strong, avg(CASE WHEN 1998 - year <= 3 THEN 1.0 ELSE 0 END) AS recent, least(1, count(DISTINCT dst) / 10) AS aff FROM edges GROUP BY 1),
q AS (SELECT seed, round(0.30 * strong + 0.25 * recent + 0.20 * aff + 0.15 * 0.5 + 0.10 * 1.0, 3) AS quality FROM f)
SELECT seed, quality, CASE WHEN quality >= 0.70 THEN 'normal' WHEN quality >= 0.40 THEN 'warning' ELSE 'low_quality' END AS band, CASE WHEN quality < 0.40 THEN 25 END AS cap, CASE WHEN quality < 0.40 THEN 0.60 ELSE 0.40 END AS least_confidence FROM q""")
def S7_S8_seed_quality(spark, d):
    edges = G.build_edges(X.relationships(spark, d)).where("reason is null")
    inputs = edges.groupBy(F.col("src").alias("seed")).agg(F.avg((F.col("weight") >= 0.5).cast("double")).alias("strong"), F.avg((1998 - F.col("year") <= 3).cast("double")).alias("recent"), (F.count_distinct("dst") / 10).alias("affiliations"))
    q = F.round(C.weighted(C.SEED_WEIGHTS, {"strong": F.col("strong"), "recent": F.col("recent"), "affiliations": F.col("affiliations"), "intros": F.lit(0.5), "identity": F.lit(1.0)}), 3)
    band = F.when(F.col("quality") >= 0.70, "normal").when(F.col("quality") >= 0.40, "warning").otherwise("low_quality")
    return inputs.withColumn("quality", q).select("seed", "quality", band.alias("band"), F.when(F.col("quality") < 0.40, 25).alias("cap"), F.when(F.col("quality") < 0.40, 0.60).otherwise(0.40).alias("least_confidence"))


@query("""
WITH latest AS (SELECT person, source, confidence, created_at FROM evidence QUALIFY row_number() OVER (PARTITION BY person ORDER BY created_at DESC, event_id DESC) = 1),
o AS (SELECT person, 'override' AS band FROM people WHERE nation = 3)
SELECT p.person, p.band AS automated, coalesce(o.band, CASE WHEN l.confidence > 0.5 THEN p.band ELSE 'unknown' END) AS band, round(coalesce(l.confidence, 0.5), 6) AS confidence
FROM people p LEFT JOIN latest l USING (person) LEFT JOIN o USING (person)""")
def S17_J5_latest_and_override(spark, d):
    latest = G.top_of_each(X.evidence(spark, d), ["person"], [F.desc("created_at"), F.desc("event_id")]).select("person", F.col("confidence").alias("c"))
    who = X.people(spark, d)
    forced = who.where("nation = 3").select("person", F.lit("override").alias("o"))
    out = who.join(latest, "person", "left").join(forced, "person", "left")
    return out.select("person", F.col("band").alias("automated"), F.coalesce("o", F.when(F.col("c") > 0.5, F.col("band")).otherwise("unknown")).alias("band"), F.round(F.coalesce("c", F.lit(0.5)), 6).alias("confidence"))


@query("""
WITH r AS (SELECT person, source, avg(confidence) AS c FROM evidence GROUP BY 1, 2)
SELECT x.person, x.source AS s1, y.source AS s2, round(abs(x.c - y.c), 6) AS gap, CASE WHEN abs(x.c - y.c) > 0.50 THEN 'high' ELSE 'medium' END AS severity FROM r x JOIN r y ON x.person = y.person AND x.source < y.source WHERE abs(x.c - y.c) > 0.30""")
def S19_signal_conflicts(spark, d):
    r = X.evidence(spark, d).groupBy("person", "source").agg(F.avg("confidence").alias("c"))
    other = r.select(F.col("person").alias("p2"), F.col("source").alias("s2"), F.col("c").alias("c2"))
    both = r.join(other, (F.col("person") == F.col("p2")) & (F.col("source") < F.col("s2"))).withColumn("g", F.abs(F.col("c") - F.col("c2"))).where("g > 0.30")
    return both.select("person", F.col("source").alias("s1"), "s2", F.round("g", 6).alias("gap"), F.when(F.col("g") > 0.50, "high").otherwise("medium").alias("severity"))


@query("""
WITH c AS (SELECT person, CASE WHEN source LIKE '%purchase%' THEN 'wealth' WHEN source LIKE '%click%' OR source LIKE '%view%' THEN 'affinity' ELSE 'other' END AS category, source, created_at FROM evidence)
SELECT person, count(*) FILTER (category = 'wealth') AS wealth, count(*) FILTER (category = 'affinity') AS affinity, count(*) FILTER (category = 'other') AS other, count(DISTINCT source) AS sources, count(DISTINCT source) > 1 AS multi FROM c GROUP BY 1""")
def S20_signal_model(spark, d):
    kind = F.when(F.col("source").contains("purchase"), "wealth").when(F.col("source").contains("click") | F.col("source").contains("view"), "affinity").otherwise("other")
    rows = X.evidence(spark, d).withColumn("category", kind)
    return rows.groupBy("person").agg(*[F.count_if(F.col("category") == k).alias(k) for k in ("wealth", "affinity", "other")], F.count_distinct("source").alias("sources"), (F.count_distinct("source") > 1).alias("multi"))


@query("""
WITH n AS (SELECT person, count(*) AS boards FROM memberships GROUP BY 1)
SELECT p.person, round(least(0.3, coalesce(boards, 0) * 0.1) + least(0.3, coalesce(degree, 0) * 0.02) + CASE WHEN worth > 100e6 THEN 0.4 ELSE 0 END, 6) AS score,
  CASE WHEN round(least(0.3, coalesce(boards, 0) * 0.1) + least(0.3, coalesce(degree, 0) * 0.02) + CASE WHEN worth > 100e6 THEN 0.4 ELSE 0 END, 6) >= 0.80 THEN '100m_plus'
       WHEN round(least(0.3, coalesce(boards, 0) * 0.1) + least(0.3, coalesce(degree, 0) * 0.02) + CASE WHEN worth > 100e6 THEN 0.4 ELSE 0 END, 6) >= 0.65 THEN '25m_100m'
       WHEN round(least(0.3, coalesce(boards, 0) * 0.1) + least(0.3, coalesce(degree, 0) * 0.02) + CASE WHEN worth > 100e6 THEN 0.4 ELSE 0 END, 6) >= 0.45 THEN '5m_25m'
       WHEN round(least(0.3, coalesce(boards, 0) * 0.1) + least(0.3, coalesce(degree, 0) * 0.02) + CASE WHEN worth > 100e6 THEN 0.4 ELSE 0 END, 6) >= 0.25 THEN '1m_5m' ELSE 'unknown' END AS band
FROM people p LEFT JOIN n USING (person) LEFT JOIN degrees USING (person)""")
def S14_S16_wealth_by_network(spark, d):
    rows = X.people(spark, d).join(X.memberships(spark, d).groupBy("person").agg(F.count("*").alias("boards")), "person", "left").join(G.degree(pairs(spark, d)), "person", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.round(F.least(F.lit(0.3), zero("boards") * 0.1) + F.least(F.lit(0.3), zero("degree") * 0.02) + F.when(F.col("worth") > 100e6, 0.4).otherwise(0.0), 6)
    band = F.when(F.col("score") >= 0.80, "100m_plus").when(F.col("score") >= 0.65, "25m_100m").when(F.col("score") >= 0.45, "5m_25m").when(F.col("score") >= 0.25, "1m_5m").otherwise("unknown")
    return rows.withColumn("score", score).select("person", "score", band.alias("band"))


@query("""
WITH t AS (SELECT sum(worth) AS total FROM people)
SELECT band, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM people), 6) AS share, round(sum(worth) / any_value(total), 6) AS of_worth FROM people, t GROUP BY 1""")
def A23_A24_portfolio(spark, d):
    who = X.people(spark, d)
    total = who.agg(F.count("*").alias("all"), F.sum("worth").alias("total"))
    out = who.groupBy("band").agg(F.count("*").alias("n"), F.sum("worth").alias("w")).join(F.broadcast(total))  # total is one row
    return out.select("band", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), F.round(F.col("w") / F.col("total"), 6).alias("of_worth"))


@query("SELECT person, CAST((sector IS NOT NULL)::INT + (band <> 'unknown')::INT + (worth > 0)::INT + (EXISTS (SELECT 1 FROM evidence e WHERE e.person = p.person))::INT + (EXISTS (SELECT 1 FROM memberships m WHERE m.person = p.person))::INT AS BIGINT) AS complete FROM people p")
def S25_completeness(spark, d):
    marks = [X.evidence(spark, d).select("person").distinct().withColumn("e", F.lit(1)), X.memberships(spark, d).select("person").distinct().withColumn("m", F.lit(1))]
    rows = X.people(spark, d).join(marks[0], "person", "left").join(marks[1], "person", "left")
    parts = [F.col("sector").isNotNull(), F.col("band") != "unknown", F.col("worth") > 0, F.col("e").isNotNull(), F.col("m").isNotNull()]
    return rows.select("person", sum((p.cast("long") for p in parts), F.lit(0).cast("long")).alias("complete"))


@query("""
WITH runs AS (SELECT run_id, seed, decision_id, score, row_number() OVER (PARTITION BY run_id, seed ORDER BY score DESC, decision_id) AS r FROM decisions),
m AS (SELECT seed, run_id, list_sort(list(r)) AS top, avg(score) AS mean FROM runs WHERE r <= 50 GROUP BY 1, 2)
SELECT a.seed, a.run_id, len(a.top) AS n, round(a.mean, 9) AS mean, round(a.mean - b.mean, 9) AS drift FROM m a LEFT JOIN m b ON a.seed = b.seed AND CAST(a.run_id AS INT) = CAST(b.run_id AS INT) + 1""")
def A30_reproducibility(spark, d):
    top = G.top_of_each(X.decisions(spark, d), ["run_id", "seed"], [F.desc("score"), F.col("decision_id")], 50)
    m = top.groupBy("seed", "run_id").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    before = F.lag("m").over(Window.partitionBy("seed").orderBy("run_id"))
    prior = F.lag("run_id").over(Window.partitionBy("seed").orderBy("run_id"))
    near = F.when(prior.cast("int") == F.col("run_id").cast("int") - 1, before)
    return m.withColumn("b", near).select("seed", "run_id", "n", F.round("m", 9).alias("mean"), F.round(F.col("m") - F.col("b"), 9).alias("drift"))


@query(LEADS + "SELECT person, connections > 0 OR capacity > 0 OR affinity > 0 AS real FROM scored")
def F2_real_signal(spark, d):
    rows = score_leads(lead_inputs(X.people(spark, d), pairs(spark, d), X.memberships(spark, d), X.donations(spark, d).where("amount > 250000"), X.evidence(spark, d)), "2024-01-31")
    real = real_signal(rows).select(F.col("person").alias("_p"))
    return rows.join(real, F.col("person") == F.col("_p"), "left").select("person", F.col("_p").isNotNull().alias("real"))


@query("""
SELECT 'band' AS of, band AS type, count(*) AS n FROM people GROUP BY 2 UNION ALL SELECT 'mention', kind, count(*) FROM mentions GROUP BY 2 UNION ALL SELECT 'relationship', kind, count(*) FROM relationships GROUP BY 2 UNION ALL SELECT 'evidence', source, count(*) FROM evidence GROUP BY 2""")
def A24_store_stats(spark, d):
    parts = [("band", X.people(spark, d), "band"), ("mention", X.mentions(spark, d), "kind"), ("relationship", X.relationships(spark, d), "kind"), ("evidence", X.evidence(spark, d), "source")]
    counted = [df.groupBy(F.col(c).alias("type")).agg(F.count("*").alias("n")).select(F.lit(of).alias("of"), "type", "n") for of, df, c in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])
