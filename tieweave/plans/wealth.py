"""Queries of wealth bands, capacity and matches of registries and articles (S3, S14, S16, R26, R27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieweave.functions import columns as C
from tieweave.operators import graph as G
from tieweave.operators import match as M
from tieweave.operators import wealth as W
from tieweave.plans.base import query
from tieweave.sources import fixtures as X

PSC = "max(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END)"


def seats(spark, d):
    """(person, company, resigned, controlled, high_value): directorships, with control and branch of trade from the given tables."""
    rows = X.lines(spark, d).where("l_returnflag = 'A' and l_quantity >= 45").groupBy("o_custkey", "l_partkey").agg(
        F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("resigned"), F.max(F.when(F.col("l_discount") >= 0.08, 1).otherwise(0)).alias("controlled"))
    sic = F.when(F.col("p_type") == "PROMO", "66300").when(F.col("p_type") == "SMALL", "68100").otherwise("47110")
    trade = X.table(spark, d, "part").select("p_partkey", sic.isin(W.HIGH_VALUE_SICS).cast("int").alias("high_value"))
    return rows.join(trade, F.col("l_partkey") == F.col("p_partkey")).select(X.pid("o_custkey").alias("person"), X.cid("l_partkey").alias("company"), "resigned", "controlled", "high_value")


def per_person(people, *parts):
    out = people
    for part in parts:
        out = out.join(part, "person", "left")
    return out


BANDED = """CASE WHEN score >= 0.80 THEN '100m_plus' WHEN score >= 0.65 THEN '25m_100m' WHEN score >= 0.45 THEN '5m_25m' WHEN score >= 0.25 THEN '1m_5m' ELSE 'unknown' END"""
CO = "co AS (SELECT p AS person, count(DISTINCT q) AS co_directors FROM (SELECT x.person AS p, y.person AS q FROM codirectors x JOIN codirectors y ON x.company = y.company AND x.person <> y.person JOIN (SELECT company FROM codirectors GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40) g ON g.company = x.company) GROUP BY 1)"


@query(f"""
WITH seat AS (SELECT o_custkey, l_partkey, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS resigned, {PSC} AS controlled FROM lines WHERE l_returnflag = 'A' AND l_quantity >= 45 GROUP BY 1, 2),
a AS (SELECT 'p:' || o_custkey AS person, count(*) FILTER (resigned = 0) AS active, sum(controlled) AS controlled, sum(CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 1 ELSE 0 END) AS high_value FROM seat JOIN part ON p_partkey = l_partkey GROUP BY 1),
g AS (SELECT 'p:' || o_custkey AS person, sum(CAST(o_totalprice AS DOUBLE)) / 20 AS donated FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
t AS (SELECT person, count(*) AS trusteeships, sum(CAST(p_retailprice AS DOUBLE)) * 1000 AS charity_income FROM memberships JOIN part ON company = 'c:' || p_partkey GROUP BY 1),
f AS (SELECT 'p:' || o_custkey AS person, count(*) AS regulated FROM lines WHERE l_returnflag = 'N' AND l_quantity = 50 GROUP BY 1),
e AS (SELECT 'p:' || user_id AS person, count(*) FILTER (event_type = 'error') AS articles, count(*) FILTER (event_type = 'purchase' AND value > 15) AS web_signals FROM events GROUP BY 1), {CO},
j AS (SELECT p.person, coalesce(active, 0) AS active, coalesce(controlled, 0) AS controlled, coalesce(high_value, 0) AS high_value, coalesce(donated, 0) AS donated, coalesce(charity_income, 0) AS charity_income, coalesce(trusteeships, 0) AS trusteeships, coalesce(regulated, 0) AS regulated,
  worth > 150e6 AS rich_list, coalesce(articles, 0) AS articles, coalesce(web_signals, 0) AS web_signals, coalesce(co_directors, 0) AS co_directors FROM people p LEFT JOIN a USING (person) LEFT JOIN g USING (person) LEFT JOIN t USING (person) LEFT JOIN f USING (person) LEFT JOIN e USING (person) LEFT JOIN co USING (person)),
s AS (SELECT person, round(least(1.0, least(active * 0.015, 0.15) + least(controlled * 0.05, 0.20) + least(high_value * 0.05, 0.15) + CASE WHEN donated >= 100000 THEN 0.15 WHEN donated >= 25000 THEN 0.10 WHEN donated >= 5000 THEN 0.05 ELSE 0 END
  + CASE WHEN charity_income >= 10000000 THEN 0.15 WHEN charity_income >= 1000000 THEN 0.10 WHEN charity_income >= 100000 THEN 0.05 ELSE 0 END + least(trusteeships * 0.025, 0.10) + CASE WHEN regulated > 0 THEN 0.05 ELSE 0 END + CASE WHEN rich_list THEN 0.20 ELSE 0 END
  + CASE WHEN articles >= 5 THEN 0.05 ELSE 0 END + least(web_signals * 0.05, 0.15) + CASE WHEN co_directors >= 5 THEN least(co_directors * 0.005, 0.10) ELSE 0 END)::DOUBLE, 6) AS score,
  (active > 0)::INT + (controlled > 0)::INT + (high_value > 0)::INT + (donated > 0)::INT + (charity_income > 0)::INT + (trusteeships > 0)::INT + (regulated > 0)::INT + rich_list::INT + (articles >= 5)::INT + (web_signals > 0)::INT + (co_directors >= 5)::INT AS signals FROM j)
SELECT person, score, {BANDED} AS band, round(least(0.95, 0.5 + 0.05 * signals), 6) AS confidence, signals FROM s""")
def S14_registry_sweep(spark, d):
    """Bands from eleven contributions of registries and the web."""
    n = lambda df, **sums: df.groupBy("person").agg(*[v.alias(k) for k, v in sums.items()])
    own = n(seats(spark, d), active=F.count_if(F.col("resigned") == 0), controlled=F.sum("controlled"), high_value=F.sum("high_value"))
    orders = X.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(X.pid("o_custkey").alias("person"), F.col("o_totalprice").cast("double").alias("v"))
    income = X.table(spark, d, "part").select(X.cid("p_partkey").alias("company"), F.col("p_retailprice").cast("double").alias("i"))
    boards = n(X.memberships(spark, d).join(income, "company"), trusteeships=F.count("*"), charity_income=F.sum("i") * 1000)
    regulated = n(X.lines(spark, d).where("l_returnflag = 'N' and l_quantity = 50").select(X.pid("o_custkey").alias("person")), regulated=F.count("*"))
    seen = n(X.table(spark, d, "events").select(F.concat(F.lit("p:"), F.col("user_id").cast("string")).alias("person"), "event_type", "value"), articles=F.count_if(F.col("event_type") == "error"), web_signals=F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 15)))
    pairs = G.co_members(X.codirectors(spark, d).select("person", "company")).select("a", "b").distinct()
    co = n(G.both_ways(pairs).withColumnRenamed("a", "person"), co_directors=F.count("*"))
    people = X.people(spark, d).select("person", (F.col("worth") > 150e6).alias("rich_list"))
    out = W.registry_bands(per_person(people, own, n(orders, donated=F.sum("v") / 20), boards, regulated, seen, co))
    return out.select("person", "score", "band", "confidence", F.size("evidence").alias("signals"))


TEXT = "CASE event_type WHEN 'purchase' THEN 'Bought a £' || CAST(floor(value * 3) AS BIGINT) || 'm property portfolio' WHEN 'signup' THEN CASE WHEN value > 20 THEN 'On the Forbes rich list' ELSE 'Joined a club' END WHEN 'click' THEN CASE WHEN value > 15 THEN 'Private equity investment' ELSE '' END WHEN 'view' THEN CASE WHEN value > 45 THEN 'A billionaire, some say' ELSE 'Nothing known' END END"


@query(f"""
WITH r AS (SELECT src AS person, count(*) FILTER (kind = 'DIRECTOR_OF') AS directorships, count(DISTINCT CASE WHEN kind = 'DIRECTOR_OF' AND p_name LIKE 'red %' THEN dst END) AS charities, count(*) FILTER (kind = 'TRUSTEE_OF' AND confidence >= 0.9) AS co_trustees FROM relationships JOIN part ON dst = 'c:' || p_partkey GROUP BY 1), {CO},
x AS (SELECT 'p:' || user_id AS person, ts, event_id, lower({TEXT}) AS t FROM events),
y AS (SELECT person, bool_or(regexp_matches(t, '\\bbillion|billionaire\\b')) AS billion, arg_min(CAST(nullif(regexp_extract(t, '[£$]\\s*(\\d+)\\s*(?:m\\b|million)', 1), '') AS BIGINT), (ts, event_id)) FILTER (regexp_extract(t, '[£$]\\s*(\\d+)\\s*(?:m\\b|million)', 1) <> '') AS million,
  bool_or(regexp_matches(t, 'rich list|sunday times|forbes')) AS rich, bool_or(regexp_matches(t, 'property|real estate|portfolio')) AS property, bool_or(regexp_matches(t, 'hedge fund|private equity|\\bfund\\b|investment')) AS fund FROM x GROUP BY 1),
j AS (SELECT p.person, coalesce(directorships, 0) AS n, coalesce(co_directors, 0) AS co, coalesce(charities, 0) + coalesce(co_trustees, 0) AS g, coalesce(billion, false) AS billion, million, coalesce(rich, false) AS rich, coalesce(property, false) AS property, coalesce(fund, false) AS fund FROM people p LEFT JOIN r USING (person) LEFT JOIN co USING (person) LEFT JOIN y USING (person) WHERE band IN ('unknown', '1m_5m', '5m_25m')),
s AS (SELECT person, round(least(1.0, least(n * 0.015, 0.15) + CASE WHEN co >= 3 THEN least(co * 0.006, 0.12) ELSE 0 END + least(g * 0.03, 0.12) + CASE WHEN billion THEN 0.25 WHEN million IS NULL THEN 0 WHEN million >= 100 THEN 0.20 WHEN million >= 25 THEN 0.15 WHEN million >= 5 THEN 0.10 ELSE 0.05 END
  + CASE WHEN rich THEN 0.15 ELSE 0 END + CASE WHEN property THEN 0.05 ELSE 0 END + CASE WHEN fund THEN 0.10 ELSE 0 END)::DOUBLE, 6) AS score, (n > 0)::INT + (co >= 3)::INT + (g > 0)::INT + (billion OR million IS NOT NULL)::INT + rich::INT + property::INT + fund::INT AS signals FROM j)
SELECT * FROM (SELECT person, score, {BANDED} AS band, round(least(0.85, 0.35 + 0.08 * signals), 6) AS confidence FROM s) WHERE band <> 'unknown'""")
def S16_network_position(spark, d):
    """Bands from the network and from evidence texts, for people without a higher band yet."""
    part = X.table(spark, d, "part").select(X.cid("p_partkey").alias("dst"), F.col("p_name").startswith("red ").alias("charity"))
    rel = X.relationships(spark, d).join(part, "dst").groupBy(F.col("src").alias("person")).agg(
        F.count_if(F.col("kind") == "DIRECTOR_OF").alias("directorships"), F.count_distinct(F.when((F.col("kind") == "DIRECTOR_OF") & F.col("charity"), F.col("dst"))).alias("charities"),
        F.count_if((F.col("kind") == "TRUSTEE_OF") & (F.col("confidence") >= 0.9)).alias("co_trustees"))
    pairs = G.co_members(X.codirectors(spark, d).select("person", "company")).select("a", "b").distinct()
    co = G.both_ways(pairs).groupBy(F.col("a").alias("person")).agg(F.count("*").alias("co_directors"))
    texts = X.table(spark, d, "events").select(F.concat(F.lit("p:"), F.col("user_id").cast("string")).alias("person"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.expr(TEXT).alias("text"))
    people = X.people(spark, d)
    out = W.network_bands(per_person(people.select("person"), rel, co, W.text_signals(texts)), people.where("band in ('25m_100m', '100m_plus')").select("person"))
    return out.select("person", "score", "band", "confidence")


@query("""
WITH r AS (SELECT src AS person, count(*) FILTER (kind = 'TRUSTEE_OF') AS foundation, count(*) FILTER (kind = 'DIRECTOR_OF' AND confidence >= 0.9) AS senior, count(*) FILTER (kind = 'DIRECTOR_OF') AS directorships, count(DISTINCT CASE WHEN kind <> 'SHARES_AFFILIATION_WITH' THEN dst END) AS boards,
  count(*) FILTER (kind = 'SHARES_AFFILIATION_WITH') AS philanthropy, count(*) FILTER (kind = 'TRUSTEE_OF' AND reliability >= 0.97) AS leadership FROM relationships GROUP BY 1),
g AS (SELECT donor AS person, count(*) AS gifts FROM donations GROUP BY 1), e AS (SELECT person, count(DISTINCT source) AS insts FROM evidence GROUP BY 1)
SELECT p.person, round(0.20 * (1 - 1 / (1 + coalesce(gifts, 0) * 0.5)) + 0.15 * (1 - 1 / (1 + coalesce(foundation, 0) * 1.0)) + 0.15 * (1 - 1 / (1 + coalesce(senior, 0) * 1.0)) + 0.15 * (1 - 1 / (1 + coalesce(directorships, 0) * 0.8)) + 0.10 * (1 - 1 / (1 + coalesce(boards, 0) * 0.8))
  + 0.10 * (1 - 1 / (1 + coalesce(philanthropy, 0) * 0.7)) + 0.08 * (1 - 1 / (1 + coalesce(leadership, 0) * 1.0)) + 0.07 * (1 - 1 / (1 + coalesce(insts, 0) * 0.8)), 6) AS capacity FROM people p LEFT JOIN r USING (person) LEFT JOIN g USING (person) LEFT JOIN e USING (person)""")
def S3_capacity_of_eight(spark, d):
    """Capacity from all eight counts: gifts, trusteeships, senior roles, directorships, boards, affiliations, leading roles and institutions."""
    is_ = lambda kind: F.col("kind") == kind
    rel = X.relationships(spark, d).groupBy(F.col("src").alias("person")).agg(
        F.count_if(is_("TRUSTEE_OF")).alias("foundation_roles"), F.count_if(is_("DIRECTOR_OF") & (F.col("confidence") >= 0.9)).alias("senior_roles"), F.count_if(is_("DIRECTOR_OF")).alias("directorships"),
        F.count_distinct(F.when(F.col("kind") != "SHARES_AFFILIATION_WITH", F.col("dst"))).alias("board_memberships"), F.count_if(is_("SHARES_AFFILIATION_WITH")).alias("philanthropy"), F.count_if(is_("TRUSTEE_OF") & (F.col("reliability") >= 0.97)).alias("leadership_roles"))
    gifts = X.donations(spark, d).groupBy(F.col("donor").alias("person")).agg(F.count("*").alias("donations"))
    insts = X.evidence(spark, d).groupBy("person").agg(F.count_distinct("source").alias("institutions"))
    out = per_person(X.people(spark, d).select("person"), rel, gifts, insts)
    return out.select("person", F.round(C.capacity_signal({k: F.coalesce(k, F.lit(0)) for k in C.CAPACITY}), 6).alias("capacity"))


def described(spark, d):
    """Person mentions as entities, with a number, a role or none, an organisation or none, and a kind."""
    n = F.col("n")
    rows = X.mentions(spark, d).where("kind = 'person'")
    return rows.select(F.col("mention").alias("entity"), F.col("value").alias("name"), (n * 2).cast("string").alias("number"), F.when(n % 3 == 0, " Chair").when(n % 3 == 1, "trustee").alias("role"), F.when(n % 5 != 0, F.col("org")).alias("org"), F.lit("person").alias("kind"))


ENTITIES = """e AS (SELECT mention AS entity, value AS name, CAST(n * 2 AS VARCHAR) AS number, CASE n % 3 WHEN 0 THEN ' Chair' WHEN 1 THEN 'trustee' END AS role, CASE WHEN n % 5 <> 0 THEN org END AS org, list_distinct(list_filter(string_split(value, ' '), lambda x: x <> '')) AS w, list_distinct(list_filter(string_split(lower(org), ' '), lambda x: x <> '')) AS ow FROM mentions WHERE kind = 'person'),
r AS (SELECT 'c:' || p_partkey AS record, CAST(p_partkey AS VARCHAR) AS number, CASE p_partkey % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'Trustee' WHEN 2 THEN 'treasurer' END AS role, list_distinct(string_split(lower(p_name), ' ')) AS w, list_distinct(string_split(lower(p_brand || ' Foundation'), ' ')) AS tw FROM part)"""


def registry_sql(name, number, role, org):
    jac = lambda a, b: f"len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE)"
    score = f"{name} * {jac('e.w', 'r.w')} + {number} * CASE WHEN e.number = r.number THEN 1 ELSE 0 END + {role} * CASE WHEN e.role IS NOT NULL AND r.role IS NOT NULL THEN CASE WHEN lower(trim(e.role)) = lower(r.role) THEN 1.0 ELSE 0 END WHEN r.role IS NOT NULL THEN 0.3 ELSE 0 END + {org} * CASE WHEN e.org IS NOT NULL THEN {jac('e.ow', 'r.tw')} ELSE 0 END"
    return f"WITH {ENTITIES}, m AS (SELECT entity, min((-round(({score})::DOUBLE, 6), record)) AS b FROM e JOIN r ON len(list_intersect(e.w, r.w)) > 0 OR e.number = r.number GROUP BY 1) SELECT entity, b[2] AS record, -b[1] AS confidence FROM m WHERE -b[1] > 0.1"


def registry_records(spark, d):
    key = F.col("p_partkey")
    return X.table(spark, d, "part").select(
        X.cid("p_partkey").alias("record"), F.lower("p_name").alias("name"), key.cast("string").alias("number"), F.when(key % 4 == 0, "chair").when(key % 4 == 1, "Trustee").when(key % 4 == 2, "treasurer").alias("role"), F.concat("p_brand", F.lit(" Foundation")).alias("title"))


@query(registry_sql(0.50, 0.30, 0.20, 0.0))
def R26_officer_match(spark, d):
    return M.registry_best(described(spark, d), registry_records(spark, d), M.OFFICER)


@query(registry_sql(0.50, 0.25, 0.15, 0.10))
def R26_trustee_match(spark, d):
    return M.registry_best(described(spark, d), registry_records(spark, d), M.TRUSTEE)


def article_sql(name, description, type_):
    terms = " OR ".join(f"contains(r.d, '{t}')" for t in M.PERSON_TERMS)
    rel = "CASE WHEN contains(r.d, 'person') THEN 0.6 ELSE 0 END + CASE WHEN e.org IS NOT NULL AND contains(r.d, lower(e.org)) THEN 0.4 ELSE 0 END"
    score = f"{name} * len(list_intersect(e.w, r.w)) / CAST(len(e.w) + len(r.w) - len(list_intersect(e.w, r.w)) AS DOUBLE) + {description} * CASE WHEN {rel} > 0 THEN {rel} WHEN length(r.d) > 0 THEN 0.1 ELSE 0 END + {type_} * CASE WHEN {terms} THEN 1 ELSE 0 END"
    return f"""WITH {ENTITIES.split("),\nr AS (")[0]}), r AS (SELECT 'c:' || p_partkey AS record, list_distinct(string_split(lower(p_name), ' ')) AS w, coalesce(lower({ARTICLE}), '') AS d FROM part),
m AS (SELECT entity, min((-round(({score})::DOUBLE, 6), record)) AS b FROM e JOIN r ON len(list_intersect(e.w, r.w)) > 0 GROUP BY 1) SELECT entity, b[2] AS record, -b[1] AS confidence FROM m WHERE -b[1] > 0.1"""


ARTICLE = "CASE p_size % 5 WHEN 0 THEN 'A person, philanthropist of ' || p_brand WHEN 1 THEN 'Charity founded by ' || p_brand WHEN 2 THEN 'politician born in 1950' WHEN 3 THEN 'a village' END"


def articles(spark, d):
    return X.table(spark, d, "part").select(X.cid("p_partkey").alias("record"), F.lower("p_name").alias("name"), F.expr(ARTICLE).alias("description"))


@query(article_sql(0.60, 0.25, 0.15))
def R27_knowledge_base_match(spark, d):
    return M.article_best(described(spark, d), articles(spark, d), M.KNOWLEDGE_BASE)


@query(article_sql(0.55, 0.25, 0.20))
def R27_encyclopaedia_match(spark, d):
    return M.article_best(described(spark, d), articles(spark, d), M.ENCYCLOPAEDIA)
