"""Queries of imported lists, staged entities, cross-reference, presentation and signals (R15 to R18, R22, S20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieweave.operators import match as M
from tieweave.operators import resolve as R
from tieweave.operators import signals as S
from tieweave.operators.components import saved
from tieweave.plans.base import query
from tieweave.plans.resolve import GRAMS, SIM
from tieweave.sources import fixtures as X


def variants(spark, d):
    """Every person mention with name as a list would spell it: as it is, with a title behind, the first word alone, without the last letter, or turned round."""
    words = F.split("value", " ")
    n = F.col("n") % 5
    name = F.when(n == 0, F.col("value")).when(n == 1, F.concat("value", F.lit(" obe"))).when(n == 2, words[0]).when(n == 3, F.expr("left(value, length(value) - 1)")).otherwise(F.concat(F.try_element_at(words, F.lit(2)), F.lit(" "), words[0]))
    return X.mentions(spark, d).where("kind = 'person'").withColumn("name", F.coalesce(name, "value"))


def known_people(spark, d):
    rows = X.mentions(spark, d).where("kind = 'person'")
    return rows.select(F.concat(F.lit("p:"), F.col("n").cast("string")).alias("id"), F.col("value").alias("name"), F.concat("org", F.lit(" "), "role").alias("attributes"))


MATCHES = f"""
v AS (SELECT *, coalesce(CASE n % 5 WHEN 0 THEN value WHEN 1 THEN value || ' obe' WHEN 2 THEN string_split(value, ' ')[1] WHEN 3 THEN left(value, length(value) - 1) ELSE string_split(value, ' ')[2] || ' ' || string_split(value, ' ')[1] END, value) AS name FROM mentions WHERE kind = 'person'),
known AS (SELECT 'p:' || n AS id, value AS name, org || ' ' || role AS attributes, [lower(org), lower(role)] AS orgs, 'AB' || (n % 9 + 1) || ' ' || (n % 10) || 'XY' AS postcode FROM mentions WHERE kind = 'person'),
sx AS (SELECT DISTINCT name AS v, {GRAMS.format("name")} AS g FROM v), sy AS (SELECT DISTINCT name AS v, {GRAMS.format("name")} AS g FROM known),
sim AS MATERIALIZED (SELECT x.v AS name, y.v AS other, {SIM} AS s FROM sx x JOIN sy y ON {SIM} >= 0.5)"""
NEW = "'n:' || substr(sha256(id || '|' || name), 1, 16)"


@query(f"""
WITH {MATCHES}, i AS (SELECT 'i:' || n AS id, name, CASE n % 3 WHEN 0 THEN org WHEN 1 THEN 'brand#1' END AS affiliation FROM v),
m AS (SELECT i.id, min((-round(least(1.0, s + CASE WHEN contains(lower(k.attributes), lower(affiliation)) THEN 0.05 ELSE 0 END), 6), k.id)) AS b FROM i JOIN sim USING (name) JOIN known k ON k.name = sim.other GROUP BY 1)
SELECT i.id, coalesce(-b[1], 0) AS score, b[2] AS match, CASE WHEN -b[1] >= 0.95 THEN 'linked' WHEN -b[1] >= 0.85 THEN 'quarantined' ELSE 'created' END AS action, CASE WHEN -b[1] >= 0.95 THEN b[2] ELSE {NEW.replace("(id", "(i.id").replace("name", "i.name")} END AS entity FROM i LEFT JOIN m USING (id)""")
def R15_seed_bootstrap(spark, d):
    belongs = F.when(F.col("n") % 3 == 0, F.col("org")).when(F.col("n") % 3 == 1, "brand#1")
    rows = variants(spark, d).select(F.concat(F.lit("i:"), F.col("n").cast("string")).alias("id"), "name", belongs.alias("affiliation"))
    return M.bootstrap_seeds(rows, known_people(spark, d)).select("id", "score", "match", "action", "entity")


@query(f"""
WITH {MATCHES}, r AS (SELECT 't:' || n AS target, CASE WHEN n % 7 = 0 THEN ' (household) ' WHEN n % 4 = 2 THEN name || ' (Household)' ELSE '(household) ' || name END AS raw, CASE WHEN n % 7 = 0 THEN '' ELSE name END AS name FROM v),
m AS (SELECT sim.name, min((-round(s, 6), k.id)) AS b FROM sim JOIN known k ON k.name = sim.other GROUP BY 1)
SELECT target, b[2] AS introducer, 1 AS tier, 'spreadsheet_declared' AS kind, raw FROM r JOIN m USING (name) WHERE name <> '' AND -b[1] >= 0.85""")
def R16_introducers(spark, d):
    raw = F.when(F.col("n") % 7 == 0, " (household) ").when(F.col("n") % 4 == 2, F.concat("name", F.lit(" (Household)"))).otherwise(F.concat(F.lit("(household) "), "name"))
    rows = variants(spark, d).select(F.concat(F.lit("t:"), F.col("n").cast("string")).alias("target"), raw.alias("introduced_by"))
    return M.introducer_routes(rows, known_people(spark, d))


STAGED = f"""{MATCHES}, i AS (SELECT n, 's:' || n AS id, name, CASE WHEN n % 3 = 0 THEN org END AS affiliation, CASE WHEN n % 2 = 0 THEN role ELSE 'CEO' END AS role FROM v),
m AS (SELECT i.id, min((-round(least(1.0, s + CASE WHEN contains(lower(k.attributes), lower(coalesce(affiliation, role))) THEN 0.10 ELSE 0 END + CASE WHEN length(role) > 3 AND contains(lower(k.attributes), lower(role)) THEN 0.05 ELSE 0 END), 6), k.id)) AS b FROM i JOIN sim USING (name) JOIN known k ON k.name = sim.other GROUP BY 1),
o AS (SELECT i.n, i.id, CASE WHEN -b[1] >= 0.90 THEN 'merged' WHEN -b[1] >= 0.75 THEN 'quarantined' ELSE 'promoted' END AS action, CASE WHEN -b[1] >= 0.75 THEN b[2] END AS candidate, CASE WHEN -b[1] >= 0.90 THEN b[2] WHEN -b[1] >= 0.75 THEN NULL ELSE {NEW.replace("(id", "(i.id").replace("name", "i.name")} END AS entity, coalesce(-b[1], 0) AS score FROM i LEFT JOIN m USING (id))"""


def promoted(spark, d):
    v = variants(spark, d)
    staged = v.select(F.concat(F.lit("s:"), F.col("n").cast("string")).alias("id"), "name", F.when(F.col("n") % 3 == 0, F.col("org")).alias("affiliation"), F.when(F.col("n") % 2 == 0, F.col("role")).otherwise("CEO").alias("role"))
    edges = v.select(F.concat(F.lit("p:"), (F.col("n") + 1).cast("string")).alias("source"), F.concat(F.lit("s:"), F.col("n").cast("string")).alias("staged"))
    return M.promote_staged(staged, known_people(spark, d), edges)


@query(f"WITH {STAGED} SELECT id, action, candidate, entity, score FROM o")
def R17_promotion(spark, d):
    return promoted(spark, d)[0]


@query(f"""
WITH {STAGED} SELECT 'p:' || (n + 1) AS source, id AS staged, entity AS connected, CASE WHEN action = 'merged' THEN entity END AS canonical FROM o""")
def R17_repointed_edges(spark, d):
    """Edges of staged entities with what these became, and the alias that stands for a merged one."""
    _, aliases, edges = promoted(spark, d)
    return edges.join(aliases.select(F.col("alias").alias("staged"), "canonical"), "staged", "left")


CROSSED = f"""{MATCHES}, i AS (SELECT 'i:' || n AS id, name, CASE WHEN n % 2 = 0 THEN ['unknown organisation', lower(org)] ELSE [] END AS orgs, CASE WHEN n % 3 <> 0 THEN 'ab' || (n % 9 + 1) || (n % 10) || 'xy' END AS postcode FROM v),
os AS (SELECT DISTINCT unnest(orgs) AS v FROM (SELECT orgs FROM i UNION ALL SELECT orgs FROM known)), og AS (SELECT v, {GRAMS.format("v")} AS g FROM os), al AS (SELECT x.v AS a, y.v AS b FROM og x JOIN og y ON {SIM} > 0.8),
ap AS (SELECT DISTINCT i.orgs, k.orgs AS k_orgs FROM (SELECT DISTINCT orgs FROM i) i, (SELECT DISTINCT orgs FROM known) k WHERE EXISTS (SELECT 1 FROM al WHERE list_contains(i.orgs, al.a) AND list_contains(k.orgs, al.b))),
m AS (SELECT i.id, min((-round(least(1.0, s + CASE WHEN ap.orgs IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN i.postcode = lower(replace(k.postcode, ' ', '')) THEN 0.10 ELSE 0 END), 6), k.id)) AS b
  FROM i JOIN sim USING (name) JOIN known k ON k.name = sim.other LEFT JOIN ap ON ap.orgs = i.orgs AND ap.k_orgs = k.orgs GROUP BY 1),
o AS (SELECT i.id, CASE WHEN -b[1] >= 0.90 THEN 'merged' WHEN -b[1] >= 0.75 THEN 'provisional' ELSE 'no_match' END AS action, CASE WHEN -b[1] >= 0.75 THEN b[2] END AS match, CASE WHEN -b[1] >= 0.75 THEN -b[1] ELSE 0 END AS score FROM i LEFT JOIN m USING (id))"""


def crossed(spark, d):
    n = F.col("n")
    code = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    entities = variants(spark, d).select(code("i:", n).alias("id"), "name", F.when(n % 2 == 0, F.array(F.lit("unknown organisation"), F.lower("org"))).otherwise(F.array().cast("array<string>")).alias("orgs"), F.when(n % 3 != 0, code("ab", n % 9 + 1, n % 10, "xy")).alias("postcode"))
    rows = X.mentions(spark, d).where("kind = 'person'")
    corpus = rows.select(code("p:", n).alias("id"), F.col("value").alias("name"), F.array(F.lower("org"), F.lower("role")).alias("orgs"), code("AB", n % 9 + 1, " ", n % 10, "XY").alias("postcode"))
    return M.cross_reference(entities, corpus, X.relationships(spark, d).withColumnRenamed("relationship_id", "id"))


@query(f"WITH {CROSSED} SELECT * FROM o")
def R18_cross_reference(spark, d):
    return crossed(spark, d)[0]


@query(f"""
WITH {CROSSED}, e AS (SELECT src AS me, dst AS introducer, relationship_id AS via, kind, confidence FROM relationships WHERE confidence >= 0.5 UNION ALL SELECT dst, src, relationship_id, kind, confidence FROM relationships WHERE confidence >= 0.5 AND src <> dst),
f AS (SELECT * FROM e WHERE me IN (SELECT match FROM o WHERE action = 'merged') QUALIFY row_number() OVER (PARTITION BY me ORDER BY confidence DESC, via) <= 50)
SELECT o.id AS target, f.introducer, f.me AS corpus, f.via, f.kind, f.confidence, 3 AS tier FROM o JOIN f ON f.me = o.match WHERE o.action = 'merged'""")
def R18_corpus_routes(spark, d):
    return crossed(spark, d)[1]


@query(f"""
WITH RECURSIVE c AS (SELECT 'c:' || p_partkey AS id, lower(p_name) || ' ' || lower(p_type) AS name, round(CAST(p_retailprice AS DOUBLE) / 2000, 6) AS priority, p_size / 50.0 AS confidence, [p_brand] AS codes, CASE WHEN p_size < 5 THEN ['thin_evidence'] ELSE CAST([] AS VARCHAR[]) END AS warnings, CASE WHEN p_size % 10 = 0 THEN 'g:' || p_partkey END AS grp FROM part),
t AS (SELECT DISTINCT name AS v, {GRAMS.format("name")} AS g FROM c), near AS (SELECT x.v AS a, y.v AS b FROM t x JOIN t y ON {SIM} >= 0.75),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN (SELECT a, b FROM near) n ON n.a = r.b), low AS (SELECT name, min(id) AS id FROM c GROUP BY 1),
lab AS (SELECT r.a AS name, min(low.id) AS g FROM reach r JOIN low ON low.name = r.b GROUP BY 1),
w AS (SELECT lab.g, min((-priority, id)) AS f, list_sort(list(id)) AS members, max(priority) AS priority, max(confidence) AS confidence, list_sort(list_distinct(flatten(list(codes)))) AS codes, list_sort(list_distinct(flatten(list(warnings)))) AS warnings FROM c JOIN lab USING (name) GROUP BY 1)
SELECT coalesce(p.grp, w.g) AS presentation, w.f[2] AS "primary", len(members) AS n, md5(array_to_string(members, ',')) AS members, w.priority, round(w.confidence, 6) AS confidence, array_to_string(w.codes, ',') AS codes, array_to_string(w.warnings, ',') AS warnings, CASE WHEN len(members) > 1 THEN 'pending' END AS decision FROM w JOIN c p ON p.id = w.f[2]""")
def R22_presentation_rows(spark, d):
    part = X.table(spark, d, "part")
    rows = part.select(
        X.cid("p_partkey").alias("id"), F.concat(F.lower("p_name"), F.lit(" "), F.lower("p_type")).alias("name"), F.round(F.col("p_retailprice").cast("double") / 2000, 6).alias("priority"), (F.col("p_size") / 50.0).alias("confidence"),
        F.array("p_brand").alias("codes"), F.when(F.col("p_size") < 5, F.array(F.lit("thin_evidence"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("g:"), F.col("p_partkey").cast("string"))).alias("group"),
    )
    # Equal names are linked through the first row that has them, so that they make a star each and not all their pairs.
    first = saved(rows.groupBy("name").agg(F.min("id").alias("id")))
    stars = rows.join(first.select(F.col("id").alias("a"), "name"), "name").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    near = R.similarity_join(first, first, 0.75).select(F.col("left").alias("a"), F.col("right").alias("b"), "similarity")
    out = M.presentation_rows(rows.drop("name"), saved(stars.unionByName(near).where("a <> b")))
    return out.select("presentation", "primary", F.size("members").cast("long").alias("n"), F.md5(F.array_join("members", ",").cast("binary")).alias("members"), "priority", F.round("confidence", 6).alias("confidence"), F.array_join("codes", ",").alias("codes"), F.array_join("warnings", ",").alias("warnings"), "decision")


ESTIMATE_SIGNAL = {"1-URGENT": "Rich_List_mention", "2-HIGH": "property_signals", "3-MEDIUM": "active_directorships", "4-NOT SPECIFIED": "co_director_network", "5-LOW": "family_trust"}
EVIDENCE_SOURCE = {"purchase": "companies_house", "click": "charity_commission", "view": "web_search", "error": "Guardian_news"}
CASES = lambda column, table: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def sql_rules(text, rules):
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{name}'" for name, parts in rules) + " ELSE 'other' END"


@query(f"""
WITH est AS (SELECT 'p:' || o_custkey AS person, max(o_orderdate) AS seen, list({CASES("o_orderpriority", ESTIMATE_SIGNAL)}) AS e FROM orders GROUP BY o_custkey, year(o_orderdate)),
newest AS (SELECT person, max(seen) AS seen FROM est GROUP BY 1),
s AS (SELECT person, {sql_rules("lower(x)", S.ESTIMATE_RULES)} AS category, 'wealth_model' AS source, CAST(seen AS TIMESTAMP) AS seen FROM (SELECT person, seen, unnest(e) AS x FROM est JOIN newest USING (person, seen)) WHERE x IS NOT NULL
  UNION ALL SELECT person, CASE WHEN contains(src, 'companies_house') AND value > 50 THEN 'charity' ELSE {sql_rules("lower(src)", S.SOURCE_RULES)} END, src, created_at FROM (SELECT 'p:' || user_id AS person, coalesce({CASES("event_type", EVIDENCE_SOURCE)}, event_type) AS src, value, ts AS created_at FROM events)),
c AS (SELECT person, category, count(*) AS n FROM s GROUP BY 1, 2)
SELECT s.person, count(*) AS signals, (SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM c WHERE c.person = s.person) AS by_category, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT source) >= 2 AS multi_source, max(seen) AS newest FROM s GROUP BY s.person""")
def S20_signal_categories(spark, d):
    named = lambda column, table: F.coalesce(*[F.when(F.col(column) == k, v) for k, v in table.items()])
    one = F.struct(named("o_orderpriority", ESTIMATE_SIGNAL).alias("signal"), (F.col("o_totalprice").cast("double") / 500000).alias("contribution"), F.lit(None).cast("string").alias("layer"))
    estimates = X.table(spark, d, "orders").groupBy(X.pid("o_custkey").alias("person"), F.year("o_orderdate").alias("year")).agg(F.max("o_orderdate").alias("assessed_at"), F.collect_list(one).alias("evidence")).drop("year")
    proofs = X.table(spark, d, "events").select(
        F.concat(F.lit("p:"), F.col("user_id").cast("string")).alias("person"), F.coalesce(named("event_type", EVIDENCE_SOURCE), "event_type").alias("source"), F.lit(None).cast("string").alias("layer"),
        F.when(F.col("value") > 50, "Appointed Trustee").otherwise("appointed director").alias("text"), (F.col("value") / 100).alias("confidence"), F.col("ts").alias("created_at"),
    )
    out = S.signal_summary(S.signals(estimates, proofs))
    line = F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("person", "signals", line.alias("by_category"), F.array_join("sources", ",").alias("sources"), "multi_source", "newest")
