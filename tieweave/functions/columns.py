"""Column functions: text keys, similarities and scores. No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STRENGTH = {
    "TRUSTEE_OF": 1.0, "DIRECTOR_OF": 0.9, "MADE_DONATION": 0.85, "RECEIVED_BY": 0.85,
    "SHARES_AFFILIATION_WITH": 0.8, "REGISTERED_AT": 0.3, "CO_OCCURS_WITH": 0.2, "MENTIONED_IN": 0.2,
}
PRIORITY_WEIGHTS = {"introability": 0.30, "affinity": 0.25, "capacity": 0.20, "influence": 0.15, "fit": 0.10}
CONFIDENCE_WEIGHTS = {"identity": 0.35, "relationship": 0.30, "corroboration": 0.20, "freshness": 0.15}
SEED_WEIGHTS = {"strong": 0.30, "recent": 0.25, "affiliations": 0.20, "intros": 0.15, "identity": 0.10}
CAPACITY = {  # category: (weight, scale)
    "donations": (0.20, 0.5), "foundation_roles": (0.15, 1.0), "senior_roles": (0.15, 1.0), "directorships": (0.15, 0.8),
    "board_memberships": (0.10, 0.8), "philanthropy": (0.10, 0.7), "leadership_roles": (0.08, 1.0), "institutions": (0.07, 0.8),
}
TRUST = {"shared_board": 0.9, "co_director": 0.9, "co_trustee": 0.85, "shared_employer": 0.6, "corpus_mention": 0.5, "inferred": 0.4, "direct": 0.95}
TITLES = "professor|prof|reverend|rev|dame|sir|lord|lady|dr|mr|mrs|ms|miss"
CHARITY_WORDS = r"(?i)\b(foundation|charit\w*|trust|charitable|fund|institute|appeal|society)\b"
POSTCODE = r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})\b"


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(F.lit(default))


def weighted(weights: dict[str, float], values: dict[str, Column]) -> Column:
    """The clamped sum of clamped values by weight, in the order of the weights."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * clamp01(values[name])
    return clamp01(total)


def base_strength(kind: Column) -> Column:
    return lookup(STRENGTH, kind, 0.2)


def freshness(year: Column, reference_year: int) -> Column:
    age = F.lit(reference_year) - year
    return F.when(year.isNull(), 0.6).when(age <= 2, 1.0).when(age <= 5, 0.75).when(age <= 10, 0.5).otherwise(0.25)


def diminishing(n: Column, scale: float) -> Column:
    return F.when(n > 0, 1 - 1 / (1 + n * scale)).otherwise(0.0)


def capacity_signal(counts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, (w, scale) in CAPACITY.items():
        total = total + F.lit(w) * diminishing(counts.get(name, F.lit(0)), scale)
    return clamp01(total)


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the lower-cased, trimmed string, padded with two spaces before and one behind."""
    padded = F.concat(F.lit("  "), F.lower(F.trim(s)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays; 0 if both are empty or one is null."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).otherwise(jaccard(trigrams(a), trigrams(b)))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, unequally long or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))).otherwise(0.0)


def tokens_of(s: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(s)), r"\s+"), lambda t: t != "")


def normalise_name(s: Column) -> Column:
    tidy = F.initcap(F.lower(F.regexp_replace(F.trim(s), r"\s+", " ")))
    return F.trim(F.regexp_replace(tidy, rf"(?i)^({TITLES})\.?\s+", ""))


def seed_key(s: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(s)), rf"^({TITLES})\.?\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s+(obe|cbe|mbe|kbe|dbe|qc|kc|phd|md)$", ""), r"\s+", " "))


def first_last(s: Column) -> Column:
    """First and last token of two letters or more; null with fewer than two of them."""
    t = F.filter(tokens_of(s), lambda x: F.length(x) > 1)
    return F.when(F.size(t) >= 2, F.concat_ws("|", F.element_at(t, 1), F.element_at(t, -1)))


def postcode(s: Column) -> Column:
    found = F.upper(F.concat_ws(" ", F.regexp_extract(s, POSTCODE, 1), F.regexp_extract(s, POSTCODE, 2)))
    return F.when(s.rlike(POSTCODE), found)


def normalise_address(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"\s+", " "), r"\s*,\s*", ", "))


def charity_number(s: Column) -> Column:
    digits = F.regexp_replace(s, r"\D", "")
    return F.when(F.length(digits).between(6, 7), F.lpad(digits, 7, "0"))


def company_number(s: Column) -> Column:
    """Eight characters: SC or NI and up to six digits, or up to eight digits; null if the number isn't valid."""
    plain = F.upper(F.trim(s))
    digits = F.regexp_replace(plain, r"\D", "")
    marked = plain.rlike(r"^(SC|NI)\d+$")
    return F.when(marked & (F.length(digits) <= 6), F.concat(F.substring(plain, 1, 2), F.lpad(digits, 6, "0"))).when(~marked & F.length(digits).between(1, 8), F.lpad(digits, 8, "0"))


def edge_class(kind: Column, via: Column) -> Column:
    t, via = F.upper(F.coalesce(kind, F.lit(""))), F.coalesce(via, F.lit(""))
    charity = via.rlike(CHARITY_WORDS)
    board = F.when(charity, "co_trustee").otherwise("shared_board")
    work = F.when(charity, "co_trustee").otherwise("shared_employer")
    return (
        F.when(t.startswith("CO_DIRECTOR"), "co_director").when(t.startswith("TRUSTEE"), "co_trustee").when(t.startswith("DIRECTOR"), board)
        .when(t == "FAMILY_MEMBER", "direct").when(t.startswith("INFERRED"), "inferred").when(t.startswith("MENTIONED") | t.startswith("CO_OCCUR"), "corpus_mention")
        .when(t.startswith("SHARES_AFFILIATION") | (t == "ASSOCIATE"), work).when(t.isin("MADE_DONATION", "RECEIVED_BY"), "direct")
        .when(via != "", work).otherwise("inferred")
    )


def tie_strength(kind: Column, appointed_year: Column, resigned_year: Column, reasons: Column, now_year: int) -> Column:
    """Trust of an edge class x recency (classes with dates only) x a boost of 5 % for each further reason, at most 15 %."""
    dated = kind.isin("co_director", "shared_board", "co_trustee")
    recency = F.when(~dated, 1.0).when(appointed_year.isNull() & resigned_year.isNull(), 0.8).when(resigned_year.isNull(), 1.0).when(F.lit(now_year) - resigned_year <= 2, 0.7).otherwise(0.4)
    return clamp01(lookup(TRUST, kind, 0.4) * recency * F.when(reasons <= 1, 1.0).otherwise(F.least(F.lit(1.15), 1 + (reasons - 1) * 0.05)))


def warmth(strength: Column) -> Column:
    return F.when(strength >= 0.7, "warm").when(strength >= 0.45, "cool").otherwise("cold")


def wealth_band(worth: Column) -> Column:
    return F.when(worth >= 100e6, "100m_plus").when(worth >= 25e6, "25m_100m").when(worth >= 5e6, "5m_25m").when(worth >= 1e6, "1m_5m").otherwise("unknown")


def decision_band(score: Column) -> Column:
    return F.when(score >= 0.90, "auto_merge").when(score >= 0.75, "provisional").when(score >= 0.55, "possible_duplicate").otherwise("separate")
