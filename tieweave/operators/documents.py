"""Validation of extracted mentions and profiling of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieweave.functions import columns as C
from tieweave.operators.components import saved


def validate(mentions: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """mentions with reason: the first rule (name, whether the row breaks it) that holds, null for accepted rows."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return mentions.withColumn("reason", reason)


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a rejected row keeps its whole record as JSON."""
    columns = [c for c in checked.columns if c != "reason"]
    rejected = checked.where("reason is not null").select("reason", F.to_json(F.struct(*columns)).alias("record"))
    return checked.where("reason is null").drop("reason"), rejected


def first_of_each(mentions: DataFrame, keys: list[str], order: list) -> DataFrame:
    """mentions with duplicate: false for the first of each key in the given order."""
    return mentions.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def refine_confidence(mentions: DataFrame, valid_number: Column, has_postcode: Column, span: Column, keys: tuple[str, ...] = ("doc", "kind", "value")) -> DataFrame:
    """mentions with refined: confidence + .05 (valid number), + .05 (a person met again), + .03 (postcode), - .05 (span under 20), - .03 (met once), clamped."""
    n = mentions.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = mentions.join(n, list(keys))
    add = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    total = (
        F.col("confidence") + add((F.col("kind") == "registration_number") & valid_number, 0.05) + add((F.col("kind") == "person") & (F.col("_n") > 1), 0.05)
        + add((F.col("kind") == "address") & has_postcode, 0.03) + add(span < 20, -0.05) + add(F.col("_n") == 1, -0.03)
    )
    return rows.withColumn("refined", F.round(C.clamp01(total), 6)).drop("_n")


def density(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with counts of names, amounts, numbers and postcodes, the number of lines and the share of empty ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    return docs.withColumns({
        "names": F.regexp_count(t, F.lit("[A-Z][a-z]+ [A-Z][a-z]+")).cast("long"), "amounts": F.regexp_count(t, F.lit(r"[£$€]\s?\d")).cast("long"),
        "numbers": F.regexp_count(t, F.lit(r"\d{7}")).cast("long"), "postcodes": F.regexp_count(t, F.lit(r"[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}")).cast("long"),
        "lines": F.size(lines).cast("long"), "empty_share": F.round(F.size(F.filter(lines, lambda x: F.trim(x) == "")) / F.size(lines), 6),
    })


def seeded(key: str, seed: int) -> Column:
    """A fixed shuffle: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def allocation(sizes: DataFrame, stratum: str, total: int, rule: str = "last") -> DataFrame:
    """sizes(stratum, n) with quota: how many of each stratum make up `total` rows; all rows if there are fewer.

    rule "last": in the order of the strata, each takes its share, rounded half up, but at least one, never more than are left; the last one takes the rest.
    rule "largest_remainder": one for each stratum, then the rest in proportion to what the strata have beyond that one, rounded down, and one more for those
    with the largest remainders (ties to the smaller stratum); with fewer rows than strata the largest strata have one each. The quotas add up to total.
    sizes has a row per stratum, so the windows over all of them are small.
    """
    each = sizes.select(stratum, F.col("n").cast("long").alias("n"))
    order = [F.col(stratum).asc_nulls_first()]
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.least(F.lit(total), F.sum("n").over(every))
    if rule == "last":
        share = F.greatest(F.lit(1), F.floor(F.col("n") * total / F.sum("n").over(every) + 0.5)).cast("long")
        out = each.withColumn("_share", F.least(share, F.col("n"))).withColumn("_left", F.lit(total) - F.coalesce(F.sum("_share").over(before), F.lit(0)))
        last = F.lead(F.lit(1)).over(Window.orderBy(*order)).isNull()
        quota = F.greatest(F.lit(0), F.least(F.when(last, F.col("n")).otherwise(F.col("_share")), F.col("_left")))
        return out.withColumn("quota", quota.cast("long")).drop("_share", "_left")
    if rule != "largest_remainder":
        raise ValueError(rule)
    out = each.withColumns({"_k": F.count("*").over(every), "_w": wanted, "_all": F.sum("n").over(every)})
    rest, spare = F.greatest(F.lit(0), F.col("_w") - F.col("_k")), F.greatest(F.lit(1), F.col("_all") - F.col("_k"))
    out = out.withColumns({"_floor": F.floor(rest * (F.col("n") - 1) / spare), "_over": (rest * (F.col("n") - 1)) % spare})
    out = out.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_over"), *order))).withColumn("_first", F.row_number().over(Window.orderBy(F.desc("n"), *order)))
    more = (F.col("_place") <= rest - F.sum("_floor").over(every)).cast("long")
    quota = F.when(F.col("_w") >= F.col("_k"), 1 + F.col("_floor") + more).otherwise((F.col("_first") <= F.col("_w")).cast("long"))
    return out.withColumn("quota", quota.cast("long")).select(stratum, "n", "quota")


def stratified_sample(docs: DataFrame, stratum: str, key: str, total: int, seed: int = 1, rule: str = "last") -> DataFrame:
    """`total` rows of docs by allocation() over its strata, those that come first in each when shuffled by the seed. Rows with a null stratum are one stratum."""
    quota = allocation(docs.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("n")), "_s", total, rule).select("_s", "quota")
    ranked = docs.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(seeded(key, seed), key))).where(F.col("_r") <= total)
    return ranked.join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).where("_r <= quota").drop("_r", "_s", "quota")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once whatever body's lambdas do with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A line that is a heading: one to six number signs, white space, a title.
HEADING = r"#{1,6}[^\S\n]+\S"
CHUNK = "array<struct<headings: array<string>, start: bigint, text: string>>"
#: Sections that are folded before their results are put together, so that appending to an array stays cheap however many there are.
FOLDED = 1024


def section_parts(section: Column, most: int) -> Column:
    """[(first byte, text)] of a section: itself, or if it has over `most` characters its paragraphs, packed in order while they fit.

    Paragraphs end in two line ends or more, which belong to no part at a part's end. A paragraph that is longer by itself is a part of its own.
    """
    parts = "array<struct<at: bigint, c: bigint, n: bigint>>"
    zero = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("whole"), F.array().cast(parts).alias("out"))

    def step(a: Column, p: Column) -> Column:
        long = lambda x: x.cast("long")
        size, inner = long(F.length(p)), long(F.length(F.regexp_replace(p, r"\n\n+\z", "")))
        cut = (a["whole"] > 0) & (a["whole"] + inner > most)
        done = F.when(cut, F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), a["first"].alias("c"), a["n"].alias("n"))))).otherwise(a["out"])
        fresh = cut | (a["whole"] == 0)
        return F.struct(
            (a["b"] + F.octet_length(p)).alias("b"), (a["c"] + size).alias("c"), F.when(fresh, a["b"]).otherwise(a["at"]).alias("at"), F.when(fresh, a["c"]).otherwise(a["first"]).alias("first"),
            F.when(fresh, inner).otherwise(a["whole"] + inner).alias("n"), F.when(fresh, size).otherwise(a["whole"] + size).alias("whole"), done.alias("out"),
        )

    end = lambda a: F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), a["first"].alias("c"), a["n"].alias("n"))))
    pieces = F.filter(F.split(section, r"(?<=\n\n)(?!\n)"), lambda p: p != "")
    long_ones = lambda s: F.transform(F.aggregate(pieces, zero, step, end), lambda x: F.struct(x["at"].alias("at"), F.substring(s, (x["c"] + 1).cast("int"), x["n"].cast("int")).alias("text")))
    return F.when(F.length(section) <= most, F.array(F.struct(F.lit(0).cast("long").alias("at"), section.alias("text")))).otherwise(long_ones(section))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = 100_000, chars_per_token: int = 4) -> DataFrame:
    """(key, chunk, headings, start, end, text): documents cut at their headings, sections of over tokens * chars_per_token characters also at blank lines.

    headings: the path of a section's heading and those above it. start and end are places in the UTF-8 bytes of the document; the text is exactly those bytes.
    Between two chunks there are only line ends: one between sections, two or more inside one; a last run of two or more is in no chunk of a section that was cut.
    A heading takes those of its own and deeper levels off the stack. Everything is folded inside the row, so no text is shuffled. A null text
    has no chunk, an empty one a single empty chunk.
    """
    most = tokens * chars_per_token
    level = lambda s: F.length(F.regexp_extract(s, r"^(#{1,6})[^\S\n]+\S", 1))
    title = lambda s: F.regexp_replace(F.regexp_extract(s, r"^#{1,6}[^\S\n]+(\S[^\n]*)", 1), r"\s+\z", "")
    nothing = F.array(*[F.lit(None).cast("string")] * 6)
    state = lambda at, stack, out: F.struct(at.alias("at"), stack.alias("stack"), out.alias("out"))

    def section(a: Column, s: Column) -> Column:
        moved = F.transform(a["stack"], lambda x, i: F.when(i + 1 < level(s), x).when(i + 1 == level(s), title(s)))
        stack = F.when(level(s) > 0, moved).otherwise(a["stack"])
        path = F.array_compact(stack)
        found = F.transform(section_parts(s, most), lambda p: F.struct(path.alias("headings"), (a["at"] + p["at"]).alias("start"), p["text"].alias("text")))
        return state(a["at"] + F.octet_length(s) + 1, stack, F.concat(a["out"], found))

    def fold(sections: Column) -> Column:
        def group(a: Column, g: Column) -> Column:
            inner = F.aggregate(F.slice(sections, g * FOLDED + 1, F.lit(FOLDED)), state(a["at"], a["stack"], F.array().cast(CHUNK)), section)
            return let(inner, lambda b: state(b["at"], b["stack"], F.concat(a["out"], F.array(b["out"]))))

        groups = F.sequence(F.lit(0), ((F.size(sections) - 1) / FOLDED).cast("int"))
        return F.flatten(F.aggregate(groups, state(F.lit(0).cast("long"), nothing, F.array().cast(f"array<{CHUNK}>")), group)["out"])

    found = let(F.split(F.col(text), rf"\n(?={HEADING})"), fold)
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(found).alias("chunk", "_c"))
    end = F.col("_c.start") + F.octet_length("_c.text")
    return rows.select(key, "chunk", "_c.headings", "_c.start", end.alias("end"), "_c.text")


# The classes of size, goals and caps of a gold set.
SIZE_CLASSES = ["small", "medium", "large"]
PRIORITY_TYPES, PER_TYPE = ["financial_statement", "trustee_filing"], 5
YEAR_LEAST, YEAR_GOALS, SIZE_TARGETS = 10, {"small": 2, "medium": 5, "large": 3}, {"small": 25, "medium": 50, "large": 25}
YEARS, LAST_YEAR, YEAR_CAP, LAST_CAP, LEAST_CONTENT = range(2019, 2026), 2025, 20, 10, 10


def size_class(size: Column, small: int = 50_000, large: int = 150_000) -> Column:
    return F.when(size < small, "small").when(size <= large, "medium").otherwise("large")


def year_fill(have: dict, pool: dict) -> dict:
    """{(year, size class): n} to take so that every year but the last has YEAR_LEAST, by its goals first, then from any class. have, pool: rows selected and left of each."""
    take: dict = {}
    for year in [y for y in YEARS if y != LAST_YEAR]:
        need = max(0, YEAR_LEAST - sum(have.get((year, c), 0) for c in SIZE_CLASSES))
        for goals in ({c: max(0, YEAR_GOALS[c] - have.get((year, c), 0)) for c in SIZE_CLASSES}, dict.fromkeys(SIZE_CLASSES, need)):
            for c in SIZE_CLASSES:
                n = min(goals[c], pool.get((year, c), 0) - take.get((year, c), 0), need)
                take[year, c] = take.get((year, c), 0) + n
                need -= n
    return take


def class_fill(have: dict, pool: dict, total: int) -> dict:
    """{(year, size class): n} to take, class by class in turn, until SIZE_TARGETS or total are met: each time from the year with the fewest rows that has one of
    that class and is under its cap."""
    have, take = dict(have), {}
    years = list(YEARS)
    of_year = {y: sum(n for (year, _), n in have.items() if year == y) for y in years}
    moving = True
    while moving and sum(have.values()) < total:
        moving = False
        for c in SIZE_CLASSES:
            if sum(have.values()) >= total or sum(n for (_, x), n in have.items() if x == c) >= SIZE_TARGETS[c]:
                continue
            able = [y for y in years if of_year[y] < (LAST_CAP if y == LAST_YEAR else YEAR_CAP) and pool.get((y, c), 0) > take.get((y, c), 0)]
            if able:
                y = min(able, key=lambda y: (of_year[y], y))
                take[y, c], have[y, c], of_year[y], moving = take.get((y, c), 0) + 1, have.get((y, c), 0) + 1, of_year[y] + 1, True
    return take


def quota_sample(docs: DataFrame, key: str = "doc_id", total: int = 100, seed: int = 1) -> DataFrame:
    """(key, year, class, phase): a gold set of up to `total` of docs(key, year, class, density, type, content), filled in stages.

    1 priority: PER_TYPE rows of each of PRIORITY_TYPES, shuffled by the seed. 2 year: year_fill(). 3 class: class_fill(). 4 rest: the best left of all years under
    their caps. Then rows whose content (its first characters) has under LEAST_CONTENT characters go, and 5 backfill: others that have, shuffled. In 2 to 4
    the rows of the greatest density come first, those without one last, shuffled.

    Each stage takes rows by their place among those that no stage before it took. The stages need at most a bounded number of the first rows of a year
    and class, of a type and of the backfill: only those are kept after one ranking of the table. What a stage takes is planned on counts by year and class. Rows
    with a null key, year or class are left out; rows of one key are one.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col("year").isNotNull() & F.col("class").isNotNull()).dropDuplicates([key])
    rows = rows.select(key, "year", "class", "density", "type", (F.length(F.trim(F.coalesce("content", F.lit("")))) >= LEAST_CONTENT).alias("good"), seeded(key, seed).alias("_h"))
    best, mixed = [F.desc_nulls_last("density"), F.col("_h"), F.col(key)], [F.col("_h"), F.col(key)]
    enough = total + PER_TYPE * len(PRIORITY_TYPES)
    place = lambda order, *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    first = rows.withColumn("_p", place(best, "year", "class")).where(F.col("_p") <= enough).drop("_p")
    typed = rows.where(F.col("type").isin(PRIORITY_TYPES)).withColumn("_p", place(mixed, "type")).where(F.col("_p") <= PER_TYPE).drop("_p")
    spare = rows.where("good").orderBy(*mixed).limit(2 * total)
    near = saved(first.unionByName(typed).unionByName(spare).dropDuplicates([key]))

    def counts(df: DataFrame) -> dict:
        return {(r["year"], r["class"]): r["n"] for r in df.groupBy("year", "class").agg(F.count("*").alias("n")).collect()}

    def planned(left: DataFrame, take: dict) -> DataFrame:
        plan = left.sparkSession.createDataFrame([(y, c, n) for (y, c), n in take.items() if n], "_y int, _c string, _n int")
        ranked = left.withColumn("_p", place(best, "year", "class"))
        return ranked.join(F.broadcast(plan), (F.col("year") == F.col("_y")) & (F.col("class") == F.col("_c"))).where("_p <= _n").drop("_p", "_y", "_c", "_n")

    taken = saved(near.where(F.col("type").isin(PRIORITY_TYPES)).withColumn("_p", place(mixed, "type")).where(F.col("_p") <= PER_TYPE).drop("_p").withColumn("phase", F.lit("priority")))
    for phase in ("year", "class"):
        have, left = counts(taken), near.join(taken.select(key), key, "left_anti")
        pool = counts(left)
        take = year_fill(have, pool) if phase == "year" else class_fill(have, pool, total)
        taken = saved(taken.unionByName(planned(left, take).withColumn("phase", F.lit(phase))))
    left = near.join(taken.select(key), key, "left_anti")
    of_year = taken.groupBy(F.col("year").alias("_y")).agg(F.count("*").alias("_n"))
    cap = F.when(F.col("year") == LAST_YEAR, LAST_CAP).otherwise(YEAR_CAP) - F.coalesce("_n", F.lit(0))
    open_ = left.join(F.broadcast(of_year), F.col("year") == F.col("_y"), "left").withColumn("_p", place(best, "year")).where(F.col("_p") <= cap)
    rest = open_.orderBy(*best).limit(max(0, total - taken.count())).select(*near.columns, F.lit("rest").alias("phase"))
    taken = saved(taken.unionByName(rest))
    kept = taken.where("good")
    back = near.where("good").join(taken.select(key), key, "left_anti").orderBy(*mixed).limit(max(0, total - kept.count()))
    return kept.unionByName(back.withColumn("phase", F.lit("backfill"))).select(key, "year", "class", "phase")


# What tells the types of documents apart.
TRUSTEE_WORDS = [r"(?i)report\s+of\s+the\s+trustees", r"(?i)trustees['\u2018\u2019]?\s*report", r"(?i)trustees\s+annual\s+report"]
FINANCE_WORDS = [r"(?i)statement\s+of\s+financial\s+activities", r"(?i)balance\s+sheet"]
ANNUAL_WORDS, FIGURE = r"(?i)annual\s+report", r"[\u00a3$]\s*[\d,]+"


def document_type(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with type, figures (amounts of money), narrative (lines of over 80 characters outside tables) and quarantine (why a document goes there, else null).

    Three figures make a financial table, five narrative lines a narrative. A null text counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    any_of = lambda patterns: F.greatest(F.lit(False), *[t.rlike(p) for p in patterns])
    trustee, finance, annual = any_of(TRUSTEE_WORDS), any_of(FINANCE_WORDS), t.rlike(ANNUAL_WORDS)
    figures = F.regexp_count(t, F.lit(FIGURE)).cast("long")
    narrative = F.size(F.filter(F.split(t, "\n"), lambda x: (F.length(x) > 80) & ~x.contains("|") & ~x.contains("---"))).cast("long")
    table, story = F.col("figures") >= 3, F.col("narrative") >= 5
    kind = (
        F.when(trustee & finance, "trustee_filing").when(trustee & annual, "mixed").when(finance, "financial_statement").when(annual & ~trustee, F.when(table, "mixed").otherwise("annual_report"))
        .when(table, F.when(story, "mixed").otherwise("accounts_only")).otherwise("unsupported")
    )
    out = docs.withColumns({"figures": figures, "narrative": narrative}).withColumn("type", kind)
    return out.withColumn("quarantine", F.when(F.col("type") == "unsupported", "unsupported_document_type"))
