"""Allocation, the staged gold set and section-aware chunks against plain loops."""

import hashlib
import random
import re

import pytest

from tieweave.operators import documents as D


def quotas(spark, sizes, total, rule):
    df = spark.createDataFrame(list(sizes.items()), "s int, n long")
    return {r["s"]: r["quota"] for r in D.allocation(df, "s", total, rule).collect()}


def test_largest_remainder_meets_the_total(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([1, 2, 3, 50, 400]) for s in range(rng.randint(1, 9))}
        for total in (1, 5, 17, 60, 10_000):
            got = quotas(spark, sizes, total, "largest_remainder")
            assert sum(got.values()) == min(total, sum(sizes.values()))
            assert all(q <= sizes[s] for s, q in got.items())
            if total >= len(sizes):
                assert min(got.values()) >= 1


def test_last_takes_the_rest(spark):
    def plain(sizes, total):
        left, out, every = total, {}, sum(sizes.values())
        for i, s in enumerate(sorted(sizes)):
            share = left if i == len(sizes) - 1 else max(1, int(sizes[s] * total / every + 0.5))
            out[s] = max(0, min(share, sizes[s], left))
            left -= out[s]
        return out

    for sizes in ({1: 10, 2: 1, 3: 300, 4: 7}, {1: 1, 2: 1, 3: 1}, {5: 40}):
        for total in (2, 10, 100):
            assert quotas(spark, sizes, total, "last") == plain(sizes, total)


def test_sample_keeps_null_strata_and_repeats(spark):
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s int")
    for rule in ("last", "largest_remainder"):
        out = D.stratified_sample(df, "s", "id", 20, rule=rule).collect()
        assert len(out) == 20 and len({r["id"] for r in out}) == 20 and any(r["s"] is None for r in out)
    assert D.stratified_sample(df.limit(0), "s", "id", 20).count() == 0


def plain_gold_set(rows, total, seed):
    """One row after the other, as the stages are told; rows: (key, year, class, density, type, content)."""
    mix = lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])
    best = lambda r: (r[3] is None, -(r[3] or 0), *mix(r))
    taken = {}

    def count(year=None, kind=None):
        return sum(1 for r, _ in taken.values() if year in (None, r[1]) and kind in (None, r[2]))

    for t in D.PRIORITY_TYPES:
        for r in sorted((r for r in rows if r[4] == t), key=mix)[: D.PER_TYPE]:
            taken[r[0]] = (r, "priority")
    pools = {(y, c): sorted((r for r in rows if r[1] == y and r[2] == c and r[0] not in taken), key=best) for y in D.YEARS for c in D.SIZE_CLASSES}
    for y in D.YEARS:
        if y == D.LAST_YEAR:
            continue
        need = max(0, D.YEAR_LEAST - count(y))
        goals = {c: max(0, D.YEAR_GOALS[c] - count(y, c)) for c in D.SIZE_CLASSES}
        for limit in (goals, None):
            for c in D.SIZE_CLASSES:
                k = 0
                while need and pools[y, c] and (limit is None or k < limit[c]):
                    r = pools[y, c].pop(0)
                    taken[r[0]] = (r, "year")
                    need, k = need - 1, k + 1
    cap = lambda y: D.LAST_CAP if y == D.LAST_YEAR else D.YEAR_CAP
    while len(taken) < total:
        added = False
        for c in D.SIZE_CLASSES:
            if len(taken) >= total or count(None, c) >= D.SIZE_TARGETS[c]:
                continue
            for y in sorted((y for y in D.YEARS if count(y) < cap(y)), key=lambda y: (count(y), y)):
                if pools[y, c]:
                    r = pools[y, c].pop(0)
                    taken[r[0]] = (r, "class")
                    added = True
                    break
        if not added:
            left = sorted((r for r in rows if r[0] not in taken and count(r[1]) < cap(r[1])), key=best)
            if not left:
                break
            taken[left[0][0]] = (left[0], "rest")
    good = lambda r: len((r[5] or "").strip(" ")) >= D.LEAST_CONTENT
    kept = {k: v for k, v in taken.items() if good(v[0])}
    for r in sorted((r for r in rows if r[0] not in taken and good(r)), key=mix):
        if len(kept) >= total:
            break
        kept[r[0]] = (r, "backfill")
    return {k: p for k, (_, p) in kept.items()}


@pytest.mark.parametrize("case", ["many", "few", "one_year", "short"])
def test_gold_set(spark, case):
    rng = random.Random(case)
    n = {"many": 900, "few": 70, "one_year": 300, "short": 500}[case]
    years = [2019] if case == "one_year" else [*range(2018, 2027)]
    rows = []
    for i in range(n):
        density = rng.choice([None, None, rng.randint(0, 30)])
        kind = rng.choice(["financial_statement", "trustee_filing"]) if rng.random() < 0.02 else "mixed"
        content = "too short" if rng.random() < (0.5 if case == "short" else 0.05) else "long enough text"
        rows.append((i, rng.choice(years), rng.choices(D.SIZE_CLASSES, [6, 2, 1])[0], density, kind, content))
    df = spark.createDataFrame([*rows, *rows[:5], (None, 2019, "small", 1, "mixed", "x" * 20), (9999, None, "small", 1, "mixed", "x" * 20)], "doc_id long, year int, class string, density int, type string, content string")
    got = {r["doc_id"]: r["phase"] for r in D.quota_sample(df, seed=3).collect()}
    assert got == plain_gold_set(rows, 100, 3)
    if case == "many":
        assert len(got) == 100 and {"priority", "year", "class"} <= set(got.values())


def test_gold_set_of_nothing(spark):
    assert D.quota_sample(spark.createDataFrame([], "doc_id long, year int, class string, density int, type string, content string")).count() == 0


def plain_chunks(text, most):
    """(headings, start, end, text) of a document, line by line."""
    sections, stack, at = [], [None] * 6, 0
    for line in text.split("\n"):
        m = re.match(r"(#{1,6})\s+(\S.*)", line)
        if m or not sections:
            if m:
                level = len(m[1])
                stack = [*stack[: level - 1], m[2].rstrip(), *[None] * (6 - level)]
            sections.append([[x for x in stack if x is not None], at, []])
        sections[-1][2].append(line)
        at += len(line.encode()) + 1
    out = []
    for path, start, lines in sections:
        body = "\n".join(lines)
        if len(body) <= most:
            out.append((path, start, start + len(body.encode()), body))
            continue
        kept = ""
        place = 0
        for p in [p for p in re.split(r"(?<=\n\n)(?!\n)", body) if p]:
            if kept and len(kept) + len(re.sub(r"\n\n+\Z", "", p)) > most:
                piece = re.sub(r"\n\n+\Z", "", kept)
                b = start + len(body[:place].encode())
                out.append((path, b, b + len(piece.encode()), piece))
                place, kept = place + len(kept), ""
            kept += p
        piece = re.sub(r"\n\n+\Z", "", kept)
        b = start + len(body[:place].encode())
        out.append((path, b, b + len(piece.encode()), piece))
    return out


def test_chunks(spark):
    rng = random.Random(5)
    parts = ["# One", "## Two ", "### Drei ü", "###### deep", "####### no", "#no", "#  spaced\t", "", "", "", "words é and more words", "x" * 45, "a b c", " "]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + ["", "\n", "\n\n\n", "# a", "x" * 500, "a\n\n\n\nb\n\n" * 30]
    for most in (40, 200, 100_000):
        df = spark.createDataFrame([*enumerate(texts), (None, "# n"), (999, None)], "doc_id long, text string")
        got = {}
        for r in D.chunks(df, tokens=most, chars_per_token=1).orderBy("doc_id", "chunk").collect():
            got.setdefault(r["doc_id"], []).append((r["headings"], r["start"], r["end"], r["text"]))
        assert 999 not in got and got.pop(None) == [(["n"], 0, 3, "# n")]
        assert got == {i: plain_chunks(t, most) for i, t in enumerate(texts)}
        for i, found in got.items():
            raw, at, back = texts[i].encode(), 0, b""
            for _, start, end, text in found:
                assert raw[start:end].decode() == text and set(raw[at:start]) <= {10}
                back += b"\n" * (start - at) + text.encode()
                at = end
            assert set(raw[at:]) <= {10} and back + b"\n" * (len(raw) - at) == raw


def test_very_many_sections(spark):
    df = spark.createDataFrame([(1, "# h\nbody\n" * 20_000)], "doc_id long, text string")
    out = D.chunks(df)
    assert out.count() == 20_000 and out.where("text <> '# h\nbody'").count() == 1
