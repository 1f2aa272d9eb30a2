"""Secret scans over a trigram inverted index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tieweave.llm.common import read, with_columns_of_text

# The kinds in the order of the output; pattern, group whose length counts, least length. A private key goes to its END line,
# or over the lines of base 64 below where it has none.
BASE_KINDS = ("assign", "access", "hex")
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?s:(?:(?!-----BEGIN ).)*?)-----END [A-Z ]*PRIVATE KEY-----|(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/=]+(?=[ \t]*(?:\r?\n|\Z)))*)", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "code_host": (r"ghp_[A-Za-z0-9]{36}", 0, 0),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "maps_key": (r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    "payment_key": (r"sk_live_[A-Za-z0-9]{16,}", 0, 0),
    "url_login": (r"://[^\s:@/]+:[^\s:@/]+@", 0, 0),
}

#: A rule's query: alternatives, each a set of trigrams that must all occur. None: no mandatory trigram, every text is scanned.
Query = list[frozenset[bytes]] | None


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The Boolean trigram query of a regex, over text with A-Z lower-cased.

    Runs of literals give AND-ed trigrams, alternatives are OR-ed, optional parts and character classes give nothing.
    An alternative without a trigram makes the whole query empty (None).
    """
    parser = re._parser  # the tree that re itself compiles

    def walk(items) -> list[frozenset[bytes]]:
        found, run = [frozenset()], ""

        def also(other: list[frozenset[bytes]]) -> list[frozenset[bytes]]:
            both = list({a | b for a, b in product(found, other)})
            return both if len(both) <= most else found

        def grams(literal: str) -> list[frozenset[bytes]]:
            raw = literal.encode().lower()
            return [frozenset(raw[i : i + 3] for i in range(len(raw) - 2))]

        for op, arg in items:
            if op is parser.LITERAL:
                run += chr(arg)
                continue
            if op is parser.MAX_REPEAT and arg[0] == arg[1] and len(arg[2]) == 1 and arg[2][0][0] is parser.LITERAL:
                run += chr(arg[2][0][1]) * arg[0]
                continue
            found, run = also(grams(run)), ""
            if op is parser.SUBPATTERN:
                found = also(walk(arg[-1]))
            elif op is parser.BRANCH:
                found = also([x for branch in arg[1] for x in walk(branch)])
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] > 0:
                found = also(walk(arg[2]))
        return also(grams(run))

    query = walk(parser.parse(pattern))
    return query if all(query) else None


def postings(texts: list[str | None], grams: list[bytes], table: np.ndarray) -> dict[bytes, np.ndarray]:
    """Trigram -> ascending positions in texts of those that hold it, for the given trigrams. table: 1 where a trigram's code is asked for."""
    raw = b"\x00\x00".join((t or "").encode().lower() for t in texts)
    if len(raw) < 3:
        return {}
    ends = np.cumsum([len((t or "").encode()) + 2 for t in texts])
    b = np.frombuffer(raw, np.uint8)
    code = b[:-2].astype(np.int32)
    code <<= 8
    code |= b[1:-1]
    code <<= 8
    code |= b[2:]
    at = np.flatnonzero(table[code])
    code, doc = code[at], np.searchsorted(ends, at, side="right")
    return {g: np.unique(doc[code == int.from_bytes(g, "big")]) for g in grams}


def candidates(query: Query, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if query is None:
        return np.arange(n)
    none = np.empty(0, np.int64)
    found = []
    for grams in query:
        lists = sorted((index.get(g, none) for g in grams), key=len)
        both = lists[0]
        for other in lists[1:]:
            both = np.intersect1d(both, other, assume_unique=True)
        found.append(both)
    return np.unique(np.concatenate(found))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan_secrets(docs: DataFrame, rules: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """docs with secret_spans(array of struct(kind, start, end)), by start, then by the order of the rules.

    Offsets are code points, the end exclusive. Spans of one rule don't overlap; those of different rules may. Each block of texts
    gets an inverted index of the trigrams that the rules' queries name; a rule is verified on the texts that its query leaves, whole.
    Null and empty texts have no spans. Rows stay as they are; a column named secret_spans is replaced.
    """
    rules = RULES if rules is None else rules

    def make() -> Callable:
        asked = {k: trigram_query(p) for k, (p, _, _) in rules.items()}
        compiled = {k: re.compile(p) for k, (p, _, _) in rules.items()}
        grams = sorted({g for q in asked.values() if q for alt in q for g in alt})
        table = np.zeros(1 << 24, np.bool_)
        table[[int.from_bytes(g, "big") for g in grams]] = True

        def work(texts: list[str | None]) -> list[list]:
            index = postings(texts, grams, table)
            spans: list[list] = [[] for _ in texts]
            for order, (kind, (_, group, least)) in enumerate(rules.items()):
                for i in candidates(asked[kind], index, len(texts)):
                    for m in compiled[kind].finditer(texts[i] or ""):
                        if m.end(group) - m.start(group) >= least:
                            spans[i].append((m.start(), order, kind, m.end()))
            return [[[{"kind": k, "start": a, "end": b} for a, _, k, b in sorted(x)] for x in spans]]

        return work

    fields = T.StructType([T.StructField("secret_spans", T.ArrayType(SPAN))])
    return with_columns_of_text(docs, fields, make)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document with the numbers of its base spans, their digest and all spans."""
    from pyspark.sql import functions as F

    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("secret_spans")).alias("spans"),
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
