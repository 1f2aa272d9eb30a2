"""Quality rules from tokeniser fertility."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.llm.common import WordCache, block_words, read, saved, with_columns_of_text

SYMBOLS = "#*$%&|<>"
MEASURES = ("chars_per_token", "byte_share", "token_entropy")

FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in MEASURES]
)


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1].astype(np.int64) << 32 | ids[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : len(ids) - 2 + k] |= again
    return int(cover.sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.encode().split())
        seen.add(line)
    return n


def measure(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with the columns of FIELDS.

    vocabulary: the path of a sentencepiece model with byte fallback, on every executor. Words are encoded one by one, each with its own
    leading space mark, so a word's tokens are computed once and kept. Texts without words have 0 tokens and null measures.
    """

    def make() -> Callable:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])

        cache = WordCache(lambda words: [np.array(ids, np.int32).tobytes() for ids in model.encode(words, num_threads=1)])

        def one(text: str | None, words: np.ndarray, tokens: np.ndarray) -> tuple:
            text, n = text or "", len(tokens)
            chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
            base = (len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeated_words(words), n)
            if not n:
                return (*base, None, None, None)
            share = np.unique(tokens, return_counts=True)[1] / n
            return (*base, chars / n, float(is_byte[tokens].mean()), float(-(share * np.log2(share)).sum()))

        def work(texts: list[str | None]) -> list:
            words, which, starts = block_words(texts)
            cache.learn(words)
            known = [cache[w] for w in words]
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            ids, first = np.frombuffer(b"".join(known), np.int32), np.cumsum(size) - size
            n = size[which]
            ends = np.concatenate([[0], np.cumsum(n)])
            tokens = ids[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])]
            which = which.astype(np.int64)
            out = [one(t, which[a:b], tokens[ends[a] : ends[b]]) for t, a, b in zip(texts, starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            return list(zip(*out, strict=True))

        return work

    return with_columns_of_text(docs, FIELDS, make)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Per measure: how many times the distance of the quartiles a band reaches beyond them, and the least widening.
REACH = {"chars_per_token": (4.5, 0.05), "byte_share": (4.5, 0.02), "token_entropy": (3.5, 0.05)}


def size_class() -> Column:
    """Texts are compared with those of like length, because entropy depends on it: the binary logarithm of the number of tokens, rounded down."""
    return F.floor(F.log2(F.greatest(F.lit(1), F.col("n_tokens")))).cast("int")


#: Accepted where the whole table has too few different texts for a band. Entropy in bits.
FIXED = {"chars_per_token": (1.0, 10.0), "byte_share": (0.0, 0.5), "token_entropy": (3.0, 16.0)}


def bands(measured: DataFrame, group: str = "lang", least_docs: int = 30) -> DataFrame:
    """One row per group and size class of measured: the least and the greatest accepted value of each measure.

    A band is the range between the quartiles of the different texts (by _copy, so copies have one vote) that pass the base rules, widened on
    both sides by REACH. They are those of the group and size class; where these are under least_docs, of the neighbouring classes too, then of the
    group, then of the table; where that has too few, the band is FIXED. The quartile summaries merge before the shuffle.
    """
    level = lambda n, g, s: F.struct(F.lit(n).alias("n"), g.cast("string").alias("g"), s.cast("int").alias("s"))
    g, s, none = F.col("_group"), F.col("_size"), F.lit(None)
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 1000).alias(m) for m in MEASURES]
    voters = measured.where(~base_failed()).select(F.col(group).alias("_group"), size_class().alias("_size"), "_copy", *MEASURES).dropDuplicates(["_group", "_copy"])
    counted = voters.withColumn("_at", F.explode(F.array(level(1, g, s), *[level(2, g, s + k) for k in (-1, 0, 1)], level(3, g, none), level(4, none, none))))
    found = counted.groupBy("_at.n", "_at.g", "_at.s").agg(F.count("*").alias("_n"), *quartiles).where(F.col("_n") >= least_docs)
    wide = lambda m: F.greatest(REACH[m][0] * (F.col(m)[1] - F.col(m)[0]), F.lit(REACH[m][1]))
    ends = F.struct(*[x for m in MEASURES for x in ((F.col(m)[0] - wide(m)).alias(f"{m}_least"), (F.col(m)[1] + wide(m)).alias(f"{m}_most"))])
    found = found.select("n", "g", "s", ends.alias("_ends"))
    cells = measured.select(F.col(group).alias("_group"), size_class().alias("_size")).distinct()
    asked = cells.withColumn("_ask", F.explode(F.array(level(1, g, s), level(2, g, s), level(3, g, none), level(4, none, none))))
    same = (F.col("_ask.n") == F.col("n")) & F.col("_ask.g").eqNullSafe(F.col("g")) & F.col("_ask.s").eqNullSafe(F.col("s"))
    best = asked.join(found, same, "left").where("n is not null or _ask.n = 4").groupBy("_group", "_size").agg(F.min_by("_ends", F.col("_ask.n")).alias("_ends"))
    fixed = {f"{m}_{end}": FIXED[m][k] for m in MEASURES for k, end in enumerate(("least", "most"))}
    return best.select("_group", "_size", *[F.coalesce(F.col("_ends").getField(c), F.lit(x)).alias(c) for c, x in fixed.items()])


def judge(docs: DataFrame, vocabulary: str, group: str = "lang") -> DataFrame:
    """docs(text, <group>) with the measures, base_failed and kept.

    kept is false where base_failed, or where characters per token, byte-fallback share or token entropy (bits) lies
    outside the band of the document's group and size class; a null group is a group of its own. Every document has a band: see bands().
    Null and empty texts fail. Repeated rows are judged alike; columns with the names of new ones are replaced. An empty table stays empty.
    """
    return verdict(saved(measure(docs.withColumn("_copy", F.xxhash64("text")), vocabulary)), group)


def verdict(measured: DataFrame, group: str = "lang") -> DataFrame:
    """measured (written rows of measure(), with or without their text, and _copy, the text's hash) with base_failed and kept, without _copy."""
    limits = bands(measured, group)
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_least"), F.col(f"{m}_most"))
    joined = measured.join(limits, measured[group].eqNullSafe(limits["_group"]) & (size_class() == F.col("_size")), "left")
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False))).drop(*limits.columns, "_copy")


def op8_quality(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document with its base counts, whether they reject it, and whether it is kept."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.xxhash64("text").alias("_copy"))
    out = verdict(saved(measure(docs, vocabulary).drop("text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *MEASURES)
