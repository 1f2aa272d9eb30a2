"""Language identification by word-first backoff."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.llm.common import WordCache, block_words, crc_mod, read, with_columns_of_text

LONGEST = 4  # characters of the longest n-gram


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    words: dict[str, np.ndarray]  # word -> log frequency per language
    grams: dict[str, np.ndarray]  # n-gram of 1 to LONGEST characters -> log frequency per language, among those of its length

    def word(self, word: str) -> np.ndarray:
        """A known word's log frequencies; else the mean over n-grams: from the left, the longest known one at each place, the next one from its last character on."""
        known = self.words.get(word)
        if known is not None:
            return known
        padded, total, n = f"^{word}$", np.zeros(len(self.langs)), 0
        at = 0
        while at < len(padded):
            for k in range(min(LONGEST, len(padded) - at), 0, -1):
                row = self.grams.get(padded[at : at + k])
                if row is not None:
                    total, n, at = total + row, n + 1, at + k - 1 if k > 1 else at
                    break
            at += 1
        return total / n if n else total


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def fit(docs: DataFrame, per_lang: int = 1000, words_per_lang: int = 30_000, grams_per_lang: int = 20_000) -> Model:
    """Learns from the whole texts of about per_lang different texts of each lang of docs(text, lang): a bounded sample, chosen by the hash of the text.

    Equal texts of a language count once. Every lang that occurs is learned, however rare. The model is as large as words_per_lang and
    grams_per_lang allow, times the number of languages.
    """
    known = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_h", F.xxhash64("text"))
    share = known.groupBy(F.col("lang").alias("_l")).agg(F.approx_count_distinct("_h", 0.02).alias("_n")).select("_l", F.least(F.lit(1.0), per_lang / F.greatest(F.lit(1), F.col("_n"))).alias("_share"))
    drawn = known.join(F.broadcast(share), F.col("lang") == F.col("_l")).where(F.pmod("_h", F.lit(1_000_003)) < F.ceil(F.col("_share") * 1_000_003))  # share has one row per language
    sample = drawn.groupBy("lang", "_h").agg(F.first("text").alias("text"))
    word = F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", ""), r"[\x20\x09-\x0D]+")).alias("word")
    counts = sample.select("lang", word).where("word <> ''").groupBy("lang", "word").count().persist()
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(padded) - k + 1, F.lit(1))), lambda i: F.substr(padded, i, k))))
    grams = counts.select("lang", F.explode(cut).alias("word"), "count").groupBy("lang", "word").agg(F.sum("count").alias("count"))

    def top(rows: DataFrame, most: int) -> list:
        first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
        return rows.withColumn("_n", first).where(F.col("_n") <= most).select("lang", "word", "count").collect()

    words, parts = top(counts.where("count > 1"), words_per_lang), top(grams, grams_per_lang)
    counts.unpersist()
    langs = tuple(sorted({r["lang"] for r in [*words, *parts]}))

    def table(rows: list, by_length: bool) -> dict[str, np.ndarray]:
        at = {x: i for i, x in enumerate(langs)}
        found: dict[str, np.ndarray] = {}
        total = np.ones((LONGEST + 2, len(langs)))
        for r in rows:
            k = min(len(r["word"]), LONGEST + 1) if by_length else 0
            found.setdefault(r["word"], np.zeros(len(langs)))[at[r["lang"]]] += r["count"]
            total[k, at[r["lang"]]] += r["count"]
        return {w: np.log((c + 0.5) / total[min(len(w), LONGEST + 1) if by_length else 0]) for w, c in found.items()}

    return Model(langs, table(words, False), table(parts, True))


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score, the share of the best language in the normalised likelihoods of the whole text.

    und and score 0 where the text is null or has no letter, or where the model knows no language; ties go to the first language by name.
    Each distinct word is looked up once for each block of texts; the model is broadcast, its size bounded by fit()'s parameters.
    Repeated rows are predicted alike; columns named like the new ones are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        m = shared.value
        rows, used = np.empty((1024, len(m.langs))), 0  # a row for each word that is held; the array doubles when it is full

        def missing(words: list[str]) -> list[int]:
            nonlocal rows, used
            while used + len(words) > len(rows):
                rows = np.concatenate([rows, np.empty_like(rows)])
            for w in words:
                word = letters(w)
                rows[used] = m.word(word) if word and m.langs else np.nan
                used += 1
            return list(range(used - len(words), used))

        def emptied() -> None:
            nonlocal used
            used = 0

        cache = WordCache(missing, emptied=emptied)

        def work(texts: list[str | None]) -> list:
            words, which, starts = block_words(texts)
            cache.learn(words)
            number = np.fromiter((cache[w] for w in words), np.int64, len(words))
            table = rows[number[which]]
            langs, scores = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                each = table[a:b]
                each = each[~np.isnan(each).any(axis=1)] if each.size else each
                if not each.size:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = each.sum(axis=0)
                best = int(total.argmax())
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
            return [langs, scores]

        return work

    return with_columns_of_text(docs, FIELDS, make)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document, by a model of the rows that may be learned from."""
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    model = fit(docs.where(~held_out).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
