"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.llm.common import WordCache, only_result, read, saved, slices

#: A-Z become a-z; what isn't a letter, a digit or beyond ASCII parts words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: The same words by a regular expression, before A-Z become a-z.
DOC_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

MIX = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def least_of_each(h: np.ndarray, width: int) -> np.ndarray:
    """The least of any `width` consecutive values: the fingerprint that winnowing keeps for each window."""
    if len(h) < width:
        return h[:0]
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :])


def fingerprints(hashes: np.ndarray, size: int, window: int, gram: int) -> np.ndarray:
    """The fingerprint of every `size` consecutive words: the least hash of their k-grams; of shorter items' words, the hash of all of them.

    Least hashes are small numbers, so they are spread over all 64 bits again.
    """
    k = min(gram, size) if size == window else size
    return least_of_each(gram_hashes(hashes, k), size - k + 1) * MIX


def hashed(words: list[bytes]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(w) for w in words]


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, size, print, words): every window of `window` words of the items, or the one of all words of a shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = item_words(text)
                if words:
                    size = min(window, len(words))
                    prints = fingerprints(np.array(hashed(words), np.uint64), size, window, gram)
                    joined = [b" ".join(words[i : i + size]) for i in range(len(prints))]
                    columns = [pa.array([item] * len(prints)), pa.array([size] * len(prints), pa.int32()), pa.array(prints.view(np.int64)), pa.array(joined, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "size", "print", "words"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    return named.mapInArrow(run, "item string, size int, print long, words binary")


#: Bits of the filter of fingerprints, as a power of two: at least LEAST_BITS, 256 for each fingerprint as long as that is at most MOST_BITS (64 MB).
LEAST_BITS, MOST_BITS = 20, 29


def print_filter(windows: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, b): bit number print >> (64 - b) is set for every fingerprint. It only spares the join rows that can't match, so its size bounds what is broadcast, not what is found."""
    n = windows.agg(F.approx_count_distinct("print")).first()[0]
    b = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(256 * max(1, n))))))
    place = F.shiftrightunsigned("print", 64 - b)
    words = windows.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(print, {64 - b}) & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (b - 6), np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return bits, b


def near_windows(texts: DataFrame, bits: np.ndarray, b: int, sizes: list[int], window: int, gram: int) -> DataFrame:
    """(t, start, size, print, words): the windows of texts(t, text) whose fingerprint is in the filter. Texts without one give no row."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = shared.value, WordCache(hashed, most=500_000)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            for i, j in slices(bodies, 4_000_000):
                split = [item_words(x) for x in bodies[i:j]]
                cache.learn(set().union(*split))
                for t, words in zip(batch.column(0).slice(i, j - i).to_pylist(), split, strict=True):
                    hashes = np.fromiter((cache[w] for w in words), np.uint64, len(words))
                    for size in sizes:
                        prints = fingerprints(hashes, size, window, gram)
                        place = (prints >> np.uint64(64 - b)).astype(np.int64)
                        at = np.flatnonzero((known[place >> 6] >> (place & 63)) & 1)
                        for x in range(0, len(at), 20_000):
                            part = at[x : x + 20_000]
                            joined = [b" ".join(words[k : k + size]) for k in part.tolist()]
                            columns = [pa.array([t] * len(part), pa.binary()), pa.array(part), pa.array([size] * len(part), pa.int32()), pa.array(prints[part].view(np.int64)), pa.array(joined, pa.binary())]
                            yield pa.RecordBatch.from_arrays(columns, ["t", "start", "size", "print", "words"])

    return texts.mapInArrow(run, "t binary, start long, size int, print long, words binary")


#: Texts with hits, and items named by them, up to which they are broadcast to the documents; beyond, both sides are shuffled.
MOST_HITS = 200_000


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """docs with n_words, n_hit and hit_items: words inside occurrences of benchmark windows, and the items these are from.

    Every window of so many words is known by the least hash of its k-grams, which winnowing keeps on both sides; so each shared span of at
    least a window is found. Fingerprints of the benchmark are a table; those of documents that pass a filter of bounded size are joined with it, on the
    fingerprint and on all words of the window, so a hit is exact. An item of fewer words is one window of its own; its fingerprint is the hash of
    all its words. Both sides are read once more or less whatever the benchmark's size; equal texts are joined once.
    Null, empty and wordless texts have no words and no hits; items with a null id or no word are left out; items with equal ids count once.
    Repeated rows are treated alike; columns named like the new ones are replaced. An empty benchmark gives no hits, an empty table stays empty.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_hit", "hit_items")])
    named = base.withColumn("_t", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    hits = only_result(docs.sparkSession, lambda: text_hits(named.select("_t", "text"), benchmark, window, gram))
    size = hits.agg(F.count("*").alias("n"), F.sum(F.size("hit_items")).alias("items")).first()
    few = max(size["n"], size["items"] or 0) <= MOST_HITS
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(DOC_WORD)).cast("long")
    out = named.join(F.broadcast(hits) if few else hits.hint("merge"), F.col("_t") == F.col("_h"), "left")
    return out.select(*base.columns, words.alias("n_words"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"))


def text_hits(texts: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(_h, _n, hit_items) of the different texts(_t, text) with a hit: hash, words hit, items."""
    windows = saved(item_windows(benchmark, window, gram).groupBy("print", "words", "size").agg(F.collect_set("item").alias("items")))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` of them
    bits, b = print_filter(windows)
    near = saved(near_windows(texts.where("text is not null"), bits, b, sizes, window, gram)).distinct()
    there = windows.select(F.col("print").alias("_p"), F.col("words").alias("_w"), "items")
    met = near.join(there, (F.col("print") == F.col("_p")) & (F.col("words") == F.col("_w")))
    # The items of a text first, so that one that meets many windows of an item names it once; then its spans, merged in order.
    spans = met.groupBy("t").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    names = met.select("t", F.explode("items").alias("item")).distinct().groupBy(F.col("t").alias("_u")).agg(F.array_sort(F.collect_list("item")).alias("hit_items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    cover = F.aggregate("spans", start, lambda at, s: F.struct((at["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], at["upto"]))).alias("n"), F.greatest(at["upto"], s["end"]).alias("upto")), lambda at: at["n"])
    return spans.join(names, F.col("t") == F.col("_u")).select(F.col("t").alias("_h"), cover.alias("_n"), "hit_items")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows and the items they are from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
