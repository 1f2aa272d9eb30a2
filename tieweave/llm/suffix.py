"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.llm.common import bucketed, only_result, read, saved, slices, with_columns_of_text

GRAM = 32  # bytes of the strings whose hashes choose a window's anchor
SHARD = 1_000_000  # bytes of distinct strings under one anchor from which on they are parted further
SPLITS = (64, 8, 1)  # window offsets that share a shard after each parting; at 1 a shard holds a single window
POSITION = np.uint64((1 << 24) - 1)


# The transform and the expansion, over the strings of one shard ------------------------------------------------------------------------------


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffixes ordered by their first `depth` symbols at least, first places of the groups that agree on the first `seed` symbols, seed).

    Prefix doubling; only groups that aren't single yet are sorted again. Symbols are below 512, the end of s counts as 0.
    """
    n, seed = len(s), 7
    key = np.zeros(n, np.int64)
    for k in range(seed):
        key <<= 9
        key[: n - k] |= s[k:]
    sa = np.argsort(key)
    new = np.concatenate([[True], np.diff(key[sa]) != 0])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = first[np.cumsum(new) - 1]
    have = seed
    open_at = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while have < depth and len(open_at):
        who = sa[open_at]
        later = np.where(who + have < n, rank[np.minimum(who + have, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + later
        order = np.argsort(key)
        who, key = who[order], key[order]
        sa[open_at] = who
        new = np.concatenate([[True], np.diff(key) != 0])
        rank[who] = open_at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        open_at = open_at[~(new & np.concatenate([new[1:], [True]]))]
        have *= 2
    return sa, first, seed


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, whether the substring of `least` bytes at each of its starts also starts elsewhere in strings.

    The intervals of all 7-byte strings in the suffix order are where the breadth-first expansion begins. A level takes every interval
    of a string w and extends w backward by each byte c: on the transform, the last place of c in the interval of w leads to the end of
    the interval of cw. If the boundary after that end has no common-prefix length yet, it is the length of w, and cw joins the next
    level. Lengths come by increasing value; the expansion stops at `least`, and boundaries still open have common prefixes that long.
    """
    lengths = [len(x) for x in strings]
    ends = np.cumsum(np.array(lengths) + 1)
    s = np.zeros(int(ends[-1]), np.int16)
    for x, e in zip(strings, ends.tolist(), strict=True):
        s[e - 1 - len(x) : e - 1] = np.frombuffer(x, np.uint8)
        s[e - 1 - len(x) : e - 1] += 1
    n = len(s)
    sa, first, level = suffix_array(s, least)
    bwt = s[sa - 1]
    order = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # where a place of the transform leads, one byte further back
    back[order] = np.arange(n)
    same = bwt[order[1:]] == bwt[order[:-1]]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # of the same byte in the transform
    following[order[:-1][same]] = order[1:][same]
    preceding[order[1:][same]] = order[:-1][same]
    known = np.zeros(n + 1, bool)
    known[first] = known[n] = True
    lo, hi = first, np.concatenate([first[1:], [n]]) - 1
    inside = np.ones(n, bool)  # no string ends before the last of the first 7 symbols; one may end there, because it bounds what precedes it
    for e in (ends - 1).tolist():
        inside[max(0, e - level + 2) : e + 1] = False
    keep = inside[sa[lo]]
    lo, hi = lo[keep], hi[keep]
    while level < least and len(lo):
        size = hi - lo + 1
        at = np.arange(int(size.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        byte = bwt[at] > 0
        last = at[byte & (following[at] > np.repeat(hi, size))]
        lead = at[byte & (preceding[at] < np.repeat(lo, size))]
        new_hi, new_lo = np.sort(back[last]), np.sort(back[lead])
        fresh = ~known[new_hi + 1]
        lo, hi = new_lo[fresh], new_hi[fresh]
        known[hi + 1] = True
        level += 1
    again = ~known[:-1] | ~known[1:]
    flag = np.zeros(n, bool)
    flag[sa[again]] = True
    return [flag[e - 1 - k : e - least] if k >= least else np.zeros(0, bool) for k, e in zip(lengths, ends.tolist(), strict=True)]


def runs(flag: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


# Shards ----------------------------------------------------------------------------------------------------------------------------------------


def anchors(raw: np.ndarray, window: int) -> np.ndarray:
    """For each window start in at most 2 ** 24 bytes: the least hash of the window's strings of GRAM bytes, with the (first) place of it in the low 24 bits."""
    h = raw.astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    k = 1
    while k < GRAM:
        h = h[:-k] * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + (h[k:] ^ (h[k:] >> np.uint64(31)))
        k *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= ~POSITION
    h |= np.arange(len(h), dtype=np.uint64)
    width, size = window - GRAM + 1, 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :])


LIGHT = "t binary, base long, a long, n long, p long, h long, c long"


def segments(texts: DataFrame, window: int) -> DataFrame:
    """LIGHT rows of texts(t, base, text): runs of windows with the same anchor.

    a and n: start and bytes of what the run covers, p: the anchor's place in it, h: the anchor's hash, c: the hash of the covered
    bytes. Equal windows have the same anchor at the same place in them, so they come under the same h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            for i, j in slices(bodies, 4_000_000):
                raws = [(x or "").encode() for x in bodies[i:j]]
                whole, offset = b"".join(raws), 0
                lengths = np.array([len(r) for r in raws])
                ends = np.cumsum(lengths)
                while True:  # pieces of at most 2 ** 24 bytes; more than one only for a single text
                    piece = whole[offset : offset + (1 << 24)]
                    if len(piece) < window:
                        break
                    m = anchors(np.frombuffer(piece, np.uint8), window)
                    at = np.arange(offset, offset + len(m))
                    doc = np.searchsorted(ends, at, side="right")
                    ok = at + window <= ends[doc]
                    turn = np.concatenate([[True], (np.diff(m) != 0) | (np.diff(doc) != 0) | (ok[1:] != ok[:-1])])
                    a = np.flatnonzero(turn)
                    b = np.concatenate([a[1:], [len(m)]]) - 1
                    a, b = a[ok[a]], b[ok[a]]
                    where = doc[a]
                    start = a + offset - (ends - lengths)[where]
                    c = np.fromiter((digest(piece[x : y + window]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
                    rows = pa.array(i + where)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start, pa.int64()), pa.array(b - a + window, pa.int64()),
                         pa.array((m[a] & POSITION).astype(np.int64) - a, pa.int64()), pa.array((m[a] >> np.uint64(24)).astype(np.int64)), pa.array(c.view(np.int64))],
                        ["t", "base", "a", "n", "p", "h", "c"],
                    )
                    if offset + len(piece) >= len(whole):
                        break
                    offset += len(piece) - window + 1

    return texts.select("t", "base", "text").mapInArrow(run, LIGHT)


def parted(strings: DataFrame, window: int, r: int) -> DataFrame:
    """LIGHT rows of strings(t, base, p, body): the windows under a hot anchor, parted by r neighbouring offsets from the anchor and by the bytes that those have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for t, base, p, body in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                for j in range(max(0, p - (len(body) - window)) // r, p // r + 1):
                    lo, hi = max(0, p - (j + 1) * r + 1), min(len(body) - window, p - j * r)
                    core = body[p - j * r : p - j * r - r + 1 + window]
                    sign = lambda x: int.from_bytes(x, "big", signed=True)
                    out.append((t, base, lo, hi - lo + window, p - lo, sign(xxhash.xxh3_64_digest(core, j)), sign(xxhash.xxh3_64_digest(body[lo : hi + window]))))
            yield pa.RecordBatch.from_pylist([dict(zip(("t", "base", "a", "n", "p", "h", "c"), x, strict=True)) for x in out], pa.schema([("t", pa.binary()), *[(k, pa.int64()) for k in ("base", "a", "n", "p", "h", "c")]]))

    return strings.select("t", "base", "p", "body").mapInArrow(run, LIGHT)


def cut_out(texts: DataFrame, places: DataFrame) -> DataFrame:
    """places(t, base, a, n, p, h, hot) of texts(t, base, body), each once, as rows (t, base + a, p, h, hot, body)."""
    lists = places.groupBy("t", "base").agg(F.collect_list(F.struct("a", "n", "p", "h", "hot")).alias("places"))
    lists = lists.select(F.col("t").alias("_t"), F.col("base").alias("_base"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, base, body, found in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                raw = body.encode() if isinstance(body, str) else body
                rows = [{"t": t, "base": base + x["a"], "p": x["p"], "h": x["h"], "hot": x["hot"], "body": raw[x["a"] : x["a"] + x["n"]]} for x in found]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("t", pa.binary()), ("base", pa.int64()), ("p", pa.int64()), ("h", pa.int64()), ("hot", pa.bool_()), ("body", pa.binary())]))

    joined = texts.join(lists, (F.col("t") == F.col("_t")) & (F.col("base") == F.col("_base"))).select("t", "base", "body", "places")
    return joined.mapInArrow(run, "t binary, base long, p long, h long, hot boolean, body binary")


def expand(strings: DataFrame, window: int, chunk: int = 2_000_000) -> DataFrame:
    """Runs of repeated window starts (t, lo, hi) in strings(t, base, h, body); equal windows have the same h. Whole shards are put together up to `chunk` bytes."""
    placed = strings.select("h", "t", "base", "body").repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def out() -> pa.RecordBatch:
            rows = ([], [], [])
            for (t, base, _), flag in zip(held, repeated_starts([x[2] for x in held], window), strict=True):
                for a, b in zip(*runs(flag), strict=True):
                    for col, v in zip(rows, (t, base + a, base + b), strict=True):
                        col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), *[pa.array(x, pa.int64()) for x in rows[1:]]], ["t", "lo", "hi"])

        for batch in batches:
            for h, t, base, body in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if size > chunk and h != last:
                    yield out()
                    held, size = [], 0
                held.append((t, base, body))
                size, last = size + len(body), h
        if held:
            yield out()

    return placed.mapInArrow(run, "t binary, lo long, hi long")


def repeats(texts: DataFrame, light: DataFrame, window: int, splits: tuple[int, ...], shard: int) -> DataFrame:
    """Runs of window starts (t, lo, hi) whose windows start elsewhere too. texts(t, base, body); light: LIGHT rows of them.

    Bytes that come twice under an anchor are repeated in whole: no text is read for them. Under an anchor with several different strings each of
    those goes once to the expansion. An anchor with more than `shard` bytes of them is parted further, in the end down to single windows, so
    that no shard outgrows a task and none is left out.
    """
    light = saved(light)
    once = saved(light.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("t", "base", "a", "n", "p")).alias("at")))
    keys = once.groupBy("h").agg(F.count("*").alias("m"), F.sum("at.n").alias("bytes")).where("m > 1")
    twice = once.where("k > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2"))
    # A string that many texts share is one key here; this join stands alone in its stage, so that Spark can split a hot one.
    found = saved(light.join(twice, (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2"))).select("t", (F.col("base") + F.col("a")).alias("lo"), (F.col("base") + F.col("a") + F.col("n") - window).alias("hi")))
    places = saved(once.join(keys, "h").select("at.*", "h", (F.col("bytes") > shard).alias("hot")))
    strings = saved(cut_out(texts, places))
    found = found.unionByName(expand(strings.where(~F.col("hot")), window))
    if not splits or places.where("hot").isEmpty():
        return found
    hot = strings.where("hot")
    deeper = repeats(hot.select("t", "base", "body"), parted(hot, window, splits[0]), window, splits[1:], shard)
    return found.unionByName(deeper)


# The operator ------------------------------------------------------------------------------------------------------------------------------------

FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_removed", "n_spans")]
    + [T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept_sha256", T.StringType())]
)


def remove_repeats(docs: DataFrame, window: int = 400, shard: int = SHARD, kept_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (start, end, start, end, ...), kept_sha256, and kept (binary) unless kept_text is False.

    Texts are UTF-8 bytes, null ones empty. Each byte inside a string of `window` bytes that also starts at another place of this or another
    text is removed; strings are judged on the input. Texts shorter than the window stay whole. Copies of a text of at least `window` bytes
    and repeated rows lose everything. Kept bytes may end inside a character. Columns named like the new ones are replaced; an empty table stays empty.

    Equal texts are one from the start: bodies are shuffled once, by their hash, with equal ones joined before the shuffle, and stay laid out by
    it in a table of the shared folder; places and ranges come to them. What goes back to docs is one row per different text.
    """
    new = {"n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    text = F.coalesce(F.col("text"), F.lit(""))
    named = base.withColumn("_t", F.unhex(F.md5(text.cast("binary")))).withColumn("n_bytes", F.octet_length(text).cast("long"))
    long = named.where(F.col("n_bytes") >= window)
    # A bucket holds what a shuffle partition would, so joins by t read the table without another shuffle.
    spark, fields = docs.sparkSession, [f for f in FIELDS if kept_text or f.name != "kept"]
    judged = only_result(spark, lambda: judge_texts(long.groupBy(F.col("_t").alias("t")).agg(F.first("text").alias("body"), F.count("*").alias("copies")), fields, window, shard))
    short = {"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": text.cast("binary"), "spans": F.array().cast("array<bigint>"), "kept_sha256": F.sha2(text.cast("binary"), 256)}
    own = named.withColumns({f"_own_{f.name}": F.when(F.col("n_bytes") < window, short[f.name]) for f in fields})
    out = own.join(judged, F.col("_t") == F.col("_u"), "left")
    return out.withColumns({f.name: F.coalesce(f"_own_{f.name}", f"_{f.name}") for f in fields}).select(*base.columns, "n_bytes", *[f.name for f in fields])


def judge_texts(bodies: DataFrame, fields: list[T.StructField], window: int, shard: int) -> DataFrame:
    """(_u, _<field> ...) of the different texts bodies(t, body, copies)."""
    texts = bucketed(bodies, "t", dealt=True)
    based = texts.select("t", F.lit(0).cast("long").alias("base"), "body")
    ranges = saved(repeats(based, segments(based.withColumnRenamed("body", "text"), window), window, SPLITS, shard))
    kept_text = any(f.name == "kept" for f in fields)
    lists = ranges.groupBy(F.col("t").alias("_t")).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))

    def make() -> Callable:
        def one(text: str, ranges: list | None, copies: int) -> tuple:
            raw = text.encode()
            if copies > 1:
                gone = np.ones(len(raw), bool)
            else:
                mark = np.zeros(len(raw) + 1, np.int32)
                for r in ranges or ():
                    mark[r["lo"]] += 1
                    mark[r["hi"] + window] -= 1
                gone = np.cumsum(mark[:-1]) > 0
            a, b = runs(gone)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if a else raw
            return len(raw) - len(kept), len(a), kept, [x for s, e in zip(a, b, strict=True) for x in (s, e + 1)], hashlib.sha256(kept).hexdigest()

        def work(texts: list, ranges: list, copies: list) -> list:
            cols = list(zip(*[one(*x) for x in zip(texts, ranges, copies, strict=True)], strict=True))
            return cols if kept_text else cols[:2] + cols[3:]

        return work

    judged = with_columns_of_text(texts.join(lists, F.col("t") == F.col("_t"), "left").select("t", "body", "_ranges", "copies"), T.StructType(fields), make, ("body", "_ranges", "copies"))
    return judged.select(F.col("t").alias("_u"), *[F.col(f.name).alias(f"_{f.name}") for f in fields])


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    """The digest of what 400-byte repeats leave of every document; repeats: whether they take anything."""
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), kept_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"))
