"""SimHash near-duplicates, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.llm.common import read, saved, with_columns_of_text
from tieweave.operators.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits, each set if it is set in over half the XXH64 hashes (seed 42) of the text's word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    rows = zip(*[words[k:] for k in range(shingle)], strict=False) if len(words) >= shingle else [words]
    h = xxhash.xxh64_digest
    raw = b"".join([h(b" ".join(r), 42) for r in rows])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs with fingerprint (long); a column of that name is replaced."""

    def make() -> Callable:
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return with_columns_of_text(docs, T.StructType([T.StructField("fingerprint", T.LongType())]), make)


class BKTree:
    """A BK-tree over 64-bit numbers: each child hangs under its parent by their Hamming distance."""

    def __init__(self, values: np.ndarray):
        todo = [(self, values)]
        while todo:
            node, rows = todo.pop()
            node.value, node.children = rows[0], {}
            far = np.bitwise_count(rows[1:] ^ rows[0])
            for d in np.unique(far):
                child = node.children[int(d)] = BKTree.__new__(BKTree)
                todo.append((child, rows[1:][far == d]))

    def walk(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
        """For each node that some queries reach: its value, and the positions of the queries within the radius.

        A query that is d away from a node follows only the edges d - radius to d + radius.
        """
        todo = [(self, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            d = np.bitwise_count(queries[at] ^ node.value).astype(np.int16)
            yield node.value, at[d <= radius]
            for edge, child in node.children.items():
                near = at[np.abs(d - edge) <= radius]
                if len(near):
                    todo.append((child, near))


def links_in_shard(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its class in this shard) for the distinct values that have links here: a star for each class, not all pairs."""
    if len(values) == 2:
        return [(int(values[1]), int(values[0]))] if int(values[0] ^ values[1]).bit_count() <= radius else []
    parent = np.arange(len(values))

    def roots(at: np.ndarray) -> np.ndarray:
        top = parent[at]
        while (above := parent[top]).tolist() != top.tolist():
            top = above
        parent[at] = top
        return top

    for _, at in BKTree(values).walk(values, radius):
        if len(at) > 1:
            top = roots(at)
            parent[top] = top.min()
    return [(int(values[i]), int(values[c])) for i, c in enumerate(roots(np.arange(len(values))).tolist()) if i != c]


def shard_keys(blocks: int, agree: int) -> list[int]:
    """Bit masks, each of `agree` of the blocks into which 64 bits are cut. Two numbers that differ in at most blocks - agree bits agree under one of them."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, agree)]


def fingerprint_links(distinct: DataFrame, radius: int = 4, agree: int = 2, most: int = 20_000) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at most `radius` bits apart.

    distinct(fingerprint): each once. Each goes to one shard for every choice of `agree` of radius + agree blocks of its bits, under the
    value that the chosen blocks have: a pair in reach shares one of them. Each shard, in the task that holds it, gets a BK-tree of its
    own that answers the shard's fingerprints; a tree isn't broadcast, because all trees together grow with the corpus. A shard of more than
    `most` fingerprints is dealt into blocks by their hash, and each two blocks are a shard of their own, so none outgrows a task.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in shard_keys(radius + agree, agree)]
    keys = F.array(*[F.struct(F.lit(i).alias("j"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    sharded = distinct.select(F.explode(keys).alias("s"), "fingerprint").select("s.j", "s.key", "fingerprint")
    size = sharded.groupBy("j", "key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = saved(size.select(F.col("j").alias("j2"), F.col("key").alias("key2"), F.ceil(F.col("n") / most).alias("blocks")))
    if large.isEmpty():
        placed = sharded.withColumn("pair", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
        two = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
        dealt = sharded.join(large, (F.col("j") == F.col("j2")) & (F.col("key") == F.col("key2")), "left")
        placed = dealt.select("j", "key", "fingerprint", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(two)).alias("pair"))
    # pair: the number of two blocks of a large shard; it parts shards like j and key do
    placed = placed.select("j", F.xxhash64("key", "pair").alias("shard"), "key", "pair", "fingerprint").repartition("j", "shard").sortWithinPartitions("j", "key", "pair", "fingerprint").select("j", "key", "pair", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        held = np.empty((0, 4), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)])
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
            held = rows[starts[-1] :]
            yield out([e for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if b - a > 1 for e in shard(rows[a:b, 3])])
        if len(held) > 1:
            yield out(list(shard(held[:, 3])))

    def shard(values: np.ndarray) -> Iterator[tuple[int, int]]:
        for a, b in links_in_shard(values.astype(np.int64).view(np.uint64), radius):
            yield tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))

    return placed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs' id with fingerprint (long) and component_id, the smallest id reachable over links of at most `radius` differing bits.

    Equal fingerprints are one node, however many documents have them. Texts without words, null ones too, have fingerprint 0 and are linked like
    any other. Repeated rows stay and share their component; a null id gets its component's smallest non-null id. An empty table stays empty.
    """
    prints = saved(with_fingerprint(docs.select(F.col(id_col), "text"), shingle).drop("text"))
    nodes = saved(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    classes = components(saved(fingerprint_links(nodes.select("fingerprint"), radius)))
    member = nodes.join(classes, F.col("fingerprint") == F.col("node"))
    lowest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(lowest, "component").select(F.col("fingerprint").alias("_print"), F.col("component_id").alias("_class"))
    # Only fingerprints with a link to another need the join by class; every row needs its fingerprint's least id.
    label = nodes.join(named, F.col("fingerprint") == F.col("_print"), "left").select(F.col("fingerprint").alias("_f"), F.coalesce("_class", "least").alias("component_id"))
    return prints.join(label, F.col("fingerprint") == F.col("_f")).select(id_col, "fingerprint", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its component."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
