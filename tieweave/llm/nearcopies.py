"""SimHash near-dedup at a similarity of shingle sets: BK-trees over the fingerprints of shards, the sets decide.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in 10 bits on average and in up to 24. No choice of bit blocks shards for such a radius (of 26
blocks two would have to agree, five bits), so shards hold texts with an equal minimum of hashes instead: a text goes to 32 of them. What those leave open
is sharded by the rarest shingles of the sets, which a passage common to many different texts isn't among.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.llm.common import bucketed, only_result, saved, with_columns_of_text
from tieweave.llm.simhash import LOWER, BKTree
from tieweave.operators.components import components

#: Differing bits up to which fingerprints are compared further. A bit differs with probability arccos(cosine) / pi, 0.15 at 0.8: over 24 of 64 do in 1 pair of a million of
#: large sets. In sets of few shingles a bit differs up to 0.19 of the time, over 24 in 1 pair of 10,000: where one has under SMALL the bound is SMALL_RADIUS,
#: which 1 pair of 10^16 is beyond.
RADIUS, SMALL, SMALL_RADIUS = 24, 16, 44

#: A pair of similarity s shares no band, and so is missed, with probability (1 - s^ROWS)^BANDS: 3e-6 at 0.8, less above.
BANDS, ROWS = 32, 5
RNG = np.random.default_rng(42)
FLIPS, FACTORS = (RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
FACTORS |= np.uint64(1)

PRINTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("grams", T.ArrayType(T.LongType()))])


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes (seed 42) of the text's word shingles, sorted; of all its words where they are fewer than a shingle's."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    rows = zip(*[words[k:] for k in range(shingle)], strict=False) if len(words) >= shingle else [words]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(r), 42) for r in rows], np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set, none of them empty: sets of similarity s have the same key in a band with probability s^ROWS."""
    grams, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for j in range(BANDS):
        key = np.full(len(sets), j + 1, np.uint64)
        for k in range(j * ROWS, (j + 1) * ROWS):
            mixed = (grams ^ FLIPS[k]) * FACTORS[k]
            mixed ^= mixed >> np.uint64(32)
            key = (key ^ np.minimum.reduceat(mixed * FACTORS[k], starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, j] = key
    return keys.view(np.int64)


def set_print(grams: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: 64 bits, each set if it is set in over half of them."""
    bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).view(np.int64)[0])


def with_bands(docs: DataFrame, shingle: int) -> DataFrame:
    """docs with node (the hash of the set of shingles), n (its size), print (its fingerprint) and bands; without words 0, 0, 0 and no bands."""

    def make() -> Callable:
        import xxhash

        def work(texts: list[str | None]) -> list:
            sets = [shingles(t, shingle) for t in texts]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(full) if full else [])
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0 for s in sets]
            return [[x - (1 << 64) if x >> 63 else x for x in nodes], [len(s) for s in sets], [set_print(s) if len(s) else 0 for s in sets], [next(keys) if len(s) else [] for s in sets]]

        return work

    return with_columns_of_text(docs, PRINTS, make)


def with_grams(docs: DataFrame, shingle: int) -> DataFrame:
    return with_columns_of_text(docs, SETS, lambda: lambda texts: [[shingles(t, shingle).view(np.int64) for t in texts]])


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets(node, grams) have a Jaccard similarity of at least `least`."""
    one, two = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("_i", F.size(F.array_intersect("ga", "gb")))
    return both.where(F.col("_i") >= least * (F.size("ga") + F.size("gb") - F.col("_i")) - 1e-9).select("a", "b")


def prefixes(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(key, at, node, n, print, class): the grams among the first n - least * n + 1 of each set, rarest first, that another set of open_(node, n, print, class) has too.

    at: the gram's place in that order. Two sets of similarity `least` have one of these grams in common.
    """
    each = open_.select("node").join(sets.hint("merge"), "node").select("node", F.explode("grams").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = each.join(often.hint("merge"), "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("grams"))
    alone = F.col("n") - F.size("grams")
    first = F.slice("grams", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1 - alone))
    placed = open_.join(shared.hint("merge"), "node").select("node", "n", "print", "class", alone.alias("alone"), F.posexplode(first).alias("i", "gram"))
    return placed.select(F.col("gram.key").alias("key"), (F.col("alone") + F.col("i")).alias("at"), "node", "n", "print", "class")


#: Nodes of a shard up to which all its candidate pairs are given, to be compared outside of it; larger ones get their sets.
FEW = 32


def tree_links(members: DataFrame, sets: DataFrame, radius: int, least: float, few: int = FEW, most: int = 20_000, most_grams: int = 4_000_000) -> DataFrame:
    """(a, b): classes of members(key, at, node, n, print, class), a shard being the rows of one key, that nodes with similar sets(node, grams) link: enough of them that all such classes are connected.

    Each shard gets a BK-tree over its fingerprints, which its nodes outside its largest class ask, within the radius (SMALL_RADIUS for small sets). A pair also needs sizes that fit, and
    enough grams from the key on to reach the similarity; then the sets decide. A shard of up to `few` nodes gives its pairs, and each different one is compared once. The sets come along
    to the larger shards: there classes that are linked already aren't compared again, so such a shard gives fewer links than it has classes, however many of its nodes are
    similar. One of more than `most` nodes, or most_grams grams, is dealt into blocks, and each two blocks are a shard of their own.
    """
    size = members.groupBy("key").agg(F.count("*").alias("_m"), F.sum("n").alias("_g"), F.min("class").alias("_x"), F.max("class").alias("_y")).where("_x < _y")
    open_ = saved(size.select(F.col("key").alias("_k"), "_m", F.ceil(F.greatest(F.col("_m") / most, F.col("_g") / most_grams)).alias("_blocks")))
    rows = members.join(open_, F.col("key") == F.col("_k"))
    columns = ["key", "pair", "at", "node", "n", "print", "class"]

    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    two = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda other: F.least(own, other) * F.col("_blocks") + F.greatest(own, other))
    large = rows.where(F.col("_m") > few).withColumn("pair", F.explode(F.when(F.col("_blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(two)))
    linked = in_shards(large.select(*columns).join(sets.hint("merge"), "node").select(*columns, "grams"), radius, least, True)

    near = saved(in_shards(rows.where(F.col("_m") <= few).withColumn("pair", F.lit(0).cast("long")).select(*columns), radius, least, False).distinct())
    named = members.select(F.col("node").alias("_n"), F.col("class").alias("_c")).distinct()
    ends = similar(near, sets, least).join(named, F.col("a") == F.col("_n")).select("b", F.col("_c").alias("ka")).join(named, F.col("b") == F.col("_n")).select(F.col("ka").alias("a"), F.col("_c").alias("b"))
    return linked.unionByName(ends)


def in_shards(members: DataFrame, radius: int, least: float, whole: bool) -> DataFrame:
    """(a, b) of members(key, pair, at, node, n, print, class), a shard being the rows of one key and pair: if whole, the classes that its sets, in the column grams, link; else its candidate pairs of nodes."""
    placed = members.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = x[:, 4], y[:, 4]
        return (x[:, 6] != y[:, 6]) & (n >= least * m - 1e-9) & (m >= least * n - 1e-9) & (np.minimum(n - x[:, 2], m - y[:, 2]) >= least / (1 + least) * (n + m) - 1e-9)

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both) - 1e-9

    def pair_of(rows: np.ndarray, i: int, k: int) -> tuple[int, int]:
        a, b = rows[i, 6 if whole else 3], rows[k, 6 if whole else 3]
        return int(min(a, b)), int(max(a, b))

    def shard(rows: np.ndarray, grams: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        fingerprint, own = np.ascontiguousarray(rows[:, 5]).view(np.uint64), rows[:, 6]
        values, where = np.unique(fingerprint, return_inverse=True)
        order = np.argsort(where, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(where))])
        classes, number, sizes = np.unique(own, return_inverse=True, return_counts=True)
        asking = np.flatnonzero(own != classes[sizes.argmax()])
        at_value = {int(v): order[ends[i] : ends[i + 1]] for i, v in enumerate(values)}
        above = list(range(len(classes)))

        def root(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        tree, number = BKTree(values), number.tolist()
        # Sets that a small one can be similar to are small as well, but for those just above the bound: they ask twice.
        few = asking[rows[asking, 4] * least < SMALL]
        for queries, reach in ((asking, radius), (few, max(radius, SMALL_RADIUS))):
            for value, near in tree.walk(fingerprint[queries], reach) if len(queries) else ():
                for i in at_value[int(value)].tolist():
                    j = queries[near]
                    for k in j[fits(rows[j], rows[i : i + 1])].tolist():
                        x, y = root(number[i]), root(number[k])
                        if not whole:
                            yield pair_of(rows, i, k)
                        elif x != y and alike(grams[i], grams[k]):
                            above[max(x, y)] = min(x, y)
                            yield pair_of(rows, i, k)

    def links(rows: np.ndarray, grams: list[np.ndarray], starts: np.ndarray) -> Iterator[tuple[int, int]]:
        sizes = np.diff(np.append(starts, len(rows)))
        mixed = np.minimum.reduceat(rows[:, 6], starts) < np.maximum.reduceat(rows[:, 6], starts)
        # A tree of two nodes is one distance: all such shards at once.
        x = starts[mixed & (sizes == 2)]
        a, b = rows[x], rows[x + 1]
        reach = np.where(np.minimum(a[:, 4], b[:, 4]) < SMALL, max(radius, SMALL_RADIUS), radius)
        near = (np.bitwise_count(a[:, 5].view(np.uint64) ^ b[:, 5].view(np.uint64)) <= reach) & fits(a, b)
        for i in x[near].tolist():
            if not whole or alike(grams[i], grams[i + 1]):
                yield pair_of(rows, i, i + 1)
        for i in np.flatnonzero(mixed & (sizes > 2)).tolist():
            z = slice(starts[i], starts[i] + sizes[i])
            yield from shard(rows[z], grams[z])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_grams = np.empty((0, 7), np.int64), []

        def out(rows: np.ndarray, grams: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            found = set(links(rows, grams, starts))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(7)], axis=1)])
            grams = held_grams
            if whole:
                values, ends = batch.column(7).values.to_numpy(zero_copy_only=False), batch.column(7).offsets.to_numpy()
                grams = held_grams + [values[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            held, held_grams = rows[starts[-1] :], [g.copy() for g in grams[starts[-1] :]]
            if len(starts) > 1:
                yield out(rows[: starts[-1]], grams[: starts[-1]], starts[:-1])
        if len(held):
            yield out(held, held_grams, np.array([0]))

    return placed.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", shingle: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """docs' id with node (long) and component_id, the smallest id reachable over pairs of texts whose sets of word shingles have a Jaccard similarity of at least `least`.

    Equal sets are one node. First the nodes of each MinHash shard whose fingerprints are within the radius of its hub's are compared with the hub by their
    whole sets, so that a hot shard costs one comparison a member. The nodes of shards that are then still in several classes are sharded anew, by the rarest
    grams of their sets; a BK-tree of each shard proposes pairs of different classes within the radius, and the sets, which come along, decide. Texts without words, null ones too, are one node. Repeated rows stay and share their component; a null
    id gets its component's smallest non-null id. An empty table stays empty.
    """
    return only_result(docs.sparkSession, lambda: classes_of(docs, id_col, shingle, least, radius))


def classes_of(docs: DataFrame, id_col: str, shingle: int, least: float, radius: int) -> DataFrame:
    source = docs.select(F.col(id_col), "text", F.xxhash64("text").alias("_t"))
    prints = saved(with_bands(source, shingle).drop("text"))
    nodes = saved(prints.groupBy("node").agg(F.min(id_col).alias("least"), F.min(F.struct(id_col, "_t")).alias("_rep"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("bands").alias("bands")))
    each = nodes.select(F.explode("bands").alias("key"), "node", "n", "print")
    groups = each.groupBy("key").agg(F.min(F.struct("node", "n", "print")).alias("hub"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    members = saved(each.join(groups.hint("merge"), "key"))

    asked = members.select("node").distinct()
    rep = nodes.join(asked, "node", "left_semi").select("node", F.col("_rep").getField(id_col).alias("_id"), F.col("_rep._t").alias("_x"))
    texts = source.join(rep.hint("merge"), F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_t").eqNullSafe(F.col("_x"))).select("node", "text")
    # The sets are the bulk of all rounds: laid out by node once, so that only the pairs' own sets move.
    sets = bucketed(with_grams(texts, shingle).groupBy("node").agg(F.first("grams").alias("grams")), "node", dealt=True)

    size_fits = lambda x, y: (F.col(x) >= least * F.col(y) - 1e-9) & (F.col(y) >= least * F.col(x) - 1e-9)
    reach = lambda hub: F.when(F.least("n", f"{hub}.n") < SMALL, max(radius, SMALL_RADIUS)).otherwise(radius)
    fits = lambda hub: size_fits("n", f"{hub}.n") & (F.bit_count(F.col("print").bitwiseXOR(F.col(f"{hub}.print"))) <= reach(hub))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = members.where((F.col("node") != F.col("hub.node")) & fits("hub")).select(*pair("node", "hub.node")).distinct()
    label = saved(components(saved(similar(saved(star), sets, least)))).withColumnRenamed("node", "_c")  # (node, component) of the linked nodes
    named = members.select("key", "node", "n", "print").join(label, F.col("node") == F.col("_c"), "left")
    named = saved(named.select("key", "node", "n", "print", F.coalesce("component", "node").alias("class")))
    # Shards that are one class are done.
    split = named.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("key")
    open_ = saved(named.join(split.hint("merge"), "key", "left_semi").select("node", "n", "print", "class").distinct())
    links = saved(tree_links(saved(prefixes(open_, sets, least)), sets, radius, least).distinct())
    move = components(links).select(F.col("node").alias("_old"), F.col("component").alias("_new"))

    member = nodes.join(label, F.col("node") == F.col("_c"), "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    member = saved(member.join(move, F.col("class") == F.col("_old"), "left").select("node", "least", F.coalesce("_new", "class").alias("class")))
    lowest = member.groupBy(F.col("class").alias("_k")).agg(F.min("least").alias("component_id"))
    every = member.join(lowest, F.col("class") == F.col("_k")).select(F.col("node").alias("_f"), "component_id")
    return prints.join(every, F.col("node") == F.col("_f")).select(id_col, "node", "component_id")
