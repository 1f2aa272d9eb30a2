"""Relationship-graph operators: DataFrame in, DataFrame out.

An undirected graph is a frame pairs(a, b) with a < b, each once; a directed one is edges(src, dst, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.functions.columns import base_strength, freshness
from tieweave.operators.components import bucketed, discard, only_result, saved, session_of_rounds, shuffles_deleted, tasks_for


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def sized_groups(members: DataFrame, group: str, least: int = 2, most: int | None = 40) -> DataFrame:
    """members of the groups with least to most rows (no upper bound if None); the size is counted before any pairing, so that a hub makes no pairs."""
    size = members.groupBy(group).agg(F.count("*").alias("_n")).where((F.col("_n") >= least) & (F.lit(True) if most is None else F.col("_n") <= most)).select(group)
    return members.join(size, group, "left_semi")


def co_members(members: DataFrame, person: str = "person", group: str = "company", most: int | None = 40) -> DataFrame:
    """Pairs (a, b, group) of people in one group; groups of one or over `most` make none."""
    kept = sized_groups(members, group, 2, most)
    left, right = kept.select(group, F.col(person).alias("a")), kept.select(F.col(group).alias("_g"), F.col(person).alias("b"))
    return left.join(right, (F.col(group) == F.col("_g")) & (F.col("a") < F.col("b"))).drop("_g")


def suppress(pairs: DataFrame, overrides: DataFrame) -> DataFrame:
    """pairs without those that overrides(a, b, action) removes, in either order."""
    gone = overrides.where("action = 'remove'").select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    return pairs.join(gone, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")


def downweight(pairs: DataFrame, overrides: DataFrame) -> DataFrame:
    """pairs with factor: 0 where removed, 0.5 where only downweighted, else 1."""
    mark = overrides.groupBy(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).agg(F.max((F.col("action") == "remove").cast("int")).alias("_r"))
    joined = pairs.join(mark, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return joined.withColumn("factor", F.when(F.col("_r") == 1, 0.0).when(F.col("_r") == 0, 0.5).otherwise(1.0)).drop("_a", "_b", "_r")


def degree(pairs: DataFrame) -> DataFrame:
    """(person, degree, share): the number of neighbours, and over the greatest."""
    n = both_ways(pairs).groupBy(F.col("a").alias("person")).agg(F.count("*").alias("degree"))
    top = n.agg(F.greatest(F.lit(1), F.max("degree")).alias("_top"))
    return n.join(F.broadcast(top)).withColumn("share", F.col("degree") / F.col("_top")).drop("_top")  # top is one row


def burt_constraint(pairs: DataFrame) -> DataFrame:
    """(person, constraint): sum over neighbours j of (p_ij + sum over common q of p_iq p_qj) squared, with p = 1 / degree."""
    sym = both_ways(pairs)
    n = sym.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("d"))
    own = sym.join(n, F.col("a") == F.col("w")).select("a", "b", (1 / F.col("d")).alias("p"))
    step = own.select(F.col("a").alias("q"), F.col("b").alias("j"), F.col("p").alias("p2"))
    two = own.join(step, (F.col("b") == F.col("q")) & (F.col("a") != F.col("j"))).groupBy("a", "j").agg(F.sum(F.col("p") * F.col("p2")).alias("s"))
    both = own.join(two.select(F.col("a").alias("i"), "j", "s"), (F.col("a") == F.col("i")) & (F.col("b") == F.col("j")), "left")
    return both.groupBy(F.col("a").alias("person")).agg(F.sum(F.pow(F.col("p") + F.coalesce("s", F.lit(0.0)), 2)).alias("constraint"))


def link_prediction(pairs: DataFrame, decided: DataFrame | None = None, least_common: int = 2, top: int | None = 200, most_degree: int | None = None) -> DataFrame:
    """(a, b, common, score): unlinked pairs with least_common neighbours or more, by the Adamic-Adar score.

    Two-step paths run through every neighbour w of degree 2 or more; with most_degree, not through hubs above it, which pair all their
    neighbours but add little to a score (1 / ln of their degree). Ties go by common neighbours, then by a and b.
    """
    sym = both_ways(pairs)
    n = sym.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("d")).where("d >= 2")
    if most_degree:
        n = n.where(F.col("d") <= most_degree)
    arms = sym.join(n, F.col("a") == F.col("w")).select("w", F.col("b").alias("x"), "d")
    other = arms.select(F.col("w").alias("w2"), F.col("x").alias("y"))
    wedges = arms.join(other, (F.col("w") == F.col("w2")) & (F.col("x") < F.col("y")))
    found = wedges.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("common"), F.sum(1 / F.log("d")).alias("score")).where(F.col("common") >= least_common)
    found = found.join(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    if decided is not None:
        found = found.join(decided.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    return found.orderBy(F.round("score", 9).desc(), F.desc("common"), "a", "b").limit(top) if top else found


def build_edges(relationships: DataFrame, nodes: DataFrame | None = None, reference_year: int = 1998, least: float = 0.40) -> DataFrame:
    """relationships with strength, freshness, weight and reason: why an edge is quarantined, the first that holds, null for an edge of the graph.

    Order: missing_evidence, missing_source, missing_target (where nodes(id) is given), low_confidence.
    """
    out = relationships.withColumn("strength", base_strength(F.col("kind"))).withColumn("freshness", freshness(F.col("year"), reference_year))
    out = out.withColumn("weight", F.col("strength") * F.col("confidence") * F.col("reliability") * F.col("freshness"))
    no_source, no_target = F.lit(False), F.lit(False)
    if nodes is not None:
        ids = nodes.select(F.col("id").alias("_s")).distinct()
        out = out.join(ids, F.col("src") == F.col("_s"), "left").join(ids.select(F.col("_s").alias("_t")), F.col("dst") == F.col("_t"), "left")
        no_source, no_target = F.col("_s").isNull(), F.col("_t").isNull()
    reason = F.when(F.col("evidence_id").isNull(), "missing_evidence").when(no_source, "missing_source").when(no_target, "missing_target").when(F.col("confidence") < least, "low_confidence")
    return out.withColumn("reason", reason).drop("_s", "_t")


def donation_nodes(donations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node for each donation with a positive amount, an edge from the donor and one to the recipient."""
    good = donations.where("amount > 0 and donor is not null and recipient is not null")
    nodes = good.select(F.col("donation").alias("id"), F.lit("donation_event").alias("type"))
    edges = good.select(F.explode(F.array(
        F.struct(F.col("donor").alias("src"), F.col("donation").alias("dst"), F.lit("MADE_DONATION").alias("kind")),
        F.struct(F.col("donation").alias("src"), F.col("recipient").alias("dst"), F.lit("RECEIVED_BY").alias("kind")),
    )).alias("e")).select("e.*")
    return nodes, edges


def reach_from(pairs: DataFrame, sources: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hop, root, via): breadth-first from all sources(node) at once; ties go to the smallest root, then to the smallest node in between.

    Each hop joins the frontier with the pairs and leaves out what was met before; the frontier is written after each hop.
    """
    sym = both_ways(pairs)
    met = sources.select("node", F.lit(0).alias("hop"), F.col("node").alias("root"), F.col("node").alias("via")).distinct()
    last = met
    for hop in range(1, hops + 1):
        step = last.join(sym, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.struct("root", F.col("a").alias("via")).alias("best"))
        first = step.groupBy("node").agg(F.min("best").alias("best")).select("node", F.lit(hop).alias("hop"), "best.root", "best.via")
        last = saved(first.join(met.select("node"), "node", "left_anti"))
        met = met.unionByName(last)
    return met


def page_rank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, dangling: str = "uniform", every: int = 5, batch: int = 16, side: Column | None = None, both: bool = False) -> DataFrame:
    """(seed, node, rank): personalised PageRank over weighted edges(src, dst, weight), for seeds(seed), `batch` of them in one pass.

    A node's rank goes out in proportion to the weights; the rank of nodes without an edge out goes to all nodes alike ("uniform") or to the seed
    ("restart"). Starts at 1 / n. Stops after `rounds`, or when the change over the last `every` rounds proves every seed as near to its end, in L1, as a change
    under tolerance in one round would; tolerance 0 runs all rounds.

    Edges are laid out by src once and don't move again; the state is a row per node with a column for each seed of the batch. Up to `every` rounds are one job, fewer where
    edges are many, a shuffle of partial sums each, whose result is written and takes the last one's place. Rank that leaves through nodes without an edge out isn't sent round: one more column
    starts from all nodes alike, and how much of it a seed gets follows from the sums at the end. Nodes that are longs are their own numbers; others get one while ranks go round.

    both: each edge leads either way; then it is written once and turned round where edges are laid out.

    side, with longs and tolerance 0: a condition on node; only ranks of nodes that it holds for are wanted. Where each edge leads from one side to the other, a round then needs half of the edges.
    """
    if dangling not in ("uniform", "restart"):
        raise ValueError(dangling)
    with shuffles_deleted(edges.sparkSession):
        return only_result(edges.sparkSession, lambda: ranked(edges, seeds, alpha, rounds, tolerance, dangling, every, batch, side, both))


def ranked(edges: DataFrame, seeds: DataFrame, alpha: float, rounds: int, tolerance: float, dangling: str, every: int, batch: int, side: Column | None, both: bool) -> DataFrame:
    args = (alpha, rounds, tolerance, dangling, every, batch)
    if isinstance(edges.schema["src"].dataType, T.LongType):
        return rank_rounds(edges, seeds, *args, side, both)
    if both:
        edges = edges.where("dst is not null")
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).union(seeds.select("seed")).where("name is not null").distinct()
    numbers = saved(names.withColumn("number", F.monotonically_increasing_id()))
    own = lambda name, number: numbers.select(F.col("name").alias(name), F.col("number").alias(number))
    links = edges.join(own("src", "s"), "src").join(own("dst", "d"), "dst", "left").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
    found = rank_rounds(links, seeds.join(own("seed", "s"), "seed").select(F.col("s").alias("seed")), *args, None, both)
    numbers = found.sparkSession.read.schema(numbers.schema).parquet(*numbers.inputFiles())
    return found.withColumnsRenamed({"seed": "s", "node": "d"}).join(own("seed", "s"), "s").join(own("node", "d"), "d").select("seed", "node", "rank")


#: Edges that one job of rank_rounds() goes over, and into how many passes laying them out is parted at most.
EDGES_A_JOB, MOST_PASSES = 10_000_000, 8


def rank_rounds(edges: DataFrame, seeds: DataFrame, alpha: float, rounds: int, tolerance: float, dangling: str, every: int, batch: int, side: Column | None, both: bool) -> DataFrame:
    spark = edges.sparkSession
    edges = saved(edges.where("src is not null and dst is not null" if both else "src is not null").select("src", "dst", "weight"))
    many = edges.count() * (2 if both else 1)
    tasks = tasks_for(spark, many)
    own = session_of_rounds(spark, tasks)
    ways = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if both else edges
    passes = min(MOST_PASSES, -(-many // EDGES_A_JOB)) or 1

    def shares(k: int) -> DataFrame:
        mine = ways.where(F.pmod(F.xxhash64("src"), F.lit(passes)) == k) if passes > 1 else ways
        flat = mine.repartition(tasks, "src").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        total = flat.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("total"))
        return flat.join(total, F.col("src") == F.col("s")).where("dst is not null").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("share"))

    # Many edges are laid out in passes, each over all edges of some nodes, so that one pass's shuffle files at a time lie beside the table.
    out = bucketed(shares(0), "from", dealt=True, n=tasks, session=own, more=[shares(k) for k in range(1, passes)])
    discard(edges)
    ends = out.select(F.col("from").alias("node"), F.lit(False).alias("sink"), F.lit(True).alias("idle")).unionByName(out.select(F.col("to").alias("node"), F.lit(True).alias("sink"), F.lit(False).alias("idle")))
    asked = saved(seeds.where("seed is not null").select("seed").distinct())
    asked = own.read.schema(asked.schema).parquet(*asked.inputFiles())
    ends = ends.unionByName(asked.select(F.col("seed").alias("node"), F.lit(True).alias("sink"), F.lit(True).alias("idle")))
    # sink: without an edge out; idle: without one in.
    nodes = saved(ends.groupBy("node").agg(F.bool_and("sink").alias("sink"), F.bool_and("idle").alias("idle")))
    size = nodes.agg(F.count("*").alias("n"), F.count_if("sink").alias("sinks"), F.count_if("idle").alias("idle"), F.count_if(F.col("sink") & ~(F.lit(True) if side is None else side)).alias("far")).first()
    n = size["n"]
    at = lambda c: F.col(c).alias("node")
    halves = None
    if side is not None:
        own_side = lambda c: out.select("from", "to", "share", at(c)).where(side).select("from", "to", "share")
        other = lambda c: out.select("from", "to", "share", at(c)).where(~side).select("from", "to", "share")
        across = out.select("from", "to", at("from")).withColumn("x", side).select("to", "x").select(at("to"), "x").where(side == F.col("x")).isEmpty()
        if tolerance == 0 and across and not size["far"]:
            halves = {True: own_side("to"), False: other("to")}
    seeds_ = [r["seed"] for r in asked.orderBy("seed").collect()]
    found = nodes.select(F.col("node").alias("seed"), "node", F.lit(0.0).alias("rank")).limit(0)
    enough = tolerance * alpha / (1 - alpha)  # how far from the end a change under tolerance can be
    chunk = max(1, min(every, EDGES_A_JOB // max(1, many)))
    for first in range(0, len(seeds_), batch):
        part = seeds_[first : first + batch]
        ranks = [f"r{i}" for i in range(len(part))]
        home = {r: f"IF(to = {seed}, {1 - alpha!r}D, 0D)" for r, seed in zip(ranks, part, strict=True)}
        if size["sinks"] and dangling == "uniform":
            ranks, home = [*ranks, "u"], home | {"u": f"{1.0 / n!r}D"}
        # Columns are made once: on small graphs most of a round would be making them.
        link, add = F.expr("node = from"), [F.expr(f"sum({r} * share) AS {r}") for r in ranks]
        step_on = [F.expr("to AS node"), *[F.expr(f"{alpha!r}D * {r} + {home[r]} AS {r}") for r in ranks]]
        state = nodes.select("node", *[F.lit(1.0 / n).alias(r) for r in ranks])
        idle = nodes.where("idle").select(F.col("node").alias("to"), F.lit(0.0).alias("share"), *[F.lit(0.0).alias(r) for r in ranks])
        idle = {near: idle.where(side if near else ~side) for near in (True, False)} if halves and size["idle"] else {True: idle, False: idle}
        move = [F.col(c) for c in ("to", "share", *ranks)]
        if halves:
            state = state.where(side if rounds % 2 == 0 else ~side)
        for done in range(0, rounds, every):
            steps, begun = min(every, rounds - done), state
            for start in range(0, steps, chunk):
                now = state
                for step in range(done + start, done + min(steps, start + chunk)):
                    near = (rounds - 1 - step) % 2 == 0  # whether this step is for the wanted side
                    # The state is the smaller side: it is hashed, and the edges are read past it as they lie.
                    moved = now.hint("shuffle_hash").join(halves[near] if halves else out, link)
                    if size["idle"]:
                        moved = moved.select(*move).unionByName(idle[near])
                    now = moved.groupBy("to").agg(*add).select(*step_on)
                before, state = state, saved(now)
                if start:
                    discard(before)
            change = None
            if tolerance > 0:
                old = begun.select(F.col("node").alias("o"), *[F.col(r).alias(f"{r}_old") for r in ranks])
                change = state.join(old, F.col("node") == F.col("o")).agg(*[F.sum(F.abs(F.col(r) - F.col(f"{r}_old"))).alias(r) for r in ranks]).first()
            if done:
                discard(begun)
            if change is not None and max((x or 0.0) for x in change) * alpha**steps / (1 - alpha**steps) < enough:
                break
        state = nodes.join(state, "node")
        if size["sinks"]:
            lost = state.where("sink").agg(*[F.sum(r).alias(r) for r in ranks]).first()
            if dangling == "uniform":
                more = {r: alpha * lost[r] / (1 - alpha * lost["u"]) for r in ranks if r != "u"}
                state = state.select("node", *[(F.col(r) + m * F.col("u")).alias(r) for r, m in more.items()])
            else:
                more = {r: 1 / (1 - alpha / (1 - alpha) * lost[r]) for r in ranks}
                state = state.select("node", *[(F.col(r) * m).alias(r) for r, m in more.items()])
        if side is not None:
            state = state.where(side)
        each = F.explode(F.array(*[F.struct(F.lit(seed).alias("seed"), F.col(f"r{i}").alias("rank")) for i, seed in enumerate(part)])).alias("x")
        found = found.unionByName(state.select("node", each).select("x.seed", "node", "x.rank"))
    return found


def eigenvector(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(person, score): power iteration from a uniform start, over the greatest at the end.

    Links are laid out once, by numbers of nodes, and don't move again: a round shuffles partial sums only. Five rounds are one job, after which the L2 norm is taken out.
    """
    return only_result(pairs.sparkSession, lambda: power_rounds(pairs, rounds))


def power_rounds(pairs: DataFrame, rounds: int, every: int = 5) -> DataFrame:
    sym = saved(both_ways(pairs))
    nodes = saved(sym.select(F.col("a").alias("person")).distinct().withColumn("node", F.monotonically_increasing_id()))
    own = lambda name, number: nodes.select(F.col("person").alias(name), F.col("node").alias(number))
    links = bucketed(sym.join(own("a", "to"), "a").join(own("b", "from"), "b").select("from", "to"), "from")
    score = nodes.select("node", F.lit(1.0).alias("x"))
    for done in range(0, rounds, every):
        for _ in range(min(every, rounds - done)):
            # The state is the smaller side: it is hashed, and the links are read past it as they lie.
            score = score.hint("shuffle_hash").join(links, F.col("node") == F.col("from")).groupBy(F.col("to").alias("node")).agg(F.sum("x").alias("x"))
        raw = saved(score)
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        score = raw.join(F.broadcast(norm)).select("node", (F.col("x") / F.col("norm")).alias("x"))  # norm is one row
    top = score.agg(F.max("x").alias("top"))
    return score.join(F.broadcast(top)).join(nodes, "node").select("person", (F.col("x") / F.col("top")).alias("score"))


def shortest_paths(edges: DataFrame, wanted: DataFrame, hops: int = 4) -> DataFrame:
    """(src, dst, path) for wanted(src, dst): a shortest directed path of at most `hops` edges; of several the least one. Pairs without one have a null path.

    For wanted(src): those to all other nodes that are reached, which needs no shuffle after the last hop.
    """
    out = saved(edges.select("src", F.col("dst").alias("next")).distinct())
    front = wanted.select(F.col("src").alias("s")).distinct().withColumn("node", F.col("s")).withColumn("path", F.array("s"))
    met = front
    for hop in range(1, hops + 1):
        step = front.join(out, F.col("node") == F.col("src")).select("s", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        front = step.groupBy("s", "node").agg(F.min("path").alias("path")).join(met.select("s", "node"), ["s", "node"], "left_anti")
        front = front if hop == hops else saved(front)  # the last one is read once
        met = met.unionByName(front)
    if "dst" not in wanted.columns:
        return met.where("node <> s").select(F.col("s").alias("src"), F.col("node").alias("dst"), "path")
    return wanted.join(met, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("node")), "left").select("src", "dst", "path")


def numbered_links(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes(node, n) have numbers in the order of their names, links(from, to) are pairs both ways round, by number."""
    pairs = saved(pairs.select("a", "b"))
    names = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = saved(names.orderBy("node").withColumn("n", F.monotonically_increasing_id()))
    own = lambda name, number: nodes.select(F.col("node").alias(name), F.col("n").alias(number))
    one_way = pairs.join(own("a", "x"), "a").join(own("b", "y"), "b").select("x", "y")
    return nodes, saved(one_way.select(F.col("x").alias("from"), F.col("y").alias("to")).unionByName(one_way.select(F.col("y").alias("from"), F.col("x").alias("to"))))


def betweenness(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(person, score): shortest-path dependencies from all sources(node) to every node, halved; exact if the sources are all nodes.

    Forward: the frontier of every source at once, with the number of shortest paths. Backward: from the deepest level up, each node hands its
    dependency to those before it in proportion to their paths. Each level is written once.
    """
    return only_result(pairs.sparkSession, lambda: dependencies(pairs, sources))


def dependencies(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Links are laid out once, by numbers of nodes, and don't move again: a level shuffles what it reaches only."""
    nodes, links = numbered_links(pairs)
    links = bucketed(links, "from")
    level = saved(sources.select("node").distinct().join(nodes, "node").select(F.col("n").alias("s"), F.col("n").alias("v"), F.lit(1.0).alias("paths")))
    levels, met = [level], level.select("s", "v")
    on = lambda frame: frame.hint("shuffle_hash").join(links, F.col("v") == F.col("from"))
    while True:
        step = on(levels[-1]).groupBy("s", F.col("to").alias("v")).agg(F.sum("paths").alias("paths"))
        found = saved(step.join(met, ["s", "v"], "left_anti"))
        if found.isEmpty():
            break
        # A link leads to the level that it comes from or to one beside it, so that two levels are all that can be met again.
        met = levels[-1].select("s", "v").unionByName(found.select("s", "v"))
        levels.append(found)
    below = levels[-1].withColumn("dep", F.lit(0.0))
    total = below.where("s <> v").select("v", "dep")
    for up in reversed(levels[:-1]):
        hand = on(below.select("s", "v", ((1 + F.col("dep")) / F.col("paths")).alias("part"))).groupBy("s", F.col("to").alias("v")).agg(F.sum("part").alias("part"))
        below = saved(up.join(hand, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("dep")))
        total = total.unionByName(below.where("s <> v").select("v", "dep"))
    scores = total.groupBy("v").agg((F.sum("dep") * 0.5).alias("score"))
    return scores.join(nodes, F.col("v") == F.col("n")).select(F.col("node").alias("person"), "score")


def communities(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    """(person, community): local moving by modularity gain; in each half of a round the nodes of one hash parity move at once.

    A node moves to the neighbouring community with the greatest gain k_in - total_degree * degree / 2m if that beats staying; ties go to the smallest
    community. Stops when neither half moves a node.
    """
    return only_result(pairs.sparkSession, lambda: local_moves(pairs, rounds))


def local_moves(pairs: DataFrame, rounds: int) -> DataFrame:
    """Nodes are numbers in the order of their names and links are laid out once: half a round sends the communities of all nodes, with their total degrees, over the links to the
    half that moves, and rates them where they arrive. The other half's state stays as it is."""
    nodes, links = numbered_links(pairs)
    m2 = max(1, links.count())
    state = saved(links.groupBy(F.col("from").alias("v")).agg(F.count("*").cast("double").alias("d")).join(nodes, F.col("v") == F.col("n")).select("v", "d", F.pmod(F.xxhash64("node"), F.lit(2)).alias("turn"), F.col("v").alias("c"), F.col("v").alias("old")))
    links = bucketed(links.join(state.select(F.col("v").alias("to"), F.col("d").alias("to_d"), "turn"), "to").select("from", "to", "to_d", "turn"), "from")
    halves = [state.where(F.col("turn") == parity) for parity in (0, 1)]
    for done in range(rounds):
        moved = 0
        for parity in (0, 1):
            now = halves[0].unionByName(halves[1])
            size = now.groupBy(F.col("c").alias("c2")).agg(F.sum("d").alias("total"))
            known = now.join(size, F.col("c") == F.col("c2")).select("v", "d", "turn", "c", "total")
            sent = known.select("v", "c", "total").hint("shuffle_hash").join(links.where(F.col("turn") == parity), F.col("v") == F.col("from"))
            sent = sent.select(F.col("to").alias("v"), F.col("to_d").alias("d"), "c", "total", F.lit(1.0).alias("k"), F.lit(False).alias("own"))
            stay = known.where(F.col("turn") == parity).select("v", "d", "c", "total", F.lit(0.0).alias("k"), F.lit(True).alias("own"))
            # Dealt by node alone, so that both groups below are made where the rows arrive.
            options = sent.unionByName(stay).repartition("v").groupBy("v", "c").agg(F.first("d").alias("d"), F.first("total").alias("total"), F.sum("k").alias("k"), F.max("own").alias("own"))
            gain = F.round(F.col("k") - (F.col("total") - F.when(F.col("own"), F.col("d")).otherwise(0.0)) * F.col("d") / m2, 9)
            best = options.groupBy("v").agg(F.first("d").alias("d"), F.min(F.struct((-gain).alias("loss"), (~F.col("own")).alias("other"), "c")).alias("pick"), F.max(F.when(F.col("own"), F.col("c"))).alias("old"))
            before, halves[parity] = halves[parity], saved(best.select("v", "d", F.lit(parity).cast("bigint").alias("turn"), F.col("pick.c").alias("c"), "old"))
            moved += halves[parity].where("c <> old").count()
            if done:
                discard(before)
        if not moved:
            break
    now = halves[0].unionByName(halves[1])
    own = lambda number, name: nodes.select(F.col("n").alias(number), F.col("node").alias(name))
    return now.select("v", "c").join(own("v", "person"), "v").join(own("c", "community"), "c").select("person", "community")


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row q: the modularity of labels(person, community)."""
    m = pairs.agg(F.count("*").cast("double").alias("m"))
    own = labels.select(F.col("person").alias("p"), F.col("community").alias("c"))
    inside = pairs.join(own, F.col("a") == F.col("p")).select("b", F.col("c").alias("ca")).join(own, F.col("b") == F.col("p")).where("ca = c").agg(F.count("*").alias("inside"))
    squares = both_ways(pairs).join(own, F.col("a") == F.col("p")).groupBy("c").agg(F.count("*").alias("d")).agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("sq"))
    return m.join(inside).join(squares).select((F.col("inside") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))).alias("q"))


def top_of_each(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)
