"""Graph operators over nodes (id, name, ...) and edges (src, dst, kind).

Traversals go level by level: one join per level against the frontier, with a visited
set, so cycles end and reachability never enumerates paths. Levels are checkpointed.
Only path enumeration (cycles, constrained paths) keeps paths, bounded by a depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.lineage import Scratch, durable


def of_kind(edges: DataFrame, kind: str | None) -> DataFrame:
    return edges if kind is None else edges.where(F.col("kind") == kind)


#: Most rows, of an id and a number, that a level or a ranking is broadcast with.
FEW = 100_000


def reach(edges: DataFrame, start: DataFrame, depth: int = 5, reverse: bool = False) -> DataFrame:
    """(id, depth): what is reached from start (id) in 1 to depth steps, at least depth.
    The start itself is in the result if a cycle leads back to it. A level that is counted
    and small is broadcast to the edges; a larger one is joined by a shuffle."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    hops = durable(edges.select(F.col(a).alias("a"), F.col(b).alias("id")).distinct())
    frontier = start.select(F.col("id").alias("a")).distinct()
    n, seen = frontier.count(), None
    for level in range(1, depth + 1):
        if not n:
            break
        step = hops.join(F.broadcast(frontier) if n <= FEW else frontier, "a").select("id").distinct()
        fresh = durable((step if seen is None else step.join(seen, "id", "left_anti")).withColumn("depth", F.lit(level)))
        n = fresh.count()
        seen = fresh if seen is None else seen.unionByName(fresh)
        frontier = fresh.select(F.col("id").alias("a"))
    return seen if seen is not None else start.select("id").limit(0).withColumn("depth", F.lit(0))


def callers(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    return reach(of_kind(edges, "calls"), start, depth, reverse=True)


def callees(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    return reach(of_kind(edges, "calls"), start, depth)


def impact(edges: DataFrame, start: DataFrame, depth: int = 10) -> DataFrame:
    """One row: n, max_depth and edge kinds of everything that depends on start."""
    found = durable(reach(edges, start, depth, reverse=True))
    kinds = edges.join(found.select(F.col("id").alias("src")), "src", "left_semi").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return found.agg(F.count("*").alias("n"), F.max("depth").alias("max_depth")).crossJoin(kinds)


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = 10) -> DataFrame:
    """(path, length) of the shortest path, of equal ones the smallest; no row if none.
    Keeps one path per node: the smallest on its level extends to the smallest after it."""
    spark = edges.sparkSession
    hops = durable(edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).distinct())
    frontier = spark.range(1).select(F.lit(str(start)).alias("a"), F.array(F.lit(str(start))).alias("path"))
    seen = frontier.select("a")
    for level in range(1, depth + 1):
        step = hops.join(frontier, "a").select(F.col("b").alias("a"), F.array_append("path", F.col("b")).alias("path"))
        frontier = durable(step.join(seen, "a", "left_anti").groupBy("a").agg(F.min("path").alias("path")))
        hit = frontier.where(F.col("a") == str(end)).select("path", F.lit(level).alias("length"))
        if not hit.isEmpty() or frontier.isEmpty():
            return hit
        seen = seen.unionByName(frontier.select("a"))
    return hit


def simple_paths(edges: DataFrame, start: str, end: str, depth: int, avoid: Sequence[str] = (), through: Sequence[str] | None = None) -> DataFrame:
    """(path, length) of simple paths; what must be avoided never enters the search.

    With `through`, the search ends at the first length at which a path has all of these
    nodes, and gives the paths of that length. A path is only followed while the end can
    still be reached in the steps that are left."""
    spark = edges.sparkSession
    hops = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).distinct()
    if avoid:
        hops = hops.where(~F.col("b").isin(*map(str, avoid)))
    hops = durable(hops)
    goal = spark.range(1).select(F.lit(str(end)).alias("id"))
    near = reach(hops.select(F.col("a").alias("src"), F.col("b").alias("dst")), goal, depth, reverse=True).where(F.col("id") != str(end))
    left = durable(near.unionByName(goal.withColumn("depth", F.lit(0))).withColumnRenamed("id", "b"))
    leading = durable(hops.join(left, "b"))
    frontier = spark.range(1).select(F.lit(str(start)).alias("a"), F.array(F.lit(str(start))).alias("path"))
    found = None
    for level in range(1, depth + 1):
        step = leading.where(F.col("depth") <= depth - level).join(frontier, "a").where(~F.array_contains("path", F.col("b")))
        grown = durable(step.select(F.col("b").alias("a"), F.array_append("path", F.col("b")).alias("path")))
        hit = grown.where(F.col("a") == str(end)).select("path", (F.size("path") - 1).alias("length"))
        if through is not None:
            for node in through:
                hit = hit.where(F.array_contains("path", str(node)))
            if not hit.isEmpty():
                return hit
        found = hit if found is None else found.unionByName(hit)
        frontier = grown.where(F.col("a") != str(end))
        if frontier.isEmpty():
            break
    return found


def _covering_walk(hops: DataFrame, start: str, end: str, bit: Column, full: int, depth: int) -> DataFrame:
    """(path): the smallest of the shortest walks from start to end over all needed nodes;
    no row if there is none. A walk may come by a node twice. One walk is kept for each
    node and set of needed nodes behind it, so there are no more than nodes x 2^needed."""
    first = hops.sparkSession.range(1).select(F.lit(start).alias("b"))
    frontier = durable(first.select(F.col("b").alias("a"), bit.alias("mask"), F.array("b").alias("path")))
    seen = frontier.select("a", "mask")
    hit = frontier.select("path").limit(0)
    for _ in range(depth):
        step = hops.join(frontier, "a").select("b", F.col("mask").bitwiseOR(bit).alias("mask"), F.array_append("path", F.col("b")).alias("path"))
        fresh = step.withColumnRenamed("b", "a").join(seen, ["a", "mask"], "left_anti")
        frontier = durable(fresh.groupBy("a", "mask").agg(F.min("path").alias("path")))
        hit = frontier.where((F.col("a") == end) & (F.col("mask") == full)).select("path")
        if not hit.isEmpty() or frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("a", "mask"))
    return hit


def _steps_left(hops: DataFrame, end: str, bit: Column, depth: int) -> DataFrame:
    """(b, covers, left): the least steps from b to the end over needed nodes `covers`,
    those behind b; one row for each node and set."""
    frontier = durable(hops.sparkSession.range(1).select(F.lit(end).alias("b"), F.lit(0).cast("long").alias("covers")))
    found = frontier.withColumn("left", F.lit(0))
    for level in range(1, depth):
        step = hops.join(frontier, "b").select(F.col("a").alias("b"), F.col("covers").bitwiseOR(bit).alias("covers")).distinct()
        frontier = durable(step.join(found, ["b", "covers"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("left", F.lit(level)))
    return durable(found)


def constrained_path(edges: DataFrame, start: str, end: str, must_pass: Sequence[str] = (), must_avoid: Sequence[str] = (), depth: int = 15) -> DataFrame:
    """(path, length) of the shortest simple path through every node of must_pass and none of
    must_avoid; of equal ones the smallest; no row if none.

    The shortest walk is sought first, over nodes and sets of nodes passed. If it comes by
    no node twice it is the path. Otherwise simple paths are followed, but only those from
    which the end can be reached over what is still needed within a length, which grows
    from that of the walk on."""
    start, end, needed = str(start), str(end), sorted({*map(str, must_pass)})
    avoid = {*map(str, must_avoid)}
    bit = F.lit(0).cast("long")
    for k, node in enumerate(needed):
        bit = bit.bitwiseOR(F.when(F.col("b") == node, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    full = (1 << len(needed)) - 1
    hops = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).distinct()
    hops = durable(hops.where((F.col("b") != start) & (F.col("a") != end) & ~F.col("b").isin(*avoid)))
    walk = durable(_covering_walk(hops, start, end, bit, full, depth))
    length = (F.size("path") - 1).alias("length")
    shortest = walk.select(length).first()
    if shortest is None or not walk.where(F.size(F.array_distinct("path")) == F.size("path")).isEmpty():
        return walk.select("path", length)
    left = _steps_left(hops, end, bit, depth)
    first = hops.sparkSession.range(1).select(F.lit(start).alias("b"))
    for most in range(shortest.length, depth + 1):
        frontier = durable(first.select(F.col("b").alias("a"), bit.alias("mask"), F.array("b").alias("path")))
        for level in range(1, most + 1):
            grown = hops.join(frontier, "a").where(~F.array_contains("path", F.col("b"))).select("b", F.col("mask").bitwiseOR(bit).alias("mask"), F.array_append("path", F.col("b")).alias("path"))
            near = left.where(F.col("left") <= most - level)
            open_ = grown.join(near, "b").where(F.col("mask").bitwiseOR(F.col("covers")) == full).groupBy("b", "mask", "path").agg(F.min("left").alias("left"))
            frontier = durable(open_.select(F.col("b").alias("a"), "mask", "path"))
            if frontier.isEmpty():
                break
        found = frontier.where(F.col("a") == end).agg(F.min("path").alias("path")).where("path IS NOT NULL")
        if not found.isEmpty():
            return found.select("path", length)
    return walk.select("path", length).limit(0)


def cycles(edges: DataFrame, depth: int = 10) -> DataFrame:
    """(cycle, length): every simple cycle of at most `depth` nodes once, written from its
    smallest node. Only links within a strong component can close. Steps back to every
    possible first node are counted first, over larger nodes alone, and a path grows only
    where enough steps are left to close it."""
    hops = durable(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    alone = hops.where("a = b").select(F.array("a").alias("cycle"), F.lit(1).alias("length"))
    part = durable(strong_components(edges))
    inside = hops.where("a <> b").join(part.withColumnRenamed("id", "a"), "a").join(part.select(F.col("id").alias("b"), F.col("component").alias("other")), "b")
    inside = durable(inside.where("component = other").select("a", "b"))
    frontier = durable(inside.where("a > b").select(F.col("b").alias("first"), "a"))
    back = frontier.withColumn("left", F.lit(1))
    for level in range(2, depth):
        step = inside.join(frontier.withColumnRenamed("a", "b"), "b").where("a > first").select("first", "a").distinct()
        frontier = durable(step.join(back, ["first", "a"], "left_anti"))
        if frontier.isEmpty():
            break
        back = back.unionByName(frontier.withColumn("left", F.lit(level)))
    back = durable(back)
    found = alone
    paths = durable(inside.where("a < b").select(F.col("a").alias("first"), F.col("b").alias("a"), F.array("a").alias("path")).join(back.where(F.col("left") <= depth - 1), ["first", "a"]))
    for level in range(2, depth + 1):  # nodes of a path with its end
        whole = paths.withColumn("path", F.array_append("path", F.col("a")))
        found = found.unionByName(whole.where("left = 1").select(F.col("path").alias("cycle"), F.size("path").alias("length")))
        step = whole.drop("left").join(inside, "a").where((F.col("b") > F.col("first")) & ~F.array_contains("path", F.col("b"))).select("first", F.col("b").alias("a"), "path")
        paths = durable(step.join(back.where(F.col("left") <= depth - level), ["first", "a"]))
        if paths.isEmpty():
            break
    return found


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out, caller, callee and contained degrees of every node."""
    calls, holds = F.col("kind") == "calls", F.col("kind") == "contains"
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"), F.count_if(calls).alias("callers"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"), F.count_if(calls).alias("callees"), F.count_if(holds).alias("contains"))
    joined = nodes.select("id").join(ins, "id", "left").join(outs, "id", "left")
    return joined.na.fill(0)


def most_called(nodes: DataFrame, edges: DataFrame, n: int = 20, outgoing: bool = False) -> DataFrame:
    end = "src" if outgoing else "dst"
    counts = of_kind(edges, "calls").groupBy(F.col(end).alias("id")).agg(F.count("*").alias("calls"))
    return counts.join(nodes, "id").select("id", "name", "calls").orderBy(F.desc("calls"), "name").limit(n)


def containment_depth(nodes: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(id, depth): number of containers above each node; a cycle counts up to its nodes."""
    up = durable(of_kind(edges, "contains").select(F.col("dst").alias("id"), F.col("src").alias("up")).distinct())
    chain, out = up, None
    for level in range(1, most + 1):
        here = chain.select("id").distinct().withColumn("depth", F.lit(level))
        out = here if out is None else out.unionByName(here)
        step = chain.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").where("next <> id")
        chain = durable(step.select("id", F.col("next").alias("up")).distinct())
        if chain.isEmpty():
            break
    deepest = out.groupBy("id").agg(F.max("depth").alias("depth"))
    return nodes.select("id").join(deepest, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank). Parallel edges count; rank that reaches a node without calls is lost.

    Links are dealt by their source once and stay so; a round moves ranks to them, which are
    broadcast where the nodes are counted and few, and what they give to their ends."""
    ids = durable(nodes.select("id").distinct())
    n = ids.count()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    given = edges.groupBy("src", "dst").agg(F.count("*").alias("times")).join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share"))
    for end in ("src", "dst"):  # nodes that aren't listed have no rank
        given = given.join(ids.withColumnRenamed("id", end), end, "left_semi")
    # A link of no weight to itself keeps a node that nothing leads to.
    links = durable(given.unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("share"))))
    few = n <= FEW
    if not few:
        links = links.repartition("src").persist(StorageLevel.DISK_ONLY)
    rank = ids.withColumn("rank", F.lit(1.0 / max(1, n)))
    for k in range(rounds):
        held = rank.withColumnRenamed("id", "src")
        got = links.join(F.broadcast(held) if few else held, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = got.select("id", (F.lit((1 - damping) / max(1, n)) + damping * F.col("got")).alias("rank"))
        if k % 5 == 4 or k == rounds - 1:
            rank = durable(rank)
    if not few:
        links.unpersist()
    return rank


def _flooded(labels: DataFrame, hops: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest label (an ordered struct) that reaches each node along hops (a, b)."""
    while True:
        offers = hops.join(labels.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "label")
        grown = scratch.keep(labels.unionByName(offers).groupBy("id").agg(F.min("label").alias("label")))
        if grown.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            return grown
        labels = grown


def _trimmed(hops: DataFrame, scratch: Scratch) -> DataFrame:
    """hops without those from nodes that nothing leads to or to nodes that lead nowhere."""
    ends, starts = hops.select(F.col("b").alias("a")).distinct(), hops.select(F.col("a").alias("b")).distinct()
    return scratch.keep(hops.join(ends, "a", "left_semi").join(starts, "b", "left_semi"))


def _without_chains(hops: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """hops in which one link stands for each run of nodes with one link in and one out; the
    runs (id, head, tail); and rings that are nothing but such nodes (id, ring).

    Every node of a run looks twice as far ahead in each round, so the number of rounds is
    the logarithm of a run's length."""
    single = hops.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")
    onward = hops.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.min("b").alias("to")).where("n = 1")
    inner = scratch.keep(onward.join(single, "id").select("id", "to"))
    if inner.isEmpty():
        return hops, None, None
    # last: the farthest node of the run seen so far; least: the smallest; to: what follows.
    ahead = inner.select("id", "to", F.col("id").alias("last"), F.col("id").alias("least"))
    running = None
    while True:
        then = ahead.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("last").alias("far"), F.col("least").alias("low"))
        joined = ahead.join(then, "to", "left")
        ahead = scratch.keep(joined.select("id", F.coalesce("next", "to").alias("to"), F.coalesce("far", "last").alias("last"), F.least("least", "low").alias("least")))
        open_ = ahead.join(inner.select(F.col("id").alias("to")), "to", "left_semi")
        state = open_.agg(F.count("*").alias("n"), F.sum(F.xxhash64("least").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or state == running:  # nothing goes on but rings, whose least is settled
            break
        running = state
    ring = open_.select("id", F.col("least").alias("ring"))
    runs = ahead.join(inner.select(F.col("id").alias("to")), "to", "left_anti")
    entered = hops.join(inner.select(F.col("id").alias("b")), "b", "left_semi").join(inner.select(F.col("id").alias("a")), "a", "left_anti")
    heads = entered.join(runs.select(F.col("id").alias("b"), "last", F.col("to").alias("tail")), "b").select("last", F.col("a").alias("head"), "tail")
    heads = scratch.keep(heads)
    chained = scratch.keep(runs.select("id", "last").join(heads, "last").select("id", "head", "tail"))
    passed = inner.select("id")
    others = hops.join(passed.withColumnRenamed("id", "a"), "a", "left_anti").join(passed.withColumnRenamed("id", "b"), "b", "left_anti")
    short = heads.where("head <> tail").select(F.col("head").alias("a"), F.col("tail").alias("b"))
    return scratch.keep(others.unionByName(short).distinct()), chained, scratch.keep(ring)


def strong_components(edges: DataFrame, least: int = 2) -> DataFrame:
    """(id, component): strongly connected sets of at least `least` nodes, named by their
    smallest node.

    Nodes that nothing leads to, or that lead nowhere, are alone and go; runs of nodes with
    one way in and one way out become one link. In what is left every node is a pivot, in a
    random order: the first pivot that reaches a node colours it, what reaches its colour's
    pivot within the colour is a component, and links between colours are cut, since no
    component lies across. The random order halves chains of components, so the rounds grow
    with the logarithm of their number."""
    scratch = Scratch(edges.sparkSession)
    hops = scratch.keep(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().where("a <> b"))
    ids = hops.select(F.col("a").alias("id")).unionByName(hops.select(F.col("b").alias("id"))).distinct()
    found, chains, n, turn = None, [], hops.count(), 0

    def keep(more: DataFrame) -> None:
        nonlocal found
        found = more if found is None else found.unionByName(more)

    while n:
        before = None
        while n and n != before:
            before = n
            hops, chained, rings = _without_chains(hops, scratch)
            if chained is not None:
                chains.append(chained)
                keep(rings.select("id", F.col("ring").alias("component")))
            hops = _trimmed(hops, scratch)
            n = hops.count()
        if not n:
            break
        turn += 1
        nodes = hops.select(F.col("a").alias("id")).unionByName(hops.select(F.col("b").alias("id"))).distinct()
        colour = _flooded(nodes.select("id", F.struct(F.xxhash64(F.lit(turn), "id").alias("order"), F.col("id").alias("pivot")).alias("label")), hops, scratch)
        colour = scratch.keep(colour.select("id", F.col("label.pivot").alias("component")))
        same = hops.join(colour.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").where("ca = cb")
        same = scratch.keep(same.select("a", "b"))
        members = fresh = scratch.keep(colour.where("id = component"))
        while True:
            step = same.join(fresh.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component").distinct()
            fresh = scratch.keep(step.join(members.select("id"), "id", "left_anti"))
            if fresh.isEmpty():
                break
            members = members.unionByName(fresh)
        members = scratch.keep(members)
        keep(members)
        gone = members.select("id")
        hops = scratch.keep(same.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
        n = hops.count()
    if found is None and not chains:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    # A run belongs to a component if both its ends do. The last runs come first: they may
    # lie between nodes of earlier ones, never the other way about.
    placed = ids.join(found, "id", "left") if found is not None else ids.withColumn("component", F.lit(None).cast(ids.schema["id"].dataType))
    placed = scratch.keep(placed.withColumn("component", F.coalesce("component", "id")))
    for chained in reversed(chains):
        ends = chained.join(placed.select(F.col("id").alias("head"), F.col("component").alias("x")), "head").join(placed.select(F.col("id").alias("tail"), F.col("component").alias("y")), "tail")
        drawn = ends.where("x = y").select("id", F.col("x").alias("drawn"))
        placed = scratch.keep(placed.join(drawn, "id", "left").select("id", F.coalesce("drawn", "component").alias("component")))
    sized = placed.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n")).where(F.col("n") >= least)
    return scratch.close(placed.join(sized, "component").select("id", F.col("least").alias("component")))


def betweenness(edges: DataFrame, sources: DataFrame, depth: int = 64, scale: float = 1.0) -> DataFrame:
    """(id, score): shortest paths through a node, from each source (id) to all others.

    Breadth-first levels carry path counts keyed by (source, node); dependencies flow
    back level by level."""
    hops = durable(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    frontier = durable(sources.select(F.col("id").alias("s"), F.col("id").alias("n"), F.lit(1.0).alias("paths"), F.lit(0).alias("level")))
    levels = [frontier]
    seen = frontier.select("s", "n")
    for level in range(1, depth + 1):
        step = frontier.join(hops, F.col("n") == F.col("a")).groupBy("s", F.col("b").alias("m")).agg(F.sum("paths").alias("paths"))
        fresh = step.withColumnRenamed("m", "n").join(seen, ["s", "n"], "left_anti")
        frontier = durable(fresh.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = durable(seen.unionByName(frontier.select("s", "n")))
    total = None
    below = levels[-1].select("s", "n", "paths").withColumn("dep", F.lit(0.0))
    for here in reversed(levels[:-1]):
        lower = below.select(F.col("s").alias("s2"), F.col("n").alias("m"), F.col("paths").alias("pm"), "dep")
        flow = here.join(hops, F.col("n") == F.col("a")).join(lower, (F.col("s") == F.col("s2")) & (F.col("b") == F.col("m")))
        got = flow.groupBy("s", "n").agg(F.sum(F.col("paths") / F.col("pm") * (1 + F.col("dep"))).alias("dep"))
        below = durable(here.select("s", "n", "paths").join(got, ["s", "n"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0))))
        part = below.where("s <> n").select(F.col("n").alias("id"), "dep")
        total = part if total is None else total.unionByName(part)
    if total is None:
        return sources.select("id", F.lit(0.0).alias("score"))
    return total.groupBy("id").agg((F.sum("dep") * scale).alias("score"))


def sample_sources(nodes: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """A repeatable sample for estimated betweenness; scale scores by 1 / share."""
    return nodes.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("id")


def subgraph(nodes: DataFrame, edges: DataFrame, start: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within hops of start in either direction, and the edges between them."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = durable(reach(both, start, hops).select("id").unionByName(start.select("id")).distinct())
    kept = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(near, "id", "left_semi"), kept


def call_subgraph(edges: DataFrame, start: DataFrame, depth: int = 5, reverse: bool = False, most: int | None = None) -> DataFrame:
    """(src, dst, depth): the calls that lead away from start (to it, if reverse), each at
    the least number of steps it ends; with `most`, so many, nearest first."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    calls = of_kind(edges, "calls").select("src", "dst").distinct()
    inner = reach(calls, start, depth - 1, reverse) if depth > 1 else start.select("id", F.lit(0).alias("depth")).limit(0)
    seen = inner.join(start.select("id"), "id", "left_anti").unionByName(start.select("id", F.lit(0).alias("depth")))
    found = calls.join(seen.withColumnRenamed("id", near), near).select("src", "dst", (F.col("depth") + 1).alias("depth"))
    return found if most is None else found.orderBy("depth", near, far).limit(most)


def project_subgraph(nodes: DataFrame, edges: DataFrame, project: Column, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of a project (the first `most` by id), and the edges between them."""
    own = nodes.where(project)
    own = own if most is None else own.orderBy("id").limit(most)
    ids = durable(own.select("id"))
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return own, kept


def call_lists(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """(id, calls, called_by): for start and what it reaches in fewer than depth steps, the
    sorted names of what each calls and is called by."""
    calls = of_kind(edges, "calls").select("src", "dst").distinct()
    ids = start.select("id")
    if depth > 1:
        ids = ids.unionByName(reach(calls, start, depth - 1).select("id")).distinct()
    ids = durable(ids)
    out = calls.join(ids.withColumnRenamed("id", "src"), "src").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("calls"))
    into = calls.join(ids.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("called_by"))
    return ids.join(out, "id", "left").join(into, "id", "left")


def node_id(file: Column, qualified: Column, line: Column) -> Column:
    """An id that stays the same as long as file, qualified name and line do."""
    return F.substring(F.sha2(F.concat_ws(":", file, qualified, line.cast("string")), 256), 1, 32)


def build_graph(functions: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) from functions (file, qualified, line, source): ids that
    don't change between builds, and an edge for every call that one node answers to."""
    named = functions.withColumn("id", node_id(F.col("file"), F.col("qualified"), F.col("line")))
    nodes = named.select("id", F.element_at(F.split("qualified", r"\."), -1).alias("name"), "qualified", "file", "line", F.lit("function").alias("kind"))
    refs = named.select(F.col("id").alias("src"), F.explode(extract_calls(F.col("source"))).alias("name"))
    edges, unresolved = resolve_references(refs, nodes, most)
    return nodes, edges, unresolved


def find_nodes(nodes: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Nodes whose name contains the text, whatever its case."""
    return nodes.where(F.contains(F.lower(column), F.lit(text.lower())))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n) counts of nodes and edges by kind."""
    a = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    b = edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    return a.unionByName(b)


def resolve_references(refs: DataFrame, nodes: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """refs (src, name) to edges by exact qualified name, else by a simple name that one
    node has; and the unresolved with up to `most` candidates."""
    exact = nodes.select(F.col("qualified").alias("name"), F.col("id").alias("exact")).dropDuplicates(["name"])
    simple = nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("one"), F.slice(F.array_sort(F.collect_set("qualified")), 1, most).alias("candidates"))
    joined = refs.join(exact, "name", "left").join(simple, "name", "left")
    target = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")))
    found = joined.withColumn("dst", target)
    edges = found.where("dst IS NOT NULL").select("src", "dst", F.lit("calls").alias("kind"))
    return edges, found.where("dst IS NULL").select("src", "name", "candidates")


#: Words before a parenthesis that call nothing.
KEYWORDS = ("if", "for", "while", "switch", "return", "catch")


def extract_calls(source: Column) -> Column:
    """Distinct names that are called in a source text, keywords left out."""
    names = F.regexp_extract_all(source, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    return F.array_except(names, F.array(*(F.lit(w) for w in KEYWORDS)))


def extract_usages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, name, receiver, form): every call of a text, line by line; form is call,
    method (behind a receiver and a dot) or reference (a name given to a collection
    function). Lines count from 1."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "__line"))
    calls = lines.select(key, (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("__line", F.lit(r"(?:\w+\.)?\w+\s*\("), F.lit(0))).alias("__call"))
    receiver = F.regexp_extract("__call", r"^(\w+)\.", 1)
    name = F.regexp_extract("__call", r"(\w+)\s*\($", 1)
    shown = calls.select(key, "line", name.alias("name"), F.nullif(receiver, F.lit("")).alias("receiver"), F.when(receiver != "", "method").otherwise("call").alias("form"))
    given = F.regexp_extract_all("__line", F.lit(r"(?:map|filter|find|findAll|each|fold|reduce|sort|sortr)\s*\(\s*(\w+)\s*\)"), F.lit(1))
    references = lines.select(key, (F.col("at") + 1).alias("line"), F.explode(given).alias("name"), F.lit(None).cast("string").alias("receiver"), F.lit("reference").alias("form"))
    return shown.unionByName(references).where(~F.col("name").isin(*KEYWORDS))


def export(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(text): one line per element for dot, one JSON record per element for json, d3 and
    cytoscape. Elements stay rows, so a large graph is written in parallel."""
    node_id, name = F.col("id").cast("string"), F.col("name").cast("string")
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    if form == "dot":
        escaped = F.replace(name, F.lit('"'), F.lit('\\"'))
        a = nodes.select(F.format_string('  "%s" [label="%s"];', node_id, escaped).alias("text"))
        b = edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', src, dst, F.col("kind")).alias("text"))
    elif form == "cytoscape":
        a = nodes.select(F.to_json(F.struct(F.struct(node_id.alias("id"), name.alias("label")).alias("data"))).alias("text"))
        b = edges.select(F.to_json(F.struct(F.struct(src.alias("source"), dst.alias("target"), F.col("kind").alias("label")).alias("data"))).alias("text"))
    elif form in ("json", "d3"):
        ends = ("source", "target") if form == "d3" else ("from", "to")
        a = nodes.select(F.to_json(F.struct(node_id.alias("id"), name.alias("name"))).alias("text"))
        b = edges.select(F.to_json(F.struct(src.alias(ends[0]), dst.alias(ends[1]), F.col("kind").alias("type"))).alias("text"))
    else:
        raise ValueError(f"no format {form!r}")
    return a.unionByName(b)
