"""The prefix trie of conversations, built as a Patricia tree.

A node is a sequence of turns that a conversation starts with. Of every conversation only
digests of its turns are moved: chained, so that the digest at depth d stands for the whole
prefix, and written one behind the other as its path. Equal conversations collapse first,
so a third of all under one path is a few rows. The rest is

1. a sort: paths are dealt by ranges and sorted; neighbours' common prefixes, at borders of
   ranges too, name every branch (`_sorted`);
2. points: only branches, ends of conversations and leaves, with compressed edges between
   them. The first path in the order that runs through a node owns it, so the edges of all
   points lie in one row each, without a join (`_edges`);
3. aggregates on points alone: members go up the path of each different conversation, costs
   and leaves up the path of each point, both combined before they are shuffled;
4. expansion: a node inside an edge has its point's members, and its costs are the point's
   plus a suffix sum of the edge (`trie`).

The members that end at a node are digested in order: runs of ids are joined to strings
first, so that a task that digests a crowded end reads few rows, and keeps none.

Defined cases: rows without a conv_id belong to no conversation and are left out; turns are
ordered null first, rows of one turn by a digest of role and text, repeated rows count as
often as they stand; null and empty roles and texts are the same; an empty table has no
node, not even a root; other columns don't matter. One conversation's digests, 24 bytes a
turn, are held by one task; its texts aren't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import durable, table, text_of

#: Bytes of a digest, of a turn and of a node.
WIDE = 16
ROOT = bytes(WIDE)
#: Ids that are joined to one string before an end is digested.
RUN = 4096
#: Conversations of one block share the first turns of its first.
BLOCK, SHARED = 100, 6


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id and turns: an array of (turn, digest, chars) in order."""
    role, text = text_of("role"), text_of("text")
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 2 * WIDE)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).where("conv_id IS NOT NULL")
    return named.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def shared_starts(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """Conversations as if those of one block had been started from the same turns: the
    first h turns of conversation c - c % block, then c's own behind its first h, with
    h = crc32(c) % shared."""
    heads = turns.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, shared - 1).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    joined = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % block).join(heads, "head", "left")
    start = F.slice(F.coalesce("start", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(start, own).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chained digests, from the root's on, and code points of each turn."""
    for batch in batches:
        ends, paths = [], []
        for digests in batch.column(1).to_pylist():
            at, path = ROOT, [ROOT]
            for digest in digests:
                at = hashlib.blake2b(at + digest, digest_size=WIDE).digest()
                path.append(at)
            ends.append(at)
            paths.append(b"".join(path))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.binary()), pa.array(paths, pa.binary()), batch.column(2)], ["conv_id", "end", "path", "chars"])


def _common(a: bytes, b: bytes) -> int:
    """Depth of the last node that two paths share; -1 if there is none."""
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    first = int(differ.argmax()) if differ.any() else n
    return first // WIDE - 1


def _against_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The depth that each path shares with the one before it in its task."""
    last = b""
    for batch in batches:
        depths = []
        for path in batch.column(1).to_pylist():
            depths.append(_common(last, path))
            last = path
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depths, pa.int32())], ["end", "common"])


def _sorted(different: DataFrame) -> DataFrame:
    """different (end, path, ...), sorted, with `common`: the depth that a path shares with
    the one before it, over borders of tasks too. The very first shares none."""
    tasks = different.sparkSession.sparkContext.defaultParallelism
    ranges = max(tasks, int(different.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = durable(different.repartitionByRange(ranges, "path").sortWithinPartitions("path"))
    inner = placed.select("end", "path").mapInArrow(_against_last, "end binary, common int")
    # A row for each task: its first and last path; the border is between two of them.
    borders = durable(placed.groupBy(F.spark_partition_id().alias("task")).agg(F.min("path").alias("first"), F.max("path").alias("last")))
    pairs = borders.alias("x").join(borders.alias("y"), F.col("x.task") > F.col("y.task")).groupBy("x.task").agg(F.max("y.task").alias("before"))
    across = (
        pairs.join(borders.alias("a"), "task")
        .join(borders.alias("b"), F.col("before") == F.col("b.task"))
        .select(F.col("b.last").alias("left"), F.col("a.first").alias("right"))
        .mapInArrow(_border, "end binary, border int")
    )
    return placed.join(inner.join(F.broadcast(across), "end", "left").select("end", F.coalesce("border", "common").alias("common")), "end")


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [_common(a, b) for a, b in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[-WIDE:] for x in right], pa.binary()), pa.array(found, pa.int32())], ["end", "border"])


def _node(depth: Column) -> Column:
    """The digest of a path's node."""
    return F.substring(F.col("path"), depth * WIDE + 1, F.lit(WIDE))


_EDGE = "point binary, parent binary, depth int, rest array<long>, above array<binary>"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each point that a path owns: its parent, the suffix sums of its edge's code points
    from the node under the parent on, and the points above it."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for path, chars, common, depths in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            points = sorted(depths)
            digests = [path[d * WIDE : (d + 1) * WIDE] for d in points]
            length = np.array([0, *chars], np.int64)
            for k, depth in enumerate(points):
                if depth > common:
                    top = points[k - 1] + 1 if k else 0
                    row = (digests[k], digests[k - 1] if k else None, depth, np.cumsum(length[top : depth + 1][::-1])[::-1], digests[:k])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
        types = (pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["point", "parent", "depth", "rest", "above"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of one end as one string."""
    end, held = None, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["end", "first", "ids"])

    for batch in batches:
        rows = []
        for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (at != end or len(held) == RUN):
                rows.append((end, held[0], ",".join(map(str, held))))
                held = []
            end = at
            held.append(conv)
        yield out(rows)
    if held:
        yield out([(end, held[0], ",".join(map(str, held)))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each end's strings in order, joined by commas."""
    end, digest = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["end", "sha"])

    for batch in batches:
        rows = []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at == end and digest:
                digest.update(b",")
            else:
                if digest:
                    rows.append((end, digest.hexdigest()))
                end, digest = at, hashlib.sha256()
            digest.update(ids.encode())
        yield out(rows)
    if digest:
        yield out([(end, digest.hexdigest())])


def ends_digested(members: DataFrame) -> DataFrame:
    """end and sha, the digest of the ids that end there, from (end, conv_id)."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = members.repartitionByRange(tasks, "end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(_runs, "end binary, first long, ids string")
    return runs.repartition("end").sortWithinPartitions("end", "first").select("end", "ids").mapInArrow(_digests, "end binary, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of conversations (conv_id, turns as `turns_of` gives them):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    told = conversations.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))
    paths = durable(told.mapInArrow(_paths, "conv_id long, end binary, path binary, chars array<long>"))
    members = paths.select("end", "conv_id")
    different = paths.groupBy("end").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("chars").alias("chars"))
    placed = durable(_sorted(different))

    branches = placed.where("common > 0").select(_node(F.col("common")).alias("point")).distinct()
    points = branches.unionByName(placed.select(F.col("end").alias("point"))).distinct()
    nodes = placed.select("end", F.posexplode(F.expr(f"transform(sequence(1, greatest(length(path) div {WIDE} - 1, 1)), d -> substring(path, d * {WIDE} + 1, {WIDE}))")).alias("at", "point"))
    # The root is a point of every path; it isn't joined.
    passed = nodes.join(points, "point").groupBy("end").agg(F.collect_list(F.col("at") + 1).alias("depths"))
    full = placed.join(passed, "end", "left").withColumn("depths", F.concat(F.array(F.lit(0)), F.coalesce("depths", F.array().cast("array<int>"))))
    full = durable(full.select("path", "chars", "common", "depths", "n", "first"))

    edges = durable(full.select("path", "chars", "common", "depths").mapInArrow(_edges, _EDGE))
    # Members go up from the different conversations, not from all of them.
    counted = full.select(F.explode(F.transform("depths", _node)).alias("point"), "n", "first").groupBy("point").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"))
    children = edges.where("parent IS NOT NULL").groupBy(F.col("parent").alias("point")).agg(F.count("*").alias("children"))
    spine = durable(
        edges.select("point", "parent", "depth", F.element_at("rest", 1).alias("edge"), "above")
        .join(counted, "point")
        .join(children, "point", "left")
        .withColumn("children", F.coalesce("children", F.lit(0)))
    )
    # Costs of edges and leaves go up from the points.
    cost, leaf = (F.col("n_convs") - 1) * F.col("edge"), (F.col("children") == 0).cast("long")
    upward = F.concat(F.transform("above", lambda p: F.struct(p.alias("point"), cost.alias("cost"))), F.array(F.struct(F.col("point").alias("point"), F.lit(0).cast("long").alias("cost"))))
    below = spine.select(F.explode(upward).alias("up"), leaf.alias("leaf")).groupBy(F.col("up.point").alias("point")).agg(F.sum("up.cost").alias("below"), F.sum("leaf").alias("n_leaves"))
    above = spine.select(F.col("point").alias("parent"), F.col("conv_id").alias("above_conv"))

    point = (
        spine.drop("above", "edge")
        .join(below, "point")
        .join(above, "parent", "left")
        .join(edges.select("point", "rest"), "point")
        .join(ends_digested(members).withColumnRenamed("end", "point"), "point", "left")
    )
    inner = point.select("*", F.posexplode("rest").alias("nth", "tail"))
    last = F.col("nth") == F.size("rest") - 1
    return inner.select(
        "conv_id",
        (F.col("depth") - F.size("rest") + 1 + F.col("nth")).cast("long").alias("depth"),
        F.when(F.col("nth") == 0, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * F.col("tail")).alias("saved_tokens"),
        F.when(last & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(shared_starts(turns_of(table(spark, sf_dir, "conversations"))))
