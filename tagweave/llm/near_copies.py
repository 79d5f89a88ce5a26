"""Near copies by SimHash, and by an exact similarity join for what its bits can't find.

A text is the set of its five-word shingles; two texts are near copies if the Jaccard
similarity of their sets is `ALIKE` or more. Equal sets collapse first. Each set has a
SimHash fingerprint, and fingerprints that differ in at most three bits are found by
op2's comparison of bit planes (`simhash.links`); their sets are made again and intersected,
so bits alone link nothing. What that links is one component.

Three bits find only the closest of copies: two sets that are 0.8 alike differ in about
ten of 64. So sets of different components are then joined exactly. In an order of
all shingles, the sets of two near copies have one of their first n - ceil(0.8 n) + 1
shingles in common, n each set's size (prefix filtering; Chaudhuri et al., 2006), so
sets are filed under those shingles and only sets filed together are candidates. Any
order loses nothing: shingles that are frequent in a bounded sample come last, all
others first, by hash, which keeps hot shingles out of prefixes.

A shingle's sets are compared with the smallest of them first, unless SimHash has
connected the two. What that links is one component; then only sets of different components are compared, so a large group of
near copies costs about as many comparisons as it has members. Candidates pass two
tests that no near copy fails, on sizes and on parity bits (each bit that differs is a
shingle that only one set has; 256, for large sets 4,096 more), before the sets
themselves are made again from the candidates' texts and intersected.

Defined cases: a text of fewer than five words is one shingle; null and blank texts
have none and are equal; a null id counts as larger than any id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm import simhash
from tagweave.llm.common import Bloom, durable, join_small, keep_rows, one_row_each, row_key
from tagweave.llm.components import connected_components

SHINGLE_WORDS = 5
#: Least similarity, as a fraction (four fifths).
ALIKE = (4, 5)
SEED = 42
#: Texts that are read to find frequent shingles; shingles of so many of them are frequent, this many at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 5_000, 3, 50_000

#: Most digests, of 8 bytes, that are broadcast to find the candidates' texts.
ASKED = 500_000
#: Texts whose sets are held at once.
STEP = 64
#: Sets of more shingles than this have `WIDE` more parity bits.
LARGE, WIDE = 400, 4096

_BITS = [f"b{i}" for i in range(4)]


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower changes A-Z alone
    if not tokens:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    mixed = np.full(len(tokens) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashed[k : len(hashed) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _sample(docs: DataFrame) -> list[int]:
    """Frequent shingles of a bounded sample of the texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                found = [shingles(t.as_py()) for t in batch.column(0).slice(begin, STEP)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    place = F.pmod(F.xxhash64(F.lit(11), "text", "doc_id"), F.lit(1 << 40))
    some = docs.where(place < int((1 << 40) * min(1.0, SAMPLE / max(1, docs.count())))).select("text")
    often = some.mapInArrow(read, "key long").groupBy("key").count().where(F.col("count") >= FREQUENT)
    return [r.key for r in often.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).collect()]


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, row (its key), digest of the text, node (the set's hash), n, fp (its fingerprint), parity bits, and the shingles that a set is filed under."""
    p, q = ALIKE
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(_sample(docs), np.int64).view(np.uint64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                found = [shingles(t.as_py()) for t in part.column(3)]
                node = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found]
                lanes = np.stack([_parity(x, 256) for x in found])
                late = [np.isin(x, frequent, assume_unique=True) for x in found]
                sizes = [len(x) for x in found]
                filed = [np.concatenate((x[~y], x[y]))[: n - -(-p * n // q) + 1 if n else 0] for x, y, n in zip(found, late, sizes, strict=True)]
                wide = [_parity(x, WIDE) if len(x) > LARGE else np.zeros(0, np.int64) for x in found]
                columns = [part.column(0), part.column(1), part.column(2), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
                columns.append(pa.array(np.array([simhash.set_fingerprint(x) for x in found], np.uint64).view(np.int64)))
                columns += [*(pa.array(lanes[:, i].copy()) for i in range(4)), _lists(wide), _lists([x.view(np.int64) for x in filed])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "node", "n", "fp", *_BITS, "wide", "filed"])

    named = spread(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.xxhash64("text").alias("digest"), "text")
    return named.mapInArrow(read, f"doc_id long, row string, digest long, node long, n long, fp long, {', '.join(f'{b} long' for b in _BITS)}, wide array<long>, filed array<long>")


def _parity(x: np.ndarray, bits: int) -> np.ndarray:
    counts = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))


def _may_be_alike(a: str, b: str) -> Column:
    """Tests that all near copies pass."""
    p, q = ALIKE
    differ = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in _BITS[1:]), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = (q - p) * (n + m)
    rest = F.aggregate(F.zip_with(f"{a}.wide", f"{b}.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    large = F.least(n, m) > LARGE
    return (p * F.greatest(n, m) <= q * F.least(n, m)) & ((p + q) * differ <= most) & F.when(large, (p + q) * rest <= most).otherwise(F.lit(True))


def _made(docs: DataFrame) -> DataFrame:
    """node, n and shingles of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                found = [shingles(t.as_py()) for t in batch.column(0).slice(begin, STEP)]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([*map(len, found)], pa.int64()), _lists([x.view(np.int64) for x in found])], ["node", "n", "shingles"])

    return docs.select("text").mapInArrow(read, "node long, n long, shingles array<long>")


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of different pairs (a, b) whose sets are alike."""
    p, q = ALIKE
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    rows = durable(nodes.join(asked, "node").select("digest"))
    texts = join_small(docs.select("text", F.xxhash64("text").alias("digest")), rows, ["digest"], rows=ASKED).dropDuplicates(["digest"])
    sets = durable(_made(texts))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("other")), "b").join(
        sets.withColumnRenamed("node", "a"), "a"
    )
    common = F.size(F.array_intersect("shingles", "other"))
    return durable(both.where((p + q) * common >= p * (F.col("n") + F.col("m"))).select("a", "b"))


def _passing(prints: DataFrame, wanted: Bloom) -> DataFrame:
    """node and key, for the shingles that sets are filed under and the filter lets through."""
    held = prints.sparkSession.sparkContext.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            passed = held.value.among(keys)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[passed]), pa.array(keys[passed])], ["node", "key"])

    return prints.select("node", "filed").mapInArrow(read, "node long, key long")


def _by_fingerprint(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links of different sets whose fingerprints are at most three bits apart and
    whose similarity is verified. Sets of one fingerprint are compared with the smallest."""
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    near = simhash.links(prints.select("fp"))
    ends = near.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = nodes.join(prints, "fp").where("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    pairs = durable(ends.select("x", "y").union(same).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    attributes = nodes.select("node", "n", "wide", *_BITS)
    tested = pairs.join(attributes.alias("x"), F.col("a") == F.col("x.node")).join(attributes.alias("y"), F.col("b") == F.col("y.node"))
    return _alike(durable(tested.where(_may_be_alike("x", "y")).select("a", "b")), docs, nodes)


def _links(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links of different sets that span all components of near copies."""
    closest = _by_fingerprint(docs, nodes)
    known = connected_components(closest).withColumnRenamed("node", "member")
    filed = prints.select("node", F.explode("filed").alias("key"))
    least = durable(filed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").drop("most"))
    # Few shingles are shared: a filter of fixed size leaves little to be shuffled again.
    shared = durable(_passing(prints, Bloom(least, "key")).join(least, "key").where("node <> least").distinct())
    attributes = nodes.select("node", "n", "wide", *_BITS)
    pairs = shared.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    ofs = [known.select(F.col("member").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
    apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    pairs = pairs.join(ofs[0], "a", "left").join(ofs[1], "b", "left").where(apart).select("a", "b")
    tested = pairs.join(attributes.alias("x"), F.col("a") == F.col("x.node")).join(attributes.alias("y"), F.col("b") == F.col("y.node"))
    stars = closest.unionByName(_alike(durable(tested.where(_may_be_alike("x", "y")).select("a", "b")), docs, nodes))

    roots = connected_components(stars).withColumnRenamed("node", "member")
    placed = shared.join(roots, F.col("node") == F.col("member"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = durable(placed.join(mixed, "key").join(attributes, "node"))
    across = rest.alias("x").join(rest.alias("y"), F.col("x.key") == F.col("y.key"))
    across = across.where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may_be_alike("x", "y"))
    others = durable(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    return stars.unionByName(_alike(others, docs, nodes))


def _members(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, row, root (a set of the component) and component_id for every row."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = durable(_sets(named))
    nodes = durable(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("digest").alias("digest"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.first("wide").alias("wide"), *(F.max(b).alias(b) for b in _BITS)))
    roots = connected_components(_links(named, prints, nodes)).withColumnRenamed("node", "member")
    rooted = nodes.join(roots, F.col("node") == F.col("member"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "row", "node").join(rooted.join(smallest, "root").select("node", "root", "component_id"), "node")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and component_id for every row; the smallest id names a component."""
    return _members(docs, text, key).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, columns unchanged: the one with the smallest id, rows
    without an id after all others; rows are known by id and text, so others that repeat
    the id are judged by their own text, and of rows equal in both one stays."""
    members = _members(docs, text, key).select(F.col("root").alias("grp"), "row", "doc_id")
    return keep_rows(docs, durable(one_row_each(members)), key, text)
