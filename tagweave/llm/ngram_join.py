"""Jaccard join of shingle sets by groups of equal prefixes.

Shingles stand in one order for all sets. Two sets that are alike share one of their first
n - ceil(t n) + 1 shingles, n each set's size and t the similarity (prefix filtering); any
order loses nothing, and one with rare shingles first leaves little to compare. A quarter
of all shingles, chosen by hash, is counted over all texts; those of it that one row alone
has come first and are no keys at all, since nothing can meet there. Shingles that are
frequent in a bounded sample come last, all others by hash between. Equal sets collapse
first. Sets of equal prefix and size then form one group (Bouros, Ge and Mamoulis,
"Spatio-textual similarity joins", 2012), and groups, not sets, are filed under the
prefix's shingles. A pair of groups is let through only if

* their sizes may be alike,
* their prefixes leave enough in common: what they share, and what can still follow, and
* no more bits differ than may: each group keeps the parity bits that all its members
  set and those that any sets; a bit that all of one set and none of the other is a
  shingle that only one side has.

Members of the pairs that are left are tested one by one by the same bits, and their sets
are made again from their texts and intersected.

Only connections are wanted, so pairs that are already connected needn't be compared. In
rounds, groups are compared with a few of each shingle's sets, its pivots; what is linked
becomes one component. A shingle whose groups are in several components then compares the
smaller of them with all, never the largest with itself: a large family of near copies costs
few comparisons a member, and no link between different components is lost.

Defined cases: a text of fewer words than a shingle has is one shingle; null and blank texts
have none, an empty set, and are linked with nothing, their component is their own id; a
null id counts as larger than any id; rows that repeat an id are judged one by one by
their own texts; tables may be empty; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm.common import Bloom, durable, join_small, packed, stored, table
from tagweave.llm.components import connected_components
from tagweave.llm.near_copies import shingles

WORDS = 3
#: Least similarity in hundredths.
ALIKE = 90
SEED = 42
#: Texts that are read to find frequent shingles; those of so many of them are frequent, this many at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 5_000, 3, 50_000
#: Shingles below this are counted: a quarter of all 64-bit hashes.
COUNTED = 1 << 62
#: Pivots of a shingle in each round, and most rounds.
PIVOTS, ROUNDS = 4, 2
#: A round is worth it while a shingle has so many groups outside its largest component.
CROWDED = 64
#: Most digests, of 8 bytes, that are broadcast to find the candidates' texts.
ASKED = 500_000
#: Texts whose sets are held at once.
STEP = 64

_LANES = range(8)
_SET = ["node", "n", *(f"b{i}" for i in _LANES)]
_GROUP = ["grp", "n", *(f"all{i}" for i in _LANES), *(f"any{i}" for i in _LANES)]


def _id(values: np.ndarray, *more: int) -> int:
    return xxhash.xxh64_intdigest(values.tobytes() + repr(more).encode(), SEED)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat))


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def prefix_length(n: int, alike: int = ALIKE) -> int:
    """Shingles of a set under which it is filed."""
    return n - -(-alike * n // 100) + 1 if n else 0


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that are frequent in a bounded sample of the texts; an order, not a filter."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                found = [shingles(t.as_py(), words) for t in batch.column(0).slice(begin, STEP)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    place = F.pmod(F.xxhash64(F.lit(17), "text", "doc_id"), F.lit(1 << 40))
    some = docs.where(place < int((1 << 40) * min(1.0, SAMPLE / max(1, docs.count())))).select("text")
    often = some.mapInArrow(read, "key long").groupBy("key").count().where(F.col("count") >= FREQUENT)
    return np.sort(np.array([r.key for r in often.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64))


def _repeated(docs: DataFrame, words: int) -> Bloom:
    """Which counted shingles may occur in more rows than one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                found = [_counted(shingles(t.as_py(), words)) for t in batch.column(0).slice(begin, STEP)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    keys = spread(docs).select("text").mapInArrow(read, "key long")
    return Bloom(durable(keys.groupBy("key").count().where("count > 1").select("key")), "key", 4)


def _counted(x: np.ndarray) -> np.ndarray:
    """Those of sorted shingles that are counted."""
    return x[: int(np.searchsorted(x, np.uint64(COUNTED)))]


def filed_under(x: np.ndarray, repeated: Bloom, frequent: np.ndarray, alike: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a sorted set, and those of its shingles that others may share."""
    alone = np.zeros(len(x), bool)
    few = _counted(x)
    alone[: len(few)] = ~repeated.among(few.view(np.int64))
    late = ~alone & _among(x, frequent)
    prefix = np.concatenate((x[alone], x[~alone & ~late], x[late]))[: prefix_length(len(x), alike)]
    return prefix, prefix[int(np.count_nonzero(alone)) :]


def _sets(docs: DataFrame, words: int, alike: int) -> DataFrame:
    """doc_id, digest of the text, node (the set's hash), n, parity bits, grp and the prefix's keys."""
    context = docs.sparkSession.sparkContext
    frequent, repeated = context.broadcast(_frequent(docs, words)), context.broadcast(_repeated(docs, words))
    lanes = 64 * len(_LANES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                found = [shingles(t.as_py(), words) for t in part.column(2)]
                bits = np.stack([np.packbits(np.bincount((x & np.uint64(lanes - 1)).astype(np.int64), minlength=lanes) & 1).view(np.int64) for x in found])
                prefixes = [filed_under(x, repeated.value, frequent.value, alike) for x in found]
                nodes, groups = _longs([_id(x) for x in found]), _longs([_id(p, len(x)) for x, (p, _) in zip(found, prefixes, strict=True)])
                columns = [part.column(0), part.column(1), nodes, pa.array([len(x) for x in found], pa.int64()), *(pa.array(bits[:, i].copy()) for i in _LANES), groups, _lists([k for _, k in prefixes])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", *_SET, "grp", "keys"])

    named = spread(docs).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return named.mapInArrow(read, f"doc_id long, digest long, {', '.join(f'{c} long' for c in _SET)}, grp long, keys array<long>")


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return total


def _sizes_fit(n: Column, m: Column, differ: Column, alike: int) -> Column:
    """Whether sets of n and m shingles, of which at least so many differ, may be alike."""
    return (alike * F.greatest(n, m) <= 100 * F.least(n, m)) & ((100 + alike) * differ <= (100 - alike) * (n + m))


def sets_may_be_alike(a: str, b: str, alike: int = ALIKE) -> Column:
    """A test that all alike sets pass."""
    differ = _sum([F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in _LANES])
    return _sizes_fit(F.col(f"{a}.n"), F.col(f"{b}.n"), differ, alike)


def groups_may_be_alike(a: str, b: str, alike: int = ALIKE) -> Column:
    """A test that all pairs of groups with alike members pass, on sizes and bits."""

    def only(x: str, y: str) -> Column:
        """Bits that all members of x set and no member of y."""
        return _sum([F.bit_count(F.col(f"{x}.all{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.any{i}")))) for i in _LANES])

    return _sizes_fit(F.col(f"{a}.n"), F.col(f"{b}.n"), only(a, b) + only(b, a), alike)


def prefixes_may_be_alike(a: str, b: str, alike: int = ALIKE) -> Column:
    """Another one, on prefixes. Of two prefixes, one ends no later in the common order: of
    its set, only what is behind it can still be shared. Whichever that is, no more than
    the larger rest is."""
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.keys"), F.col(f"{b}.keys")
    behind = F.greatest(*(F.floor((alike * x + 99) / 100) - 1 for x in (n, m)))  # the set without its prefix
    most = F.size(F.array_intersect(p, q)) + behind
    return (100 + alike) * most >= alike * (n + m)


def _made(docs: DataFrame, words: int) -> DataFrame:
    """node, n and shingles of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                found = [shingles(t.as_py(), words) for t in batch.column(0).slice(begin, STEP)]
                yield pa.RecordBatch.from_arrays([_longs([_id(x) for x in found]), pa.array([*map(len, found)], pa.int64()), _lists(found)], ["node", "n", "shingles"])

    return docs.select("text").mapInArrow(read, "node long, n long, shingles array<long>")


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, alike: int) -> DataFrame:
    """Those of different pairs (a, b) of sets that are alike."""
    n = pairs.count()
    pairs = packed(pairs, n)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    digests = durable(join_small(nodes, asked, ["node"], rows=ASKED).select("digest"))
    texts = join_small(docs.select("text", F.xxhash64("text").alias("digest")), packed(digests, 2 * n), ["digest"], rows=ASKED).dropDuplicates(["digest"])
    sets = durable(_made(texts, words))
    other = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("other"))
    both = pairs.join(other, "b").join(sets.withColumnRenamed("node", "a"), "a")
    common = F.size(F.array_intersect("shingles", "other"))
    alike_pairs = both.where((100 + alike) * common >= alike * (F.col("n") + F.col("m"))).select("a", "b")
    return packed(durable(alike_pairs), n)


def _filed(groups: DataFrame) -> DataFrame:
    """key and grp, for shingles that two groups or more are filed under."""
    all_keys = groups.select("grp", F.explode("keys").alias("key"))
    shared = durable(all_keys.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("key"))
    held = groups.sparkSession.sparkContext.broadcast(Bloom(shared, "key", 4))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            owners = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            passed = held.value.among(keys)
            yield pa.RecordBatch.from_arrays([pa.array(owners[passed]), pa.array(keys[passed])], ["grp", "key"])

    few = groups.select("grp", "keys").mapInArrow(read, "grp long, key long")
    return durable(few.join(shared, "key"))


class _Join:
    """The tables that the rounds share."""

    def __init__(self, docs: DataFrame, words: int, alike: int):
        self.docs, self.words, self.alike = docs, words, alike
        self.prints = durable(_sets(docs, words, alike))
        some = self.prints.where("n > 0")
        same = [F.max(f"b{i}").alias(f"b{i}") for i in _LANES]  # equal in all rows of a set
        self.nodes = durable(some.groupBy("node").agg(F.min("digest").alias("digest"), F.max("n").alias("n"), F.max("grp").alias("grp"), *same))
        bits = [f(f"b{i}").alias(f"{name}{i}") for name, f in (("all", F.bit_and), ("any", F.bit_or)) for i in _LANES]
        # Straight from the rows: a set that repeats changes no bit of its group.
        self.groups = durable(some.groupBy("grp").agg(F.max("n").alias("n"), F.first("keys").alias("keys"), F.min("node").alias("rep"), F.max("node").alias("last"), *bits))
        self.prints = durable(self.prints.select("doc_id", "node", "n"))  # the wide one can be cleaned
        self.links = stored(self._inside())
        self.filed = _filed(self.groups)

    def verified(self, pairs: DataFrame) -> DataFrame:
        return _alike(durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), self.docs, self.nodes, self.words, self.alike)

    def add(self, pairs: DataFrame) -> None:
        """Verify pairs and keep the links among them."""
        self.links = stored(self.links.unionByName(self.verified(pairs)))

    def _inside(self) -> DataFrame:
        """Links of each group's members with the first of them."""
        firsts = self.groups.where("rep <> last").select("grp", F.col("rep").alias("node")).join(self.nodes.drop("grp"), "node")
        x, y = self.nodes.alias("x"), firsts.alias("y")
        met = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.node") != F.col("y.node")) & sets_may_be_alike("x", "y", self.alike))
        return self.verified(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))

    def roots(self) -> DataFrame:
        """node, grp and root of every set."""
        found = connected_components(self.links).withColumnRenamed("node", "member")
        return durable(self.nodes.join(found, F.col("node") == F.col("member"), "left").select("node", "grp", F.coalesce("root", "node").alias("root")))

    def parted(self, roots: DataFrame) -> DataFrame:
        """key, grp, low and high (components of the group's members) and main, the largest
        component of the key, for keys whose groups aren't all of one component."""
        each = roots.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        placed = self.filed.join(each, "grp")
        # A group that is torn belongs to no component, so it is compared itself.
        whole = placed.where("low = high")
        counted = whole.groupBy("key", "low").count().groupBy("key").agg(F.max_by("low", F.struct("count", "low")).alias("main"))
        several = placed.groupBy("key").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("key")
        return durable(placed.join(several, "key").join(counted, "key", "left"))

    def expanded(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Sets (a, b) that may be alike, of different components, from pairs of groups (g, h)."""
        members = self.nodes.join(roots.select("node", "root"), "node")
        met = pairs.join(members.alias("x"), F.col("g") == F.col("x.grp")).join(
            members.alias("y"), (F.col("h") == F.col("y.grp")) & (F.col("x.root") != F.col("y.root")) & sets_may_be_alike("x", "y", self.alike)
        )
        return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def by_prefix(self, pairs: DataFrame) -> DataFrame:
        """Those of different pairs of groups (g, h) that their prefixes let through."""
        slim = self.groups.select("grp", "n", "keys")
        both = pairs.join(slim.alias("x"), F.col("g") == F.col("x.grp")).join(slim.alias("y"), F.col("h") == F.col("y.grp"))
        return durable(both.where(prefixes_may_be_alike("x", "y", self.alike)).select("g", "h"))

    def with_pivots(self, turn: int, roots: DataFrame, parted: DataFrame) -> DataFrame:
        """Sets compared with the pivots of their shingles."""
        place = F.xxhash64(F.lit(turn), "grp")
        # One pivot for each remainder; in later rounds those of the largest component.
        of = parted if turn == 0 else parted.where("low = main AND high = main")
        pivots = of.groupBy("key", F.pmod(place, F.lit(PIVOTS)).alias("r")).agg(F.min_by("grp", place).alias("pivot"))
        asked = parted if turn == 0 else parted.where("main IS NULL OR low <> main OR high <> main")
        reps = self.groups.select(F.col("grp").alias("pivot"), F.col("rep").alias("node"))
        firsts = reps.join(self.nodes.drop("grp"), "node").join(roots.select("node", "root"), "node")
        slim = self.groups.select(*_GROUP)
        # The test on groups is part of the join, so a shingle's groups never come out in pairs.
        x, y = asked.select("key", "grp").join(slim, "grp").alias("x"), pivots.select("key", F.col("pivot").alias("grp")).join(slim, "grp").alias("y")
        near = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.grp") != F.col("y.grp")) & groups_may_be_alike("x", "y", self.alike))
        near = self.by_prefix(near.select(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).distinct())
        members = self.nodes.join(roots.select("node", "root"), "node")
        met = near.join(members.alias("x"), F.col("g") == F.col("x.grp")).join(
            firsts.alias("y"), (F.col("h") == F.col("y.pivot")) & (F.col("x.root") != F.col("y.root")) & sets_may_be_alike("x", "y", self.alike)
        )
        return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def rest(self, roots: DataFrame, parted: DataFrame) -> DataFrame:
        """Sets of different components that may be alike, each shingle's largest component
        only against the others."""
        slim = self.groups.select(*_GROUP)
        rows = parted.join(slim, "grp")
        few = rows.where("main IS NULL OR low <> main OR high <> main")
        outside = F.col("y.main").isNull() | (F.col("y.low") != F.col("y.main")) | (F.col("y.high") != F.col("y.main"))
        once = ~outside | (F.col("x.grp") <= F.col("y.grp"))
        apart = (F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high"))
        pairs = few.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & once & apart & groups_may_be_alike("x", "y", self.alike))
        pairs = self.by_prefix(pairs.select(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).distinct())
        # Members of a torn group with each other, also where no other group shares its prefix.
        torn = roots.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
        return self.expanded(pairs.union(torn).distinct(), roots)


def linked_sets(docs: DataFrame, words: int = WORDS, alike: int = ALIKE) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): doc_id, node and n of every row, and node, root of every set
    that isn't the smallest of its component."""
    join = _Join(docs, words, alike)
    for turn in range(ROUNDS):
        roots = join.roots()
        parted = join.parted(roots)
        if parted.isEmpty():
            break
        if turn:
            outside = parted.where("main IS NOT NULL AND (low <> main OR high <> main)").groupBy("key").count()
            if outside.where(F.col("count") > CROWDED).isEmpty():
                break
        join.add(join.with_pivots(turn, roots, parted))
    roots = join.roots()
    join.add(join.rest(roots, join.parted(roots)))
    return join.prints.select("doc_id", "node", "n"), connected_components(join.links)


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, alike: int = ALIKE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) for every row."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints, found = linked_sets(named, words, alike)
    rooted = prints.join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = rooted.join(smallest, "root", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = {
    "op13_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS g
            FROM w),
        c AS (SELECT g, min(doc_id) AS node FROM s WHERE len(g) > 0 GROUP BY g),
        x AS (SELECT node, len(g) AS n, unnest(g) AS t FROM c),
        pairs AS (
            SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.t = b.t AND a.node < b.node AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
            GROUP BY a.node, b.node, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)),
        edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT node, node AS r FROM c UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.node),
        comp AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id
        FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN comp ON comp.node = c.node
    """
}
