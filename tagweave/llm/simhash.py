"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 values of word shingles. Equal
fingerprints collapse first. Two that differ in at most 3 bits agree on at least two
of five blocks of bits, so each is filed under the ten pairs of its blocks, and only
fingerprints with a common key are compared. That is exact: no link is lost.

Under a key the fingerprints are stored as bit planes, plane b holding bit b of all of
them, 64 to a machine word. A comparison XORs planes and adds the differences into
carry-save counters (a plane of ones, one of twos, ...), which updates 64 distances
with a handful of word operations, and stops once every distance is beyond the radius.
Only links of a spanning forest leave a block. A key with more than `CHUNK`
fingerprints is split: its rows are dealt into chunks, and every pair of chunks is a
block of its own, so a hot key takes many tasks and no block grows with the data.

Defined cases: a null or blank text has fingerprint zero and is linked like any other;
a null id counts as larger than any id; rows that repeat share a component; an empty
table gives no rows; other columns are ignored. Very long texts are read whole, in steps
of `STEP` shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm.common import durable, keep_rows, one_row_each, row_key, table
from tagweave.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Bits per block; two equal blocks are a key.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints under one key that are compared in one block.
CHUNK = 16_384
#: Keys with up to so many fingerprints are compared together, pair by pair.
SMALL = 8
#: Shingles that are held at once while a text is read.
STEP = 65_536

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits."""
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(lanes[:, lane], minlength=256) @ _BYTE_BITS for lane in range(8)])


def _majority(ones: np.ndarray, total: int) -> int:
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashed shingles."""
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), STEP):
        ones += _ones(hashes[begin : begin + STEP])
    return _majority(ones, len(hashes))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower changes A-Z alone
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        total = len(tokens) - words + 1
    ones = np.zeros(64, np.int64)
    for begin in range(0, total, STEP):
        count = min(STEP, total - begin)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(shingles), seed) for _ in range(count)), np.uint64, count)
        ones += _ones(hashes)
    return _majority(ones, total)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row (what tells the row from others, by `row_key`) and fp, the fingerprint
    as a signed 64-bit number."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])

    named = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(F.col(key), F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    return spread(named).mapInArrow(read, "doc_id long, row string, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit i of plane b is bit b of value i."""
    lanes = values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(lanes, axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    padded = np.zeros((64, -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


def places(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def within(differences: Iterator[np.ndarray], beyond: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Mask of the positions at most `radius` apart; `beyond` marks those out from the
    start. Carry-save counters hold each position's count, bit by bit."""
    counters = [np.zeros_like(beyond) for _ in range(radius.bit_length())]
    beyond = beyond.copy()
    for step, carry in enumerate(differences):
        for counter in counters:
            held = counter & carry
            counter ^= carry
            carry = held
        beyond |= carry  # ran over the highest counter
        if step % 8 == 7 and not (~beyond).any():
            break
    above, equal = np.zeros_like(beyond), ~np.zeros_like(beyond)
    for bit in reversed(range(len(counters))):
        if not radius >> bit & 1:
            above |= equal & counters[bit]
            equal &= ~counters[bit]
        else:
            equal &= counters[bit]
    return ~(beyond | above)


def link_block(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of one block. What is reached leaves the planes'
    live mask, so a tight group is done after a few comparisons."""
    n = len(values)
    planes = bit_planes(values)
    sides = np.stack([planes, ~planes])
    live = np.zeros(planes.shape[1] * 64, np.uint8)
    live[:n] = 1
    live = np.packbits(live, bitorder="little").view("<u8").copy()
    links, pending = [], []
    numbers = values.tolist()
    alive = np.ones(n, bool)
    for root in range(n):
        if not alive[root]:
            continue
        pending.append(root)
        alive[root] = False
        live[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        while pending:
            at = pending.pop()
            value = numbers[at]
            near = places(within((sides[value >> b & 1, b] for b in range(64)), ~live, radius), n)
            if len(near):
                alive[near] = False
                live &= ~_mask(near, len(live))
                links.extend((at, i) for i in near.tolist())
                pending.extend(near.tolist())
    return links


def _mask(where: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[where] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def link_runs(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys. Short runs are compared all at once: value i
    of every run with the one d places on, as bit planes of their XOR."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edge)
    a, b = [], []
    room = np.repeat(np.where(size <= SMALL, edge[1:], 0), size)
    for d in range(1, SMALL):
        first = np.flatnonzero(np.arange(len(keys)) + d < room)
        for begin in range(0, len(first), STEP):
            part = first[begin : begin + STEP]
            planes = bit_planes(values[part] ^ values[part + d])
            near = places(within(iter(planes), np.zeros(planes.shape[1], "<u8"), radius), len(part))
            a.append(values[part[near]])
            b.append(values[part[near] + d])
    for k in np.flatnonzero(size > SMALL):
        block = np.unique(values[edge[k] : edge[k + 1]])
        found = np.array(link_block(block, radius), np.int64).reshape(-1, 2)
        a.append(block[found[:, 0]])
        b.append(block[found[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs come sorted by block; the last run of a batch waits for the next batch."""
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        values = np.concatenate((values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) and (keys[1:] >= keys[:-1]).all() else 0
        if done:
            yield out(*link_runs(keys[:done], values[:done]))
            keys, values = keys[done:], values[done:]
    if len(keys):
        yield out(*link_runs(keys, values))


def links(prints: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints fp."""
    if radius > len(blocks) - 2:
        raise ValueError("two blocks must stay equal: use more blocks")
    starts = [sum(blocks[:i]) for i in range(len(blocks))]

    def block(i: int):  # noqa: ANN202
        return F.shiftrightunsigned("fp", starts[i]).bitwiseAND(F.lit((1 << blocks[i]) - 1))

    filed = prints.select(
        "fp",
        F.explode(
            F.array(*(
                F.lit(k << 32) + F.shiftleft(block(i), 16) + block(j)
                for k, (i, j) in enumerate(combinations(range(len(blocks)), 2))
            ))
        ).alias("key"),
    )
    shared = filed.groupBy("key").count().where("count > 1")
    chunks = F.ceil(F.col("count") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        filed.join(shared, "key")
        .withColumn("chunks", chunks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", F.when(F.col("chunks") == 1, F.col("key")).otherwise(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("block"))
    )
    return dealt.repartition("block").sortWithinPartitions("block").select("block", "fp").mapInArrow(_link, "a long, b long")


def _members(docs: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """doc_id, row, fp, root (the component's smallest fingerprint) and component_id for every row."""
    prints = durable(fingerprints(docs, text, key, words))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id for every row; the smallest id names a component."""
    return _members(docs, text, key, words).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component, columns unchanged: the one with the smallest id, rows
    without an id after all others; rows are known by id and text, so others that repeat
    the id are judged by their own text, and of rows equal in both one stays."""
    members = _members(docs, text, key, words).select(F.col("root").alias("grp"), "row", "doc_id")
    return keep_rows(docs, durable(one_row_each(members)), key, text)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
