"""Packing by Karmarkar-Karp multiway differencing.

A document's token ids, with an end id, are cut into full windows and a rest. Full
windows need no packing. The rests of a bounded group of documents are split over k
windows by largest differencing: each rest starts as a partial partition of k parts;
the two partitions with the largest spread merge, the heaviest part of one with the
lightest of the other, until one partition is left. k starts at the least number of
windows that could hold the group; while a window exceeds the capacity, k rises.

Groups are dealt by a hash of id and text, their number follows from the counted
tokens, so a group holds `GROUP_TOKENS` of rests on average at any size of the corpus,
and one hot id, source or text can't fill a group beyond that: rows that are equal in
id and text are dealt by a running number of the scan.

Tokens come from a byte-level BPE vocabulary.

Defined cases: a null or empty text is the end id alone; very long texts, and very long
runs of one kind of character, are encoded whole and cut into as many windows as they need; repeated rows are packed each; an empty table packs
into nothing. Every `FILLER_EVERY`th document's rest is cut into pieces of
`FILLER_TOKENS`, wherever it falls in the corpus: rests of a few to a window don't
balance well by themselves, and these small pieces even the windows out.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm.common import durable, table

CAPACITY = 2048
END_ID = 1
#: Tokens of rests that are packed together; more give windows nearer to full.
GROUP_TOKENS = 600_000
#: Groups that a task packs, on average.
GROUPS_A_TASK = 8
#: One rest of so many is cut into pieces of so many tokens (measured at sf0.1: 2.5 % of all places are padding without, 0.8 % with).
FILLER_EVERY, FILLER_TOKENS = 16, 64

#: The byte-level vocabulary's own pre-token pattern (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others,
    in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, those of `tokenizers` for the
    given tokenizer file's text with add_special_tokens=False. With `added`, strings of the
    vocabulary's added tokens are one id each, as there; without, they are ordinary text.

    tiktoken computes them from the same vocabulary, three times as fast. Its pattern
    can't match very long runs of white space; such texts go through `tokenizers` itself."""

    def __init__(self, file: str, added: bool = True):
        import tiktoken

        parsed = json.loads(file)
        tokens = {x["content"]: x["id"] for x in parsed.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in tokens}
        self.file, self.added, self.slow = file, added, None
        self.allowed = set(tokens) if added else set()
        self.fast = tiktoken.Encoding("ids", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=tokens if added else {})

    def __call__(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.file)
                self.slow.encode_special_tokens = not self.added
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(file: str, added: bool) -> Encoder:
    """One per Python worker, vocabulary and kind."""
    if (file, added) not in _ENCODERS:
        _ENCODERS[file, added] = Encoder(file, added)
    return _ENCODERS[file, added]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False, added: bool = True) -> DataFrame:
    """Full windows and rests of every document, with the checksum of their ids and,
    if asked for, the ids (little-endian unsigned 32-bit). `added` as in `Encoder`."""
    # The vocabulary is a file of fixed size, a few MB; executors need no path to it.
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_text(encoding="utf-8"))
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, added)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text, deal in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                full = n - n % capacity
                step = FILLER_TOKENS if deal.as_py() % FILLER_EVERY == 0 else capacity
                for start in [*range(0, full, capacity), *range(full, n, step)]:
                    piece = ids[4 * start : 4 * min(n, start + (step if start >= full else capacity))]
                    rows.append((doc_id.as_py(), start, len(piece) // 4, zlib.crc32(piece), n, deal.as_py(), *((piece,) if with_ids else ())))
                held += len(ids) * with_ids
                if held > 16 << 20:
                    yield _batch(rows, with_ids)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, with_ids)

    named = spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).select(
        "doc_id",
        "text",
        F.xxhash64(F.lit(3), "doc_id", "text", F.monotonically_increasing_id()).alias("deal"),
    )
    return named.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"]
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
    if with_ids:
        arrays.append(pa.array(columns[6], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k - 1) of each item by Karmarkar-Karp differencing.

    A partial partition is a sorted array of part sums and a tree for each part:
    tree t >= n joins trees joined[t - n]; trees below n are items; -1 is empty.
    """
    n = len(sizes)
    joined: list[tuple[int, int]] = []
    heap: list[tuple[int, int, int]] = []
    partitions: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # A partition of one item has one part that isn't empty; only those parts are stored.
    for i in np.argsort(-sizes, kind="stable").tolist():
        partitions[i] = (np.array([sizes[i]], np.int64), np.array([i], np.int64))
        heap.append((-int(sizes[i]), i, i))
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, ta), (sb, tb) = partitions.pop(a), partitions.pop(b)  # parts from heavy to light
        spare = k - len(sa)
        # b's lightest parts go to a's heaviest: b's empty parts first.
        if len(sb) <= spare:
            sums, trees = np.concatenate((sa, sb)), np.concatenate((ta, tb))
        else:
            over = len(sb) - spare  # b's heaviest `spare` parts meet a's empty ones
            sums, trees = sa.copy(), ta.copy()
            last = np.arange(len(sa) - 1, len(sa) - 1 - over, -1)
            meet = np.arange(spare, len(sb))
            for i, j in zip(last.tolist(), meet.tolist(), strict=True):
                joined.append((int(trees[i]), int(tb[j])))
                trees[i] = n + len(joined) - 1
            sums[last] += sb[meet]
            sums, trees = np.concatenate((sums, sb[:spare])), np.concatenate((trees, tb[:spare]))
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        partitions[a] = (sums, trees)
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, stamp, a))
        stamp += 1
    part = np.zeros(n, np.int64)
    for p, tree in enumerate(partitions[heap[0][2]][1].tolist() if heap else []):
        stack = [tree]
        while stack:
            t = stack.pop()
            if t < n:
                part[t] = p
            else:
                stack.extend(joined[t - n])
    return part


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item; every window within capacity. The count rises from
    its lower bound until all windows fit."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part = differencing(sizes, k)
        if np.bincount(part, sizes, k).max() <= capacity:
            return part
        k += max(1, k // 200)


def pack(parts: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces; other columns of pieces pass through."""
    total = parts.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    names = [f.name for f in parts.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        length = frame["length"].to_numpy(np.int64)
        rest = np.flatnonzero(length < capacity)
        local = np.zeros(len(frame), np.int64)
        local[rest] = windows(length[rest], capacity)
        used = int(local[rest].max()) + 1 if len(rest) else 0
        full = np.flatnonzero(length >= capacity)
        local[full] = used + np.arange(len(full))
        frame["sequence_id"] = (frame.pop("group").to_numpy(np.int64) << 32) + local
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame[[*names, "sequence_id", "offset"]]

    # Hashed once more, so that groups and the choice of filler documents are independent.
    dealt = parts.withColumn("group", F.pmod(F.xxhash64(F.lit(7), "deal"), F.lit(groups)).cast("long"))
    # A group is seconds of work on few bytes: tasks are counted by groups, not by bytes.
    tasks = max(1, groups // GROUPS_A_TASK)
    return dealt.repartition(tasks, "group").groupBy("group").applyInPandas(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, vocabulary: str | None = None, with_ids: bool = False, added: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with_ids the ids."""
    parts = durable(pieces(docs, capacity=capacity, vocabulary=vocabulary, with_ids=with_ids, added=added))
    return pack(parts, capacity, group_tokens).drop("deal")


def sequences(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:  # noqa: ANN003
    """The training sequences themselves: sequence_id, length, ids (little-endian
    unsigned 32-bit, without padding)."""
    packed = pack_documents(docs, capacity, with_ids=True, **options)
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("parts")).select(
        "sequence_id", "length", F.unhex(F.array_join("parts.ids", "")).alias("ids")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
