"""Line dedup with a log-template tree.

Every line is a path in a tree of fixed depth: its number of tokens, which single spaces
set apart, then its first
`LEADING` tokens; tokens with a digit are variable fields from the start and read
`<*>`. Under a leaf, lines that agree in at least `ALIKE` of their tokens fall under
one template, whose other places become `<*>` as well (He et al., "Drain", 2017).
A template that occurs in two documents or more recurs; the document with the
smallest id keeps its lines, all other documents lose theirs.

A first pass over the texts leaves numbers only: for every line its document, place, leaf
and hash. Leaves that a single document has can't recur. A second pass collects the lines
of the others, found by a filter of fixed size; each task collapses equal masked lines
before they are shuffled, so a line in a third of all documents is a few rows. A leaf with
more than `LEAF_LINES` different lines is parted where lines have no run of tokens in
common, even by way of others. No template lies across such parts, so the bound changes
where lines are compared and never the result; lines that are all connected stay in one
task, which reads them in order and keeps their templates and 16 bytes a line. A leaf keeps
all its templates; a place that varies equals no token. Texts are
shuffled once, with the places of the lines they lose.

Defined cases: a null text stays null; lines of fewer than `LEAST_TOKENS` tokens and
blank lines always stay; rows without an id count as one document after all others;
rows that repeat an id are one document; a document may lose all its lines and is
then an empty text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagweave.llm.common import SEPARATORS, Bloom, durable, join_small, table, whole
from tagweave.llm.components import connected_components

LEADING = 3
LEAST_TOKENS = 5
ALIKE = 0.8
LEAF_LINES = 50_000
#: Templates of a leaf up to which all are compared, without an index.
SCANNED = 32
WILDCARD = "<*>"
LAST = (1 << 63) - 1
SEED = 5
#: Different lines that a task holds while it collapses equal ones.
HELD_LINES = 100_000

_DIGIT = re.compile("[0-9]")
_FIELD = re.compile("[^ ]*[0-9][^ ]*")


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), SEED)
    return value - (1 << 64) if value >> 63 else value


def masked_lines(text: str | None) -> Iterator[tuple[int, str, int]]:
    """Place, masked line and leaf of every line that can be dropped."""
    for pos, raw in enumerate((text or "").split("\n")):
        line = raw.strip(SEPARATORS)
        if _DIGIT.search(line):
            line = _FIELD.sub(WILDCARD, line)
        count = line.count(" ") + 1
        if line and count >= LEAST_TOKENS:
            yield pos, line, _hash(f"{count} {' '.join(line.split(' ', LEADING)[:LEADING])}")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("string").alias("text"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every line that can be dropped: document, digest of the text, place, leaf, hash."""
    for batch in batches:
        row, pos, leaf, line = [], [], [], []
        for i, text in enumerate(batch.column(2)):
            for p, masked, where in masked_lines(text.as_py()):
                row.append(i)
                pos.append(p)
                leaf.append(where)
                line.append(_hash(masked))
        picked = pa.array(row, pa.int64())
        columns = [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(pos, pa.int32()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "digest", "pos", "leaf", "line"])


def _collapsed(batches: Iterator[pa.RecordBatch], wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """Masked lines of wanted leaves, a task's equal ones once, with the smallest and
    largest document."""

    def out(held: dict[str, list[int]]) -> pa.RecordBatch:
        leaf, lo, hi = (pa.array([x[i] for x in held.values()], pa.int64()) for i in range(3))
        return pa.RecordBatch.from_arrays([leaf, pa.array(held.keys(), pa.string()), lo, hi], ["leaf", "masked", "lo", "hi"])

    held: dict[str, list[int]] = {}
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for _, line, leaf in masked_lines(text.as_py()):
                x = held.get(line)
                if x is None:
                    if leaf not in wanted:
                        continue
                    held[line] = [leaf, doc, doc]
                    size += len(line)
                elif doc < x[1]:
                    x[1] = doc
                elif doc > x[2]:
                    x[2] = doc
            if len(held) > HELD_LINES or size > 32 << 20:
                yield out(held)
                held, size = {}, 0
    yield out(held)


def blocks(tokens: list[str | None]) -> Iterator[tuple]:
    """The tokens behind the leading ones in one run more than may differ, so two lines of
    a leaf that are `ALIKE` have a run in common."""
    runs = _differing(len(tokens)) + 1
    rest = len(tokens) - LEADING
    for i in range(runs):
        yield (i, *tokens[LEADING + rest * i // runs : LEADING + rest * (i + 1) // runs])


@cache
def _differing(n: int) -> int:
    """Most tokens of n that may differ."""
    return next(d for d in range(n, -1, -1) if (n - d) / n >= ALIKE)


class Leaf:
    """The templates of one leaf, grown line by line; of the lines only hashes are kept.

    All templates stay. Where there are many, those that share a run of tokens with the
    line are compared, which are all that can be alike."""

    def __init__(self) -> None:
        self.templates: list[list[str | None]] = []  # None is a place that varies
        self.index: dict[tuple, set[int]] | None = None
        self.lines, self.numbers = array("q"), array("q")
        self.first, self.last = array("q"), array("q")  # by template

    def place(self, line: str) -> int:
        """The number of the line's template."""
        tokens = line.split(" ")
        if self.index is None and len(self.templates) > SCANNED:
            self.index = {}
            for number, template in enumerate(self.templates):
                for x in blocks(template):
                    self.index.setdefault(x, set()).add(number)
        near = range(len(self.templates)) if self.index is None else sorted(set().union(*(self.index.get(x, ()) for x in blocks(tokens))))
        best, number = 0.0, -1
        for i in near:
            same = sum(map(eq, self.templates[i], tokens)) / len(tokens)
            if same > best:
                best, number = same, i
        if best >= ALIKE:
            old = self.templates[number]
            new = [a if a == b else None for a, b in zip(old, tokens, strict=True)]
            self.templates[number] = new
        else:
            number, old, new = len(self.templates), None, tokens
            self.templates.append(tokens)
        if self.index is not None and new != old:
            for x in blocks(old) if old else ():
                self.index[x].discard(number)
            for x in blocks(new):
                self.index.setdefault(x, set()).add(number)
        return number

    def add(self, line: str, lo: int, hi: int) -> None:
        number = self.place(line)
        self.lines.append(_hash(line))
        self.numbers.append(number)
        if number == len(self.first):
            self.first.append(lo)
            self.last.append(hi)
        else:
            self.first[number] = min(self.first[number], lo)
            self.last[number] = max(self.last[number], hi)

    def recurring(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lines whose template two documents have, and the document that keeps them."""
        lines, numbers, first, last = (np.frombuffer(x, np.int64) for x in (self.lines, self.numbers, self.first, self.last))
        found = first[numbers] != last[numbers]
        return lines[found], first[numbers[found]]


def group_leaf(lines: list[tuple[int, str]]) -> list[int]:
    """The template number of each (order, masked line) of one leaf."""
    leaf = Leaf()
    return [leaf.place(line) for _, line in lines]


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by leaf, document and line: the lines whose template occurs in two
    documents, and the document that keeps them."""

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)])) for i in range(2)], ["line", "keep"])

    number, leaf = None, Leaf()
    for batch in batches:
        found = []
        for at, line, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if at != number:
                found.append(leaf.recurring())
                number, leaf = at, Leaf()
            leaf.add(line, lo, hi)
        yield out(found)
    yield out([leaf.recurring()])


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a line: each run of its tokens, under its leaf."""
    for batch in batches:
        nodes, keys = [], []
        for leaf, masked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            node = _hash(masked)
            for run in blocks(masked.split(" ")):
                nodes.append(node)
                keys.append(_hash(f"{leaf} {run[0]} {' '.join(run[1:])}"))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.int64())], ["node", "key"])


def _apart(lines: DataFrame) -> DataFrame:
    """Lines of crowded leaves, each under the smallest line it is connected with by
    shared runs of tokens. Lines of one template agree in a run, two by two, so no
    template is torn apart."""
    filed = lines.select("leaf", "masked").mapInArrow(_filed, "node long, key long")
    least = filed.groupBy("key").agg(F.min("node").alias("least"))
    roots = connected_components(filed.join(least, "key").select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = lines.mapInArrow(_with_node, "leaf long, masked string, lo long, hi long, node long")
    return named.join(roots, "node", "left").select(F.xxhash64("leaf", F.coalesce("root", "node")).alias("leaf"), "masked", "lo", "hi")


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("node", pa.array([_hash(x) for x in batch.column(1).to_pylist()], pa.int64()))


def recurring_lines(named: DataFrame, placed: DataFrame) -> DataFrame:
    """(line, keep): hashes of lines to drop outside document `keep`, from texts (doc,
    text) and their lines (doc, leaf, line)."""
    leaves = placed.groupBy("leaf").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    shared = durable(leaves.where("lo < hi").select("leaf", "n"))
    held = named.sparkSession.sparkContext.broadcast(Bloom(shared, "leaf"))
    lines = named.select("doc", "text").mapInArrow(lambda batches: _collapsed(batches, held.value), "leaf long, masked string, lo long, hi long")
    # Equal lines of all tasks meet by line, not by leaf, so a common line is one row of its leaf.
    lines = lines.groupBy("leaf", "masked").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    often = shared.where(F.col("n") > LEAF_LINES).select("leaf")
    if not often.isEmpty():
        # Occurrences are counted so far; only leaves of many different lines are crowded.
        different = durable(join_small(lines, often, ["leaf"], "left_semi"))
        crowded = durable(different.groupBy("leaf").count().where(F.col("count") > LEAF_LINES).select("leaf"))
        lines = join_small(lines, often, ["leaf"], "left_anti").unionByName(join_small(different, crowded, ["leaf"], "left_anti"))
        if not crowded.isEmpty():
            lines = lines.unionByName(_apart(join_small(different, crowded, ["leaf"], "left_semi")))
    return lines.repartition("leaf").sortWithinPartitions("leaf", "lo", "masked").select("leaf", "masked", "lo", "hi").mapInArrow(_recurring, "line long, keep long")


@F.arrow_udf(StringType())
def _without_places(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines at these places, each line looked up once in a set."""

    def cut(text: str, places: list[int]) -> str:
        dropped = set(places)
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in dropped)

    return pa.array([None if t is None else cut(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True)], pa.string())


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with cleaned texts, and n_lines and n_dropped, which replace columns of these
    names; other columns unchanged."""
    texts = _named(docs)
    placed = texts.select("doc", F.xxhash64("text").alias("digest"), "text").mapInArrow(_places, "doc long, digest long, pos int, leaf long, line long")
    placed = durable(placed)
    gone = placed.join(recurring_lines(texts, placed), "line").where("doc <> keep").groupBy("doc", "digest").agg(F.collect_set("pos").alias("gone"))
    named = whole(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("digest"))
    joined = named.join(gone.withColumnRenamed("doc", "id"), ["id", "digest"], "left")
    parts = F.split("doc.text", "\n")
    # Python sees the texts that lose lines alone.
    kept = _without_places(F.when(F.col("gone").isNotNull(), F.col("doc.text").cast("string")), F.col("gone"))
    cleaned = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept).alias("text")
    return joined.select(
        *(cleaned if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")
