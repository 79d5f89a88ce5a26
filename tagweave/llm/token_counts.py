"""Token counts by a linear longest-match automaton.

Greedy word pieces of a word: the longest vocabulary entry that starts it, then the
longest that starts the rest, and so on. The vocabulary is laid out as a byte trie.
Where a node can't go on with a byte, its failure link names the node of what is
left once the greedy pieces before it are popped, and the number of pieces popped is
stored with the link (Song et al., "Fast WordPiece Tokenization", 2021). Only the
counts are stored: no piece is ever built. Links and counts are folded into one
complete table, so each byte of a word costs one look-up, and numpy advances all
words of a batch together.

The vocabulary is a byte-level one whose word-initial entries begin with a space;
a word is matched with a space before it. All 256 single bytes are entries, so every
word has pieces.

Defined cases: a null or blank text has no words and no tokens; texts of any length
are counted whole, words longer than `LONG_WORD` bytes by the same automaton one
byte at a time; rows are counted one by one, so ties and repeats don't matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm.common import table

LONG_WORD = 256
#: Bytes whose words advance together; bounds memory for batches of long texts.
CHUNK_BYTES = 4 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NODE_BITS = 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> list[bytes]:
    """Entries of a file with `base64 rank` lines."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """table[node * 256 + byte] holds the next node and, above _NODE_BITS, the pieces popped."""

    def __init__(self, vocabulary: list[bytes]):
        entries = set(vocabulary) | {bytes([b]) for b in range(256)}
        child: list[dict[int, int]] = [{}]
        text: list[bytes] = [b""]
        for entry in sorted(entries):
            node = 0
            for i, byte in enumerate(entry):
                if byte not in child[node]:
                    child[node][byte] = len(child)
                    child.append({})
                    text.append(entry[: i + 1])
                node = child[node][byte]
        order = sorted(range(len(child)), key=lambda v: len(text[v]))
        longest = max(map(len, text))
        if len(child) > 1 << _NODE_BITS or longest >= 1 << (31 - _NODE_BITS):
            raise ValueError(f"vocabulary too large: {len(child)} nodes, entries of up to {longest} bytes; the table holds 2^{_NODE_BITS} nodes and pops below 2^{31 - _NODE_BITS}")
        table = np.zeros((len(child), 256), np.int32)
        self.left = np.zeros(len(child), np.int64)  # pieces of a node's own text
        mask = (1 << _NODE_BITS) - 1
        for v in order:
            if v:
                if text[v] in entries:
                    fail, popped = 0, 1
                else:  # one byte less failed to be an entry, too: go on from there
                    parent_fail, parent_popped = links[text[v][:-1]]
                    step = int(table[parent_fail, text[v][-1]])
                    fail, popped = step & mask, parent_popped + (step >> _NODE_BITS)
                links[text[v]] = (fail, popped)
                table[v] = table[fail] + np.int32(popped << _NODE_BITS)
                self.left[v] = popped + self.left[fail]
            else:
                links: dict[bytes, tuple[int, int]] = {}
            for byte, to in child[v].items():
                table[v, byte] = to
        self.table = table.reshape(-1)

    def count(self, word: bytes) -> int:
        """Pieces of one word, byte by byte."""
        node, popped, step = 0, 0, self.table
        for byte in word:
            x = int(step[node * 256 + byte])
            node, popped = x & ((1 << _NODE_BITS) - 1), popped + (x >> _NODE_BITS)
        return popped + int(self.left[node])

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pieces of many words of a byte buffer, each with a space before it."""
        order = np.argsort(-length, kind="stable")
        begin, size = start[order], length[order]
        first = int(self.table[32])
        node = np.full(len(order), first & ((1 << _NODE_BITS) - 1), np.int32)
        popped = np.full(len(order), first >> _NODE_BITS, np.int32)
        ends = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for at, live in enumerate(ends.tolist()):  # the words longer than `at` come first
            step = self.table[node[:live].astype(np.int64) * 256 + data[begin[:live] + at]]
            node[:live] = step & ((1 << _NODE_BITS) - 1)
            popped[:live] += step >> _NODE_BITS
        out = np.empty(len(order), np.int64)
        out[order] = popped + self.left[node]
        return out


_BUILT: dict[int, Automaton] = {}


def _automaton(vocabulary: list[bytes]) -> Automaton:
    """One per Python worker and vocabulary."""
    key = hash(tuple(vocabulary))
    if key not in _BUILT:
        _BUILT[key] = Automaton(vocabulary)
    return _BUILT[key]


def count_texts(automaton: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\n".join(texts[at:end]) + b"\n", np.uint8)
        space = _IS_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        start, stop = edge[0::2], edge[1::2]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[at:end]]), start, side="right")
        length = stop - start
        short = length <= LONG_WORD
        pieces = np.empty(len(start), np.int64)
        pieces[short] = automaton.counts(data, start[short], length[short])
        for i in np.flatnonzero(~short):
            pieces[i] = automaton.count(b" " + data[start[i] : stop[i]].tobytes())
        words[at:end] = np.bincount(owner, minlength=end - at)
        tokens[at:end] = np.bincount(owner, pieces, minlength=end - at).astype(np.int64)
        at = end
    return words, tokens


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of docs."""
    # The vocabulary file has a fixed size of a few MB at most; executors need no path to it.
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            words, tokens = count_texts(automaton, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(named).mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
