"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass reads every whole text and leaves a row of statistics per document. The
trees are fitted on a bounded sample of labelled rows, the `TRAIN_ROWS` smallest by
a seeded hash of the id among rows whose crc32(id as text) mod 4 isn't 2; the other
quarter is held out. Scoring walks flattened trees in numpy over Arrow batches.
Language, source, id and labels are no features.

Defined cases: a null text is the empty text and gets the score of its statistics;
labels that are null are not used, of several labels of one id the smallest counts;
ids that repeat are scored row by row, and learned from by their least statistics;
very long texts are read whole, one at a time; without labels every score is 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.partitions import spread
from tagweave.llm import gbdt
from tagweave.llm.common import bounded_sample, durable, table

TRAIN_ROWS = 20_000
KEEP_FROM = 0.7
SEED = 11


def _class(chars: str) -> np.ndarray:
    mask = np.zeros(256)
    mask[[ord(c) for c in chars]] = 1
    return mask


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_SPACE = _class(" \t\n\x0b\x0c\r")
_SYMBOL = _class("#*$%&|<>{}[]\\^~=+_@/")
_END = _class(".!?")
_PAUSE = _class(",;:")
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _END, _PAUSE, _class("!"), _class("|")], axis=1)

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "lower", "digit", "space", "symbol", "end", "pause", "bang",
    "bar", "beyond_ascii", "byte_entropy", "distinct_words", "top_word", "pair_repeat", "long_words", "one_letter",
    "capital_words", "symbol_words", "log_lines", "distinct_lines", "words_a_line", "end_lines",
)


def statistics(text: str | None) -> list[float]:
    """The document's statistics, in the order of STATISTICS; whole text, one pass."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    shares = (counts @ _CLASSES) / size
    share = counts[counts > 0] / size
    words = raw.split()
    n = max(1, len(words))
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / n, *shares.tolist(),
        float(counts[128:].sum()) / size, float(-(share * np.log2(share)).sum()),
        len(seen) / n, max(seen.values(), default=0) / n, 1 - (pairs + 1) / n if words else 0.0,
        sum(len(w) > 14 for w in words) / n, sum(len(w) == 1 for w in words) / n,
        sum(w[:1].isupper() for w in words) / n, sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in words) / n,
        math.log1p(len(lines)), len(set(lines)) / m, len(words) / m, sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [statistics(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "stats"])


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(named).mapInArrow(_measure, "doc_id long, stats array<double>")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> gbdt.Trees:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    # train_rows ids at most are sent to the executors.
    chosen = bounded_sample(known.where(~held_out(F.col("doc_id"))), ["doc_id"], train_rows, SEED)
    # Of rows that repeat an id the one of least statistics, whatever the partitioning.
    once = measured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.min("label").alias("label"))
    sample = once.orderBy("doc_id").limit(train_rows).toPandas()
    x = np.array(sample["stats"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    return gbdt.fit(x, sample["label"].to_numpy(np.float64), rounds=80, depth=4, rate=0.12)


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score for every row of docs."""
    measured = durable(document_statistics(docs, text, key))
    trees = train(measured, labels, train_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], ["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs with a score of keep_from or more, columns unchanged.

    The trees are fitted on the labelled rows' statistics first; then one pass
    scores the texts where they are read, so no text is shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = bounded_sample(known.where(~held_out(F.col("doc_id"))).distinct(), ["doc_id"], train_rows, SEED)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    trees = train(durable(document_statistics(some)), labels, train_rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))
        return pd.Series(trees.score(x))

    return docs.where(score(F.col("text").cast("string")) >= keep_from)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )
