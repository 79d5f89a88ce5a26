"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly with seeded hashes: a jump-consistent hash of
the id picks the shard, a second hash a bucket of it. The bucket count follows the
measured bytes, so that a bucket fits in memory however large the table is. Pass
two loads one bucket, puts it in a fixed order, runs a Fisher-Yates shuffle seeded
by shard and bucket, and writes it. A record's slot is its place in its bucket
after the rows of the shard's earlier buckets.

The law is `key`: the id and the shard count alone decide the shard, and one more
shard takes rows only into itself.

Rows equal in id and text can't be told apart by a hash. Where there are so many that
they would swell a bucket, they are dealt over their shard's buckets by their place in
the scan, so no bucket grows with a hot row; all other rows' places depend on the rows
alone.

Defined cases: a null text has no bytes; a null id hashes as one fixed key; rows
with one id share a shard, since the law says so, but not a bucket; a very long text
makes its bucket larger by its own size; an empty table gives no rows. Columns of the
input other than id and text don't come along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import durable, small_enough, table, text_of

SHARDS = 40
#: Bytes that a bucket should hold; the measured total sets the number of buckets.
BUCKET_BYTES = 16 << 20
SEED = 20_240_117
#: Most rows of a table (bucket starts, crowded digests) that is broadcast.
BROADCAST_ROWS = 20_000
#: Equal rows are crowded beyond one part in CROWD_SHARE of a bucket's rows, and LEAST_CROWD.
CROWD_SHARE, LEAST_CROWD = 4, 64

_JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump-consistent hash of unsigned 64-bit keys."""
    key = keys.astype(np.uint64).copy()
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(_JUMP_MULTIPLIER) + np.uint64(1)
        draw = ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0) / float(1 << 31)
        ahead[live] = np.floor((at[live] + 1) / draw).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_pair(key: Column, shards: int, seed: int = SEED) -> Column:
    """Shard among `shards` and, in the upper 32 bits, among one more. One call, so the
    plan evaluates it once for both."""

    @F.pandas_udf("long")
    def jump(keys: pd.Series) -> pd.Series:
        hashed = keys.to_numpy().view(np.uint64)
        return pd.Series(jump_hash(hashed, shards) + (jump_hash(hashed, shards + 1) << 32))

    return jump(F.xxhash64(F.lit(seed), F.coalesce(key.cast("long"), F.lit(-1))))


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A seeded permutation of range(n)."""
    order = list(range(n))
    draws = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shards(
    docs: DataFrame,
    count: int = SHARDS,
    text: str = "text",
    key: str = "doc_id",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """The shuffled records: doc_id, text, size, shard, bucket, slot, grown_shard."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("nth"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    digest = F.xxhash64("doc_id", "text")
    # What decides a row's place, read and kept once; texts are read again when they move.
    keys = durable(
        named.select("nth", size.alias("size"), digest.alias("digest"), shard_pair(F.col("doc_id"), count, seed).alias("pair"))
    )
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    buckets = max(1, -(-int(total or 0) // (count * bucket_bytes)))
    # Rows equal in id and text would share a bucket; where they are many, they are dealt by
    # their place in the scan instead. At most n / crowd digests are so many.
    crowd = max(LEAST_CROWD, n // (CROWD_SHARE * count * buckets))
    crowded = durable(keys.groupBy("digest").count().where(F.col("count") > crowd).select("digest", F.lit(True).alias("crowded")))
    few = small_enough(crowded, BROADCAST_ROWS)

    def dealt(rows: DataFrame) -> DataFrame:
        """Adds shard, grown_shard and bucket; rows have nth, digest and pair."""
        if buckets > 1:
            rows = rows.join(F.broadcast(crowded) if few else crowded, "digest", "left")
            by = F.when(F.col("crowded"), F.xxhash64(F.lit(seed + 2), "nth")).otherwise(F.xxhash64(F.lit(seed + 1), "digest"))
        else:
            by = F.col("digest")
        return rows.withColumns({
            "shard": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"),
            "grown_shard": F.shiftright("pair", 32).cast("int"),
            "bucket": F.pmod(by, F.lit(buckets)).cast("int"),
        })

    # shards x buckets rows; their number is the table's bytes over bucket_bytes. Where it is
    # small the starts are broadcast; else they are joined on the keys that the shuffle of
    # pass one deals by, so the records move once either way.
    counts = dealt(keys).groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    moved = dealt(named.withColumns({"size": size, "digest": digest, "pair": shard_pair(F.col("doc_id"), count, seed)}))
    started = moved.drop("digest", "pair", "nth").join(F.broadcast(starts) if count * buckets <= BROADCAST_ROWS else starts, ["shard", "bucket"])

    def shuffle(batch: pa.Table) -> pa.Table:
        if batch.num_rows != batch["rows"][0].as_py():
            raise RuntimeError("the input was read in another order the second time: write it to files first")
        batch = batch.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        where = (seed, batch["shard"][0].as_py(), batch["bucket"][0].as_py())
        slot = np.empty(batch.num_rows, np.int64)
        slot[fisher_yates(batch.num_rows, where)] = np.arange(batch.num_rows) + batch["start"][0].as_py()
        batch = batch.append_column("slot", pa.array(slot))
        return batch.select(["doc_id", "text", "size", "shard", "bucket", "slot", "grown_shard"])

    return started.groupBy("shard", "bucket").applyInArrow(
        shuffle, "doc_id long, text string, size long, shard int, bucket int, slot long, grown_shard int"
    )


def write_shards(docs: DataFrame, path: str, count: int = SHARDS, **options) -> None:  # noqa: ANN003
    """One folder per shard, rows in slot order within a bucket's file."""
    out = shards(docs, count, **options)
    out.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        F.crc32(text_of("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
