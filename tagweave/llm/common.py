"""Pieces that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII separators; every other character belongs to a word.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One of our own only in local mode, where driver and
    tasks are one process; on a cluster an unset folder is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tagweave-")


#: Spark's setting under which a query's shuffle files go once it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run here leave no shuffle files behind. Otherwise these
    stay until the driver happens to collect its garbage, and a job of hundreds of steps
    holds those of all of them at once."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which outlives lost executors; what was
    shuffled for it is removed with it written."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # select: the setting holds for queries made under it


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again. Unlike a checkpoint it has the
    size of its files, where a checkpoint keeps the size that its plan was estimated at,
    which joins multiply from round to round; for small tables that rounds start from."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_go(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that one partition of a small table has at most.
ROWS_EACH = 10_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many small rows in partitions that follow its rows, as adaptive
    execution does where it may: a table that was dealt over hundreds of partitions, but
    fits into one, needs no shuffle. Larger tables keep their partitions."""
    return df.coalesce(max(1, -(-rows // ROWS_EACH)))


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = 20_000) -> DataFrame:
    """Broadcast `small` only if it is counted and found small; else a shuffled join,
    which adaptive execution splits where a key is hot."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, on, how)


def bounded_sample(df: DataFrame, keys: list[str], rows: int, seed: int) -> DataFrame:
    """At most `rows` different rows, those of smallest hash of the keys, whatever the
    partitioning and however often a row repeats.

    Different keys are counted first (approximately, in a sketch of fixed size) and cut by
    a hash bound that leaves about a third too many, so that what is made distinct, sorted
    and sent stays near `rows` however many tasks there are.
    """
    n = df.agg(F.approx_count_distinct(F.xxhash64(*keys), 0.02)).first()[0]
    place = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40))
    few = df.where(place < int((1 << 40) * min(1.0, 1.3 * rows / max(1, n)))).distinct()
    return few.orderBy(place, *keys).limit(rows)


def row_key(key: Column, text: Column) -> Column:
    """What tells rows apart that a filter may drop: the id, null for itself, and a digest
    of the text, null as the empty text."""
    return F.concat_ws(":", F.coalesce(key.cast("long").cast("string"), F.lit("-")), F.sha2(text_of(text).cast("binary"), 256))


#: Most marked rows, of some 80 bytes each, that are broadcast.
MARKED_ROWS = 100_000


def keep_rows(docs: DataFrame, marked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose `row_key` is in `marked` (row, stays) with stays false;
    of rows that share a key with stays true, one remains. `marked` lists every row that
    is dropped or repeats; rows with other keys aren't touched. Columns unchanged."""
    once = marked.groupBy("row").agg(F.max("stays").alias("stays"))
    joined = join_small(whole(docs, row_key(F.col(key), F.col(text)).alias("row")), once, ["row"], "left", MARKED_ROWS)
    others = joined.where("stays IS NULL")
    if not marked.where("stays").isEmpty():
        others = others.unionByName(joined.where("stays").dropDuplicates(["row"]))
    return others.select("doc.*")


def whole(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of docs as one, `doc`, beside others, so no name can clash."""
    return docs.select(F.struct("*").alias("doc"), *more)


def one_row_each(members: DataFrame) -> DataFrame:
    """`marked` for keep_rows, from (grp, row, doc_id): the row of the smallest id stays,
    rows without an id after all others, then by `row`."""
    different = members.groupBy("grp", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    best = different.groupBy("grp").agg(F.min(order).alias("best"))
    joined = different.join(best, "grp").select("row", (F.col("row") == F.col("best.row")).alias("stays"), "n")
    return joined.where(~F.col("stays") | (F.col("n") > 1)).select("row", "stays")


class Bloom:
    """Which 64-bit hashes may be among a set's. At most `MOST_BITS` bits, however large the
    set: then more hashes that aren't pass, and none that are is refused."""

    MOST_BITS = 1 << 27

    def __init__(self, hashes: DataFrame, column: str, each: int = 16):
        """hashes: evenly spread longs, such as those of xxHash; each: bits for one of them
        at least. Four let one in ten others pass."""
        n = hashes.count()
        self.bits = min(self.MOST_BITS, 1 << max(16, (each * n).bit_length()))
        mask = F.lit(self.bits - 1)
        both = F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))
        places = hashes.select(F.explode(both).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
        # MOST_BITS / 64 rows at most, 16 bytes each.
        found = places.agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("held")).toPandas()
        words = np.zeros(self.bits // 64, np.int64)
        words[found["word"].to_numpy(np.int64)] = found["held"].to_numpy(np.int64)
        self.held = words.tobytes()

    def among(self, values: np.ndarray) -> np.ndarray:
        """The same for an array of longs."""
        v, held = values.view(np.uint64), np.frombuffer(self.held, np.uint8)
        mask, seven = np.uint64(self.bits - 1), np.uint64(7)
        found = np.ones(len(v), bool)
        for at in (v & mask, (v >> np.uint64(32)) & mask):
            found &= (held[at >> np.uint64(3)] >> (at & seven).astype(np.uint8) & 1).astype(bool)
        return found

    def __contains__(self, value: int) -> bool:
        a, b = value & self.bits - 1, (value >> 32) & self.bits - 1
        return bool(self.held[a >> 3] >> (a & 7) & 1 and self.held[b >> 3] >> (b & 7) & 1)
