"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read
again as the next stage's docs. All but the last return the columns of documents.
Each stage's defined cases are those of its operator; an empty table passes through
all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import line_dedup, mixing, near_copies, packing, quality
from tagweave.llm.common import SEPARATORS, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for the first document's;
    so do documents that have no word left because of it. n_chars follows the text."""
    cleaned = line_dedup.drop_recurring_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(SEPARATORS)) == "")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are 0.8 alike or more:
    by SimHash, and by an exact join for what its bits can't find."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources repeated to target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-duplicate removal", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: Trained trees and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    """The file system of a path, and the path, as Spark sees them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The stages in order. Each stage's table is written to the cluster's shared folder
    and replaces the one before it, so two lie there at most; the last one stays, since
    the result is read from it.

    run_id: names the run. A run that failed goes on under the same name from the last
    stage that was written whole; without a name every run is a new one.
    """
    folder = f"{shared_dir(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    done = [k for k in range(len(STAGES)) if (at := _path(spark, f"{folder}/{k}/_SUCCESS"))[0].exists(at[1])]
    first = max(done, default=-1) + 1
    docs = spark.read.parquet(f"{folder}/{first - 1}") if first else table(spark, sf_dir, "documents")
    for k in range(first, len(STAGES)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files, path = _path(spark, f"{folder}/{k - 1}")
            files.delete(path, True)
    return docs
