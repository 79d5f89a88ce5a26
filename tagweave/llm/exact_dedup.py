"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's freqItems, the Karp-Schenker-Papadimitriou form of
that algorithm, merged over partitions) names every digest that may fill more than
`support` of the rows. Their groups are counted exactly with map-side partial
aggregation, so a hot digest never gathers in one task, and the winners, at most
1 / support rows, are broadcast: rows of frequent digests are decided where they
are. All other digests are rare by the summary's guarantee and take an ordinary
shuffle, on digests and ids alone.

Defined cases: a null text is the empty text; a null id sorts below every id; of
rows equal in text and id, the one read first stays; an empty table gives an empty
result; other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import durable, keep_rows, table, text_of

#: A digest of more rows than this is split off, so no task joins more rows of one digest.
MOST_ROWS = 200_000
#: Bounds of the share of all rows from which a digest is split off. The inverse of the
#: lower one is the most digests that are summarised and broadcast.
LEAST_SUPPORT, MOST_SUPPORT = 5e-5, 0.002


def mark_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", support: float | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    support: the share of all rows from which a digest is frequent; by default it follows
    the row count, so that digests shuffled the ordinary way have `MOST_ROWS` rows at most,
    within the two bounds."""
    rows = durable(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            F.sha2(text_of(text).cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    # The earliest of equal ids is the largest (doc_id, -nth).
    rank = F.struct(F.col("doc_id").alias("doc_id"), (-F.col("nth")).alias("back"))
    if support is None:
        support = min(MOST_SUPPORT, max(LEAST_SUPPORT, MOST_ROWS / max(1, rows.count())))
    frequent = rows.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    winners = durable(
        rows.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    )
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    rare = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rare.groupBy("text_sha256").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    light = rare.join(groups, "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).__and__(F.col("nth") == -F.col("best.back")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", support: float | None = None) -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in id and text (null
    and empty are equal), one."""
    marked = mark_duplicates(docs.select(key, text), text, key, support).where("group_size > 1")
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_sha256")
    return keep_rows(docs, durable(marked.select(row.alias("row"), F.col("kept").alias("stays"))), key, text)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d
    """
}
