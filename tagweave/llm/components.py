"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Everything stays in tables: no link and no component is sent to the driver, and each
round is checkpointed, so a lost executor costs one round at most. Rounds with few links
left run in few partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import durable, packed


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that isn't its component's smallest.

    Links may repeat, point either way, or from a node to itself. No links give no rows.
    """
    edges = durable(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == before or not found[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = found
        edges = packed(edges, found[0])
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(packed(hooked.unionByName(least.select("u", F.col("m").alias("v"))), 2 * found[0]).distinct())
