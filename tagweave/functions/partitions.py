"""Parallelism of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has slots, dealt over all of them.

    One small file would otherwise keep a single core busy with work that is heavy per
    row. Larger inputs have splits enough and are left as they are, unshuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
