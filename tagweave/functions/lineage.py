"""Reliable checkpoints for loops over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The cluster's shared folder. One of our own only in local mode, where driver and
    tasks are one process; on a cluster an unset folder is an error."""
    configured = session.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if session.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tagweave-")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage; the files lie in the cluster's shared folder and outlive executors."""
    session = df.sparkSession
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(session))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of a loop, written to the shared folder and read again.

    A checkpoint keeps the size its plan was estimated at, which a loop of joins multiplies
    from round to round, until the planner is busy with the number alone; a written table
    has the size of its files. `close` removes them once the loop's result is durable."""

    def __init__(self, session: SparkSession):
        self.session, self.folder, self.tables = session, f"{shared_folder(session)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.session.read.schema(df.schema).parquet(path)

    def close(self, result: DataFrame) -> DataFrame:
        result = durable(result)
        path = self.session.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return result
