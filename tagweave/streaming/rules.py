"""Rules and counters over streams.

Current-value rules map each micro-batch and upsert their output by key; event counters
are windowed aggregates with a watermark; sessions close one gap after their last
event. Timestamps without a zone are cast first, as watermarks need instants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream; new files are picked up as they appear."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def with_watermark(events: DataFrame, ts: str = "ts", late: str = WATERMARK) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def daily_counters(events: DataFrame, kind: str, ts: str = "ts") -> DataFrame:
    """(day, kind, n) kept up to date as events arrive."""
    return with_watermark(events, ts).groupBy(F.window(ts, "1 day"), kind).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), kind, "n")


def sliding_means(events: DataFrame, key: str, value: str, size: str, slide: str, ts: str = "ts") -> DataFrame:
    grouped = with_watermark(events, ts).groupBy(F.window(ts, size, slide), key)
    return grouped.agg(F.round(F.avg(value), 4).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "mean", "n")


def stream_sessions(events: DataFrame, key: str, gap: str, value: str, ts: str = "ts") -> DataFrame:
    grouped = with_watermark(events, ts).groupBy(F.session_window(ts, gap), key)
    return grouped.agg(F.count("*").alias("n"), F.round(F.max(value), 4).alias("peak")).select(F.col("session_window.start").alias("start"), key, "n", "peak")


def current_values(events: DataFrame, key: str, output: Column, ts: str = "ts") -> DataFrame:
    """A rule's output for the newest event of each key in a batch."""
    newest = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.col(ts)).alias("__e"))
    return newest.select("__e.*").select(key, ts, output.alias("output"))


def run_current_rule(events: DataFrame, key: str, output: Column, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "10 seconds") -> Any:
    """Starts the rule; `write` gets each batch's outputs with the batch number, and
    should upsert by key so that a repeated batch changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        write(current_values(batch, key, output), number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def streaks(events: DataFrame, key: str, state: str, ts: str = "ts") -> DataFrame:
    """(key, longest): the longest run of equal states so far, across batches. The state
    per key is the last value, its run and the longest run."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, run, longest = held.get if held.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values([ts, state], kind="stable")
        for value in rows[state]:
            run = run + 1 if value == last else 1
            last, longest = value, max(longest, run)
        held.update((last, run, longest))
        yield pd.DataFrame({key: [keys[0]], "longest": [longest]})

    schema = events.schema
    return (
        events.select(key, state, ts)
        .groupBy(key)
        .applyInPandasWithState(
            update, f"{key} {schema[key].dataType.simpleString()}, longest long", f"last {schema[state].dataType.simpleString()}, run long, longest long",
            "update", GroupStateTimeout.NoTimeout,
        )
    )


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what is there now. Each batch is written by the executors to the
    shared folder, a repeated batch over itself; a complete stream's answer is its last
    batch, an update or append stream's all of them."""
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        numbers.append(number)

    running = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    spark = stream.sparkSession
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    kept = numbers[-1:] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/out/{n}" for n in kept))
