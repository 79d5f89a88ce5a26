"""Ordered work on series of any length: neighbours, running sums, last known values.

Without a width, a series is one window. With one, it is cut into slices of so many
seconds, each a window of its own, so that a point with most of all samples is spread
over as many tasks as it has slices. What has to cross a border is one small row a slice,
found by an aggregation that combines before it shuffles and set into the slice ahead of
its rows; a second window over these rows alone carries it from slice to slice.

The first column of an order is the time; rows without a time are a slice of their own,
before all others. Keys may be null. Rows of one time are never cut apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sliced(df: DataFrame, ts: str, width_s: float) -> DataFrame:
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return df.withColumn("__slice", F.coalesce(F.floor(seconds / width_s).cast("long"), F.lit(-(2**63)).cast("long")))


def _bordered(cut: DataFrame, *borders: DataFrame) -> DataFrame:
    """Rows with `__side` 0 and rows from across the borders, by name; the rest of those is null."""
    out = cut.withColumn("__side", F.lit(0))
    for b in borders:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def _inside(keys: Sequence[str], order: Sequence[str]) -> object:
    return Window.partitionBy(*keys, "__slice").orderBy("__side", *order)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: Sequence[str] = (), ahead: Sequence[str] = (), width_s: float | None = None) -> DataFrame:
    """df with prev_<c> of the row before for c of back, next_<c> of the row after for c of ahead."""

    def added(w: object) -> list[Column]:
        return [*(F.lag(c).over(w).alias(f"prev_{c}") for c in back), *(F.lead(c).over(w).alias(f"next_{c}") for c in ahead)]

    if width_s is None:
        return df.select("*", *added(Window.partitionBy(*keys).orderBy(*order)))
    cut = _sliced(df, order[0], width_s)
    place, outer = F.struct(*order), Window.partitionBy(*keys).orderBy("__slice")
    borders = []
    for columns, pick, step, side in ((back, F.max_by, F.lag, -1), (ahead, F.min_by, F.lead, 1)):
        if columns:
            ends = cut.groupBy(*keys, "__slice").agg(pick(F.struct(*columns), place).alias("__end"))
            carried = ends.select(*keys, "__slice", step("__end").over(outer).alias("__end")).where("__end IS NOT NULL")
            borders.append(carried.select(*keys, "__slice", F.lit(side).alias("__side"), *(F.col("__end")[c].alias(c) for c in columns if c not in keys)))
    return _bordered(cut, *borders).select("*", *added(_inside(keys, order))).where("__side = 0").drop("__side", "__slice")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, width_s: float | None = None) -> DataFrame:
    """df with the sum of a column up to each row."""
    if width_s is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(column).over(w))
    cut = _sliced(df, order[0], width_s)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__slice").agg(F.sum(column).alias("__sum"))
    carried = sums.select(*keys, "__slice", F.sum("__sum").over(before).alias(column), F.lit(-1).alias("__side")).where(F.col(column).isNotNull())
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return _bordered(cut, carried).withColumn(name, F.sum(column).over(w)).where("__side = 0").drop("__side", "__slice")


def known(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, width_s: float | None = None) -> DataFrame:
    """df with the last value of a column up to each row that isn't null."""
    if width_s is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(column, ignorenulls=True).over(w))
    cut = _sliced(df, order[0], width_s)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    lasts = cut.groupBy(*keys, "__slice").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("__last"))
    carried = lasts.select(*keys, "__slice", F.last("__last", ignorenulls=True).over(before).alias(column), F.lit(-1).alias("__side")).where(F.col(column).isNotNull())
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return _bordered(cut, carried).withColumn(name, F.last(column, ignorenulls=True).over(w)).where("__side = 0").drop("__side", "__slice")
