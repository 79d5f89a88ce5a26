"""Time-series operators over long tables of (point, ts, value).

Buckets are half-open and aligned to midnight; a period lasts from its first sample to
the sample after its last, or to its last sample where the series ends. Ordered work
is a window partitioned by point, so it scales with the number of points; where one point
may hold most samples, `slice_s` cuts series into slices of so many seconds (slices.py).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators import slices

_CALENDAR = {"year", "quarter", "month", "week", "day", "hour", "minute"}
_FOLDS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without a zone, as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def bucket(ts: Column, interval: str) -> Column:
    """`15 minutes`, `1 hour`, `day`, `month`: the start of the bucket."""
    number, _, unit = interval.rpartition(" ")
    unit = unit.rstrip("s")
    width = int(number or 1)
    if unit not in _CALENDAR:
        raise ValueError(f"no interval {interval!r}")
    if width == 1:
        return F.date_trunc(unit, ts)
    if unit not in ("minute", "hour") or (1440 if unit == "minute" else 24) % width:
        raise ValueError(f"{interval!r} doesn't divide a day")
    day = F.date_trunc("day", ts)
    size = width * (60 if unit == "minute" else 3600)
    passed = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int")
    return day + F.make_interval(secs=(F.floor(passed / size) * size).cast("decimal(18,6)"))


def span(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows in [start, end); plain comparisons, so a Parquet scan is given them."""
    kind = df.schema[ts].dataType.simpleString()
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def rollup(df: DataFrame, keys: Sequence[str], value: str, interval: str | None = None, folds: Sequence[str] = ("avg",), ts: str = "ts", digits: int = 4) -> DataFrame:
    """One row per key and bucket (or key alone) with a column for each fold."""
    by = [*keys, *([bucket(F.col(ts), interval).alias("bucket")] if interval else [])]
    return df.groupBy(*by).agg(*(F.round(_FOLDS[f](value), digits).alias(f"{f}_{value}") for f in folds))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column, name: str = "island", slice_s: float | None = None) -> DataFrame:
    """Adds `__state` and a running number that grows where the state changes."""
    marked = df.withColumn("__state", state).withColumn("__was", F.struct("__state"))
    beside = slices.neighbours(marked, keys, order, ["__was"], width_s=slice_s)
    same = F.col("prev___was").isNotNull() & F.col("__state").eqNullSafe(F.col("prev___was")["__state"])
    stepped = beside.withColumn("__new", F.when(same, 0).otherwise(1)).drop("__was", "prev___was")
    return slices.running(stepped, keys, order, "__new", name, slice_s).drop("__new")


def periods(df: DataFrame, keys: Sequence[str], condition: Column, ts: str = "ts", order: Sequence[str] = (), slice_s: float | None = None) -> DataFrame:
    """Longest runs in which the condition holds: keys, start, end, duration_s, samples."""
    by = [ts, *order]
    ahead = slices.neighbours(df, keys, by, ahead=[ts], width_s=slice_s)
    runs = islands(ahead.withColumn("__next", F.coalesce(f"next_{ts}", ts)).drop(f"next_{ts}"), keys, by, F.coalesce(condition, F.lit(False)), slice_s=slice_s).where("__state")
    out = runs.groupBy(*keys, "island").agg(F.min(ts).alias("start"), F.max("__next").alias("end"), F.count("*").alias("samples"))
    return out.withColumn("duration_s", seconds(F.col("end")) - seconds(F.col("start"))).drop("island")


def lasting(found: DataFrame, at_least_s: float) -> DataFrame:
    return found.where(F.col("duration_s") >= at_least_s)


def sessions(df: DataFrame, keys: Sequence[str], gap_s: float, value: str, ts: str = "ts", order: Sequence[str] = (), slice_s: float | None = None) -> DataFrame:
    """Hits at most gap_s apart merge: start, end, n, max and avg of value."""
    by = [ts, *order]
    beside = slices.neighbours(df, keys, by, [ts], width_s=slice_s)
    since = seconds(F.col(ts)) - seconds(F.col(f"prev_{ts}"))
    marked = beside.withColumn("__new", F.when(since <= gap_s, 0).otherwise(1))
    return (
        slices.running(marked, keys, by, "__new", "__session", slice_s)
        .groupBy(*keys, "__session")
        .agg(
            F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"),
            F.round(F.max(value), 4).alias(f"max_{value}"), F.round(F.avg(value), 4).alias(f"avg_{value}"),
        )
        .drop("__session")
    )


def longest_streak(df: DataFrame, keys: Sequence[str], state: str, order: Sequence[str], slice_s: float | None = None) -> DataFrame:
    """Length of the longest run of equal states."""
    runs = islands(df, keys, order, F.col(state), slice_s=slice_s).groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], slice_s: float | None = None) -> DataFrame:
    return slices.neighbours(df, keys, order, columns, width_s=slice_s)


def rate_of_change(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", order: Sequence[str] = (), slice_s: float | None = None) -> DataFrame:
    """Largest |change| per minute between neighbours that lie apart in time."""
    w = with_previous(df.withColumn("__s", seconds(F.col(ts))), keys, [ts, *order], [value, "__s"], slice_s)
    minutes = (F.col("__s") - F.col("prev___s")) / 60
    rate = F.when(minutes > 0, F.abs(F.col(value) - F.col(f"prev_{value}")) / minutes)
    return w.groupBy(*keys).agg(F.round(F.max(rate), 4).alias("max_rate"))


def outliers(df: DataFrame, keys: Sequence[str], value: str, sigmas: float = 3.0, flag_percent: float = 5.0) -> DataFrame:
    """Count and share beyond sigmas of the population deviation. The moments come from
    an aggregation that combines before the shuffle; they are joined back, not windowed,
    so a hot key doesn't gather its rows in one task."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    far = F.abs(F.col(value) - F.col("__mean")) > sigmas * F.col("__sd")
    joined = df.join(moments, list(keys))
    counted = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(far).alias("n_outliers"), F.round(F.first("__mean"), 4).alias("mean"), F.round(F.first("__sd"), 4).alias("sd"))
    percent = F.round(100.0 * F.col("n_outliers") / F.col("n"), 4)
    return counted.withColumn("percent", percent).withColumn("flagged", percent > flag_percent)


def flat_line(value: str, share: float = 0.01) -> Column:
    """An aggregate: the range is under a share of the mean."""
    return (F.max(value) - F.min(value)) < share * F.avg(value)


def gaps(df: DataFrame, keys: Sequence[str], times: float = 3.0, ts: str = "ts", order: Sequence[str] = (), slice_s: float | None = None) -> DataFrame:
    """Intervals longer than `times` the mean one: count, longest, and coverage of the
    span at the mean of the shortest expected rate."""
    beside = slices.neighbours(df.withColumn("__s", seconds(F.col(ts))), keys, [ts, *order], ["__s"], width_s=slice_s)
    since = beside.withColumn("__d", F.col("__s") - F.col("prev___s"))
    mean = since.groupBy(*keys).agg(F.avg("__d").alias("__mean"))
    joined = since.join(mean, list(keys))
    out = joined.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("__d") > times * F.col("__mean")).alias("n_gaps"),
        F.round(F.max("__d") / 60, 4).alias("longest_min"),
        (F.max("__s") - F.min("__s")).alias("__span"),
    )
    return out.drop("__span")


def coverage(df: DataFrame, keys: Sequence[str], start: str, end: str, expected_min: float, ts: str = "ts") -> DataFrame:
    """Percent of the samples that one each expected_min minutes would give."""
    inside = span(df, start, end, ts)
    due = (seconds(F.lit(end).cast("timestamp")) - seconds(F.lit(start).cast("timestamp"))) / 60 / expected_min
    return inside.groupBy(*keys).agg(F.round(100.0 * F.count("*") / F.first(due), 4).alias("coverage"))


def transitions(df: DataFrame, keys: Sequence[str], state: str, ts: str = "ts", order: Sequence[str] = (), slice_s: float | None = None) -> DataFrame:
    """Changes of state, and changes per hour of the span."""
    w = with_previous(df, keys, [ts, *order], [state], slice_s)
    changed = F.count_if(F.col(state) != F.col(f"prev_{state}"))
    hours = (F.max(seconds(F.col(ts))) - F.min(seconds(F.col(ts)))) / 3600
    return w.groupBy(*keys).agg(changed.alias("transitions"), F.round(F.try_divide(changed.cast("double"), hours), 4).alias("per_hour"))


def peak(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """Largest value and the first time it was reached."""
    return df.groupBy(*keys).agg(F.max(value).alias("peak"), F.min_by(ts, F.struct(-F.col(value), F.col(ts))).alias("peak_ts"))


def monday_weekday(ts: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(ts)


def sunday_weekday(ts: Column) -> Column:
    """Sunday 1 to Saturday 7."""
    return F.dayofweek(ts)


def profile(df: DataFrame, by: Column, name: str, value: str) -> DataFrame:
    return df.groupBy(by.alias(name)).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 4).alias("avg"), F.round(F.max(value), 4).alias("max"),
        F.round(F.min(value), 4).alias("min"), F.round(F.sum(value), 2).alias("sum"),
    )


def baseline_deviation(df: DataFrame, split: str, value: str, ts: str = "ts") -> DataFrame:
    """Percent deviation of each row from `split` on from the mean of its weekday and
    hour before it, or the overall mean before it; 0 where the baseline isn't positive.

    The baseline has 168 rows at most, so it is broadcast."""
    kind = df.schema[ts].dataType.simpleString()
    at = F.lit(split).cast(kind)
    slot = [F.weekday(ts).alias("dow"), F.hour(ts).alias("hour")]
    before = df.where(F.col(ts) < at)
    base = before.groupBy(*slot).agg(F.avg(value).alias("__base"))
    overall = before.agg(F.avg(value).alias("__all"))
    now = df.where(F.col(ts) >= at).select("*", *slot)
    joined = now.join(F.broadcast(base), ["dow", "hour"], "left").crossJoin(F.broadcast(overall))
    baseline = F.coalesce("__base", "__all")
    return joined.withColumn("baseline", F.round(baseline, 4)).withColumn(
        "deviation", F.round(F.when(baseline > 0, 100 * (F.col(value) - baseline) / baseline).otherwise(0.0), 4)
    ).drop("__base", "__all")


def interpolate(df: DataFrame, keys: Sequence[str], value: str, interval: str, start: str, end: str, ts: str = "ts", slice_s: float | None = None) -> DataFrame:
    """A regular series that carries the last known value forward."""
    grid = df.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"INTERVAL {interval}"))).alias(ts))
    all_rows = df.select(*keys, F.col(ts).cast("timestamp_ntz").alias(ts), value, F.lit(0).alias("__grid")).unionByName(
        grid.withColumn(value, F.lit(None).cast(df.schema[value].dataType)).withColumn("__grid", F.lit(1)))
    filled = slices.known(all_rows, keys, [ts, "__grid"], value, "__known", slice_s).where("__grid = 1")
    return filled.withColumn(value, F.col("__known")).drop("__grid", "__known")


def join_series(a: DataFrame, b: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Two series at equal times; b's other columns get the suffix _b."""
    other = b.select(*keys, ts, *(F.col(c).alias(c + "_b") for c in b.columns if c not in {*keys, ts}))
    return a.join(other, [*keys, ts])


def as_of(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", slice_s: float | None = None) -> DataFrame:
    """a with b's last value at or before each time: one union and one ordered window."""
    left = a.select("*", F.lit(None).cast(b.schema[value].dataType).alias("__v"), F.lit(1).alias("__left"))
    right = b.select(*keys, ts, F.col(value).alias("__v"), F.lit(0).alias("__left"))
    both = left.unionByName(right, allowMissingColumns=True)
    return slices.known(both, keys, [ts, "__left"], "__v", f"{value}_as_of", slice_s).where("__left = 1").drop("__v", "__left")


def write_samples(history: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """history with samples added, or in place of those of their keys and time."""
    return history.join(samples.select(*keys, ts), [*keys, ts], "left_anti").unionByName(samples, allowMissingColumns=True)


def clear_samples(history: DataFrame, points: DataFrame, keys: Sequence[str], start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """history without the samples of these points from start up to end, or all of them."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(ts) >= F.lit(start).cast(history.schema[ts].dataType))
    if end is not None:
        inside = inside & (F.col(ts) < F.lit(end).cast(history.schema[ts].dataType))
    marked = history.join(points.select(*keys).distinct().withColumn("__gone", F.lit(True)), list(keys), "left")
    return marked.where(F.col("__gone").isNull() | ~inside).drop("__gone")
