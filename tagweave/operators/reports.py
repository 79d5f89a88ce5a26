"""Report templates as functions of tables and parameters.

Each takes tables in the logical schemas (history, point, equip, site) or generic
columns and returns a table; ladders of severities and statuses are ordered rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators import series


def ladder(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def issue_text(rules: Sequence[tuple[Column, str]], separator: str = "; ") -> Column:
    """All issues that hold, joined; an empty text if none does."""
    return F.concat_ws(separator, *(F.when(test, name) for test, name in rules))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is not positive."""
    return F.when(b > 0, a / b)


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, 100.0 * a / b)


def year_over_year(monthly: DataFrame, year: str, month: str, value: str, this: int) -> DataFrame:
    """Months of a year beside the year before, with percent, status and a TOTAL row."""
    picked = monthly.where(F.col(year).isin(this, this - 1))
    wide = picked.groupBy(month).agg(
        F.sum(F.when(F.col(year) == this, F.col(value))).alias("current"),
        F.sum(F.when(F.col(year) == this - 1, F.col(value))).alias("previous"),
    )
    both = wide.where("current IS NOT NULL AND previous IS NOT NULL")
    totals = both.agg(F.lit("TOTAL").alias("period"), F.sum("current").alias("current"), F.sum("previous").alias("previous"))
    rows = both.select(F.col(month).cast("string").alias("period"), "current", "previous").unionByName(totals)
    variance = F.col("current") - F.col("previous")
    change = percent(variance, F.col("previous"))
    return rows.select(
        "period", F.round("current", 2).alias("current"), F.round("previous", 2).alias("previous"),
        F.round(variance, 2).alias("variance"), F.round(change, 4).alias("percent"),
        ladder([(change > 5, "above"), (change < -5, "below")], "steady").alias("status"),
    )


def budget_tracking(daily: DataFrame, day: str, value: str, monthly_budget: float, as_of: str) -> DataFrame:
    """Per month: actual, budget, variance, percent, status; the month of as_of is
    forecast to its end at its daily average."""
    until = daily.where(F.col(day) <= F.lit(as_of).cast("date"))
    months = until.groupBy(F.trunc(day, "month").alias("month")).agg(F.sum(value).alias("actual"), F.count_distinct(day).alias("days"))
    last = F.dayofmonth(F.last_day("month"))
    open_ = F.col("month") == F.trunc(F.lit(as_of).cast("date"), "month")
    remaining = F.when(open_, last - F.dayofmonth(F.lit(as_of).cast("date"))).otherwise(0)
    forecast = F.col("actual") + F.col("actual") / F.col("days") * remaining
    return months.select(
        "month", F.round("actual", 2).alias("actual"), F.lit(monthly_budget).alias("budget"),
        F.round(F.col("actual") - monthly_budget, 2).alias("variance"), F.round(100.0 * F.col("actual") / monthly_budget, 4).alias("percent"),
        F.round(forecast, 2).alias("forecast"), ladder([(forecast > 1.1 * monthly_budget, "over"), (forecast > monthly_budget, "watch")], "within").alias("status"),
    )


def cost_with_demand(daily: DataFrame, keys: Sequence[str], value: str, rate: float, demand_rate: float) -> DataFrame:
    """Energy cost and demand charge on the largest day."""
    energy = F.sum(value) * rate
    demand = F.max(value) * demand_rate
    return daily.groupBy(*keys).agg(
        F.round(energy, 2).alias("energy_cost"), F.round(demand, 2).alias("demand_cost"), F.round(energy + demand, 2).alias("total_cost"),
        F.round(F.try_divide(energy + demand, F.sum(value)), 6).alias("blended_rate"),
    )


def efficiency(daily: DataFrame, keys: Sequence[str], value: str, area: str) -> DataFrame:
    """Energy use intensity and load factor (mean over peak)."""
    return daily.groupBy(*keys).agg(
        F.round(ratio(F.sum(value), F.first(area)), 4).alias("eui"), F.round(ratio(F.avg(value), F.max(value)), 4).alias("load_factor")
    )


def normalized(daily: DataFrame, weather: DataFrame, day: str, value: str, mean: str, base: float) -> DataFrame:
    """Value per degree day; null on days without any."""
    joined = daily.join(weather, day)
    degree = F.abs(F.col(mean) - base)
    return joined.select(day, F.round(value, 4).alias(value), F.round(degree, 4).alias("degree_days"), F.round(ratio(F.col(value), degree), 4).alias("per_degree_day"))


def comfort(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, sample_hours: float = 0.25) -> DataFrame:
    """Samples below, inside and above a band."""
    below, above = F.count_if(F.col(value) < low), F.count_if(F.col(value) > high)
    n = F.count(value)
    inside = n - below - above
    return df.groupBy(*keys).agg(
        n.alias("n"), below.alias("below"), inside.alias("inside"), above.alias("above"), F.round(percent(inside, n), 4).alias("compliance"),
        F.round((below + above) * sample_hours, 4).alias("hours_outside"),
    )


def comfort_violations(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, order: Sequence[str]) -> DataFrame:
    """Runs of consecutive samples outside the band, longest first."""
    return series.periods(df, keys, ~F.col(value).between(low, high), order=order)


def binned(df: DataFrame, by: Column, value: str, low: float, high: float) -> DataFrame:
    """Averages where `by` is cold, mild or hot."""
    return df.agg(
        F.round(F.avg(F.when(by < low, F.col(value))), 4).alias("cold"), F.round(F.avg(F.when(by.between(low, high), F.col(value))), 4).alias("mild"),
        F.round(F.avg(F.when(by > high, F.col(value))), 4).alias("hot"),
    )


def confusion(a: DataFrame, b: DataFrame, slots: DataFrame, on: str) -> DataFrame:
    """Slots in which a and b hold: both, only a (missed), only b (unnecessary), neither."""
    x = a.select(on).distinct().withColumn("__a", F.lit(1))
    y = b.select(on).distinct().withColumn("__b", F.lit(1))
    j = slots.select(on).distinct().join(x, on, "left").join(y, on, "left")
    both = F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    missed = F.count_if(F.col("__a").isNotNull() & F.col("__b").isNull())
    return j.agg(
        both.alias("used"), missed.alias("missed"), F.count_if(F.col("__a").isNull() & F.col("__b").isNotNull()).alias("unnecessary"),
        F.count_if(F.col("__a").isNull() & F.col("__b").isNull()).alias("neither"), F.round(percent(both, both + missed), 4).alias("utilisation"),
    )


def ventilation(readings: DataFrame, occupied: DataFrame, on: Sequence[str], flow: Column, required: float) -> DataFrame:
    """Share of occupied samples whose outdoor flow is enough."""
    during = readings.join(occupied.select(*on).distinct(), list(on), "left_semi")
    ok = F.count_if(flow >= required)
    return during.agg(F.count("*").alias("n"), ok.alias("compliant"), F.round(percent(ok, F.count("*")), 4).alias("compliance"), F.round(F.min(flow), 4).alias("least_flow"))


def chiller(df: DataFrame, keys: Sequence[str], kw: Column, tons: Column, delta: Column) -> DataFrame:
    """Efficiency in kW per ton, coefficient of performance and temperature difference."""
    per_ton = ratio(F.sum(kw), F.sum(tons))
    return df.groupBy(*keys).agg(F.round(per_ton, 4).alias("kw_per_ton"), F.round(3.517 / per_ton, 4).alias("cop"), F.round(F.avg(delta), 4).alias("avg_delta"))


def sensor_health(df: DataFrame, keys: Sequence[str], value: str, state: str, order: Sequence[str], stuck: int = 4, outlier_percent: float = 1.0) -> DataFrame:
    """Stuck streak, outlier share and flat line of every point, with issues and status."""
    streak = series.longest_streak(df, keys, state, order)
    far = series.outliers(df, keys, value).select(*keys, "percent")
    flat = df.groupBy(*keys).agg(series.flat_line(value).alias("flat"))
    joined = streak.join(far, list(keys)).join(flat, list(keys))
    rules = [(F.col("longest") >= stuck, "stuck"), (F.col("percent") > outlier_percent, "outliers"), (F.col("flat"), "flat line")]
    count = sum((test.cast("int") for test, _ in rules[1:]), rules[0][0].cast("int"))
    return joined.select(*keys, "longest", "percent", issue_text(rules).alias("issues"), ladder([(count >= 2, "failed"), (count == 1, "suspect")], "ok").alias("status"))


def device_rollup(faults: DataFrame, device: str, severity: str, coverage: str) -> DataFrame:
    """Point faults by device: totals, critical ones, mean coverage and a status."""
    critical = F.count_if(F.col(severity) == "critical")
    n = F.count("*")
    return faults.groupBy(device).agg(
        n.alias("points"), critical.alias("critical"), F.round(F.avg(coverage), 4).alias("avg_coverage"),
        ladder([(critical * 2 > n, "offline"), (critical > 0, "degraded")], "online").alias("status"),
    )


def score_band(value: Column, good: float, fair: float, poor: float, higher_is_better: bool = True) -> Column:
    """25, 20, 10 or 5 points."""
    meets = (lambda x: value >= x) if higher_is_better else (lambda x: value <= x)
    return F.when(meets(good), 25).when(meets(fair), 20).when(meets(poor), 10).otherwise(5)


def rating(score: Column) -> Column:
    return ladder([(score >= 90, "excellent"), (score >= 75, "good"), (score >= 60, "fair")], "poor")


def status_snapshot(df: DataFrame, keys: Sequence[str], role: str, roles: Sequence[str], value: str, ts: str, tie: str) -> DataFrame:
    """Latest value of each role, one column per role."""
    at = F.struct(ts, tie)
    return df.groupBy(*keys).agg(*(F.max_by(F.when(F.col(role) == r, F.col(value)), F.when(F.col(role) == r, at)).alias(r) for r in roles))


def role_performance(df: DataFrame, keys: Sequence[str], role: str, roles: Sequence[str], value: str) -> DataFrame:
    """Mean, least and most of each role, in one pass."""
    out = []
    for r in roles:
        v = F.when(F.col(role) == r, F.col(value))
        out += [F.round(F.avg(v), 4).alias(f"{r}_avg"), F.round(F.min(v), 4).alias(f"{r}_min"), F.round(F.max(v), 4).alias(f"{r}_max")]
    return df.groupBy(*keys).agg(*out)


def inventory(equips: DataFrame, points: DataFrame, key: str, role: str, roles: Sequence[str]) -> DataFrame:
    """Number of points of each role by equip, those without points included."""
    counts = points.groupBy(key).agg(F.count("*").alias("points"), *(F.count_if(F.col(role) == r).alias(r) for r in roles))
    joined = equips.join(counts, key, "left")
    return joined.select(*equips.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ["points", *roles]))


def schedule_violations(df: DataFrame, keys: Sequence[str], value: str, limit: float, open_hour: int, close_hour: int) -> DataFrame:
    """Hours with a mean above the limit outside the schedule."""
    hourly = df.groupBy(*keys, F.date_trunc("hour", "ts").alias("bucket")).agg(F.avg(value).alias("mean"))
    outside = ~F.hour("bucket").between(open_hour, close_hour - 1)
    return hourly.where((F.col("mean") > limit) & outside).select(*keys, "bucket", F.round("mean", 4).alias("mean"))


def export_points(points: DataFrame, history: DataFrame, key: str, kind: Column) -> DataFrame:
    """Long format: every sample with its point's metadata."""
    return history.join(points, key).withColumn("point_type", kind)
