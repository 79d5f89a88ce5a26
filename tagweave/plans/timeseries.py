"""Queries over event histories: point = user_id, value = value, time = ts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tagweave.functions.filters import apply_filter
from tagweave.functions.scalars import cooling_degrees, heating_degrees
from tagweave.functions.spans import resolve
from tagweave.operators import series
from tagweave.plans.registry import SQL, query, table

SPLIT = "2024-01-16 00:00:00"


@query(
    "flagship_rollup",
    "SELECT user_id, date_trunc('hour', ts) AS bucket, round(avg(value), 4) AS avg_value FROM events WHERE (event_type = 'click' OR event_type = 'view') AND value > 5 GROUP BY 1, 2",
)
def flagship_rollup(spark, d):
    rows = apply_filter(table(spark, d, "events"), '(event_type == "click" or event_type == "view") and value > 5')
    return series.rollup(rows, ["user_id"], "value", "1 hour").orderBy("user_id", "bucket")


@query("rollup_hourly_avg", "SELECT user_id, date_trunc('hour', ts) AS bucket, round(avg(value), 4) AS avg_value FROM events GROUP BY 1, 2")
def rollup_hourly_avg(spark, d):
    return series.rollup(table(spark, d, "events"), ["user_id"], "value", "1 hour")


@query("rollup_15min_max", "SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, round(max(value), 4) AS max_value FROM events GROUP BY 1, 2")
def rollup_15min_max(spark, d):
    return series.rollup(table(spark, d, "events"), ["user_id"], "value", "15 minutes", ["max"])


@query("rollup_monthly_sum", "SELECT date_trunc('month', l_shipdate) AS month, strftime(date_trunc('month', l_shipdate), '%b %Y') AS label, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2")
def rollup_monthly_sum(spark, d):
    months = table(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    return months.select("month", F.date_format("month", "MMM yyyy").alias("label"), "total")


@query("rollup_whole_range", "SELECT user_id, round(avg(value), 4) AS avg_value, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, round(sum(value), 4) AS sum_value, count(value) AS count_value FROM events GROUP BY 1")
def rollup_whole_range(spark, d):
    return series.rollup(table(spark, d, "events"), ["user_id"], "value", None, ["avg", "min", "max", "sum", "count"])


@query("his_read_span", "SELECT event_id, user_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def his_read_span(spark, d):
    week = resolve("lastWeek", datetime(2024, 1, 17, 10))
    return series.span(table(spark, d, "events"), str(week.start), str(week.end)).select("event_id", "user_id", "ts", "value")


_PROFILE = "count(*) AS n, round(avg(value), 4) AS avg, round(max(value), 4) AS max, round(min(value), 4) AS min, round(sum(value), 2) AS sum FROM events GROUP BY 1"


@query("load_profile_hour", "SELECT CAST(hour(ts) AS INTEGER) AS hour, " + _PROFILE)
def load_profile_hour(spark, d):
    return series.profile(table(spark, d, "events"), F.hour("ts"), "hour", "value")


@query("load_profile_dow", "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, " + _PROFILE)
def load_profile_dow(spark, d):
    return series.profile(table(spark, d, "events"), series.monday_weekday(F.col("ts")), "weekday", "value")


@query("load_profile_weekend", "SELECT CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS kind, " + _PROFILE)
def load_profile_weekend(spark, d):
    kind = F.when(series.sunday_weekday(F.col("ts")).isin(1, 7), "weekend").otherwise("weekday")
    return series.profile(table(spark, d, "events"), kind, "kind", "value")


_PERIODS = """WITH s AS (SELECT user_id, ts, event_id, coalesce(value > 60, false) AS on_, coalesce(lead(ts) OVER w, ts) AS nxt, lag(coalesce(value > 60, false)) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM on_ THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s),
 p AS (SELECT user_id, k, min(ts) AS "start", max(nxt) AS "end", count(*) AS samples FROM i WHERE on_ GROUP BY 1, 2)
SELECT user_id, "start", "end", samples, CAST(epoch_us("end") - epoch_us("start") AS DOUBLE) / 1e6 AS duration_s FROM p"""


@query("periods_above", _PERIODS + " WHERE epoch_us(\"end\") - epoch_us(\"start\") >= 3600000000")
def periods_above(spark, d):
    found = series.periods(table(spark, d, "events"), ["user_id"], F.col("value") > 60, order=["event_id"])
    return series.lasting(found, 3600)


@query(
    "sessionize_gap",
    """WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
       SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n, round(max(value), 4) AS max_value, round(avg(value), 4) AS avg_value FROM g GROUP BY user_id, k""",
)
def sessionize_gap(spark, d):
    return series.sessions(table(spark, d, "events"), ["user_id"], 7200, "value", order=["event_id"])


_STREAK = """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT user_id, event_type, k, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT user_id, max(n) AS longest FROM r GROUP BY 1"""


@query("stuck_streak", _STREAK)
def stuck_streak(spark, d):
    return series.longest_streak(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("rate_of_change", "WITH s AS (SELECT user_id, value, lag(value) OVER w AS pv, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 6e7 AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(max(CASE WHEN m > 0 THEN abs(value - pv) / m END), 4) AS max_rate FROM s GROUP BY 1")
def rate_of_change(spark, d):
    return series.rate_of_change(table(spark, d, "events"), ["user_id"], "value", order=["event_id"])


@query(
    "outliers_3sigma",
    """WITH m AS (SELECT event_type, avg(value) AS a, stddev_pop(value) AS s FROM events GROUP BY 1)
       SELECT event_type, count(*) AS n, count(*) FILTER (abs(value - a) > 3 * s) AS n_outliers, round(any_value(a), 4) AS mean, round(any_value(s), 4) AS sd,
              round(100.0 * count(*) FILTER (abs(value - a) > 3 * s) / count(*), 4) AS percent, round(100.0 * count(*) FILTER (abs(value - a) > 3 * s) / count(*), 4) > 5 AS flagged
       FROM events JOIN m USING (event_type) GROUP BY 1""",
)
def outliers_3sigma(spark, d):
    return series.outliers(table(spark, d, "events"), ["event_type"], "value")


@query("flat_line", "SELECT user_id, (max(value) - min(value)) < 0.01 * avg(value) AS flat FROM events GROUP BY 1")
def flat_line(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(series.flat_line("value").alias("flat"))


@query(
    "gaps_found",
    """WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), m AS (SELECT user_id, avg(g) AS a FROM s GROUP BY 1)
       SELECT user_id, count(*) AS n, count(*) FILTER (g > 3 * a) AS n_gaps, round(max(g) / 60, 4) AS longest_min FROM s JOIN m USING (user_id) GROUP BY 1""",
)
def gaps_found(spark, d):
    return series.gaps(table(spark, d, "events"), ["user_id"], order=["event_id"])


@query("coverage_percent", "SELECT user_id, round(100.0 * count(*) / (43200.0 / 60.0), 4) AS coverage FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1")
def coverage_percent(spark, d):
    return series.coverage(table(spark, d, "events"), ["user_id"], "2024-01-01 00:00:00", "2024-01-31 00:00:00", 60.0)


@query(
    "transitions_rate",
    """WITH s AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
       SELECT user_id, count(*) FILTER (event_type <> p) AS transitions, round(count(*) FILTER (event_type <> p) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9), 4) AS per_hour FROM s GROUP BY 1""",
)
def transitions_rate(spark, d):
    return series.transitions(table(spark, d, "events"), ["user_id"], "event_type", order=["event_id"])


@query("runtime_share", "SELECT user_id, round(100.0 * count(*) FILTER (event_type = 'purchase') / count(*), 4) AS percent FROM events GROUP BY 1")
def runtime_share(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(100.0 * F.count_if(F.col("event_type") == "purchase") / F.count("*"), 4).alias("percent"))


_RUNS = _PERIODS.replace("value > 60", "value > 30")


@query("short_cycles", "WITH q AS (" + _RUNS + ") SELECT user_id, count(*) AS runs, count(*) FILTER (duration_s < 21600) AS short_runs, round(100.0 * count(*) FILTER (duration_s < 21600) / count(*), 4) AS short_percent, round(avg(duration_s) / 3600, 4) AS avg_hours, CASE WHEN 100.0 * count(*) FILTER (duration_s < 21600) / count(*) > 50 THEN 'high' WHEN 100.0 * count(*) FILTER (duration_s < 21600) / count(*) > 25 THEN 'medium' ELSE 'low' END AS severity FROM q GROUP BY 1")
def short_cycles(spark, d):
    runs = series.periods(table(spark, d, "events"), ["user_id"], F.col("value") > 30, order=["event_id"])
    short = F.count_if(F.col("duration_s") < 21600)
    percent = 100.0 * short / F.count("*")
    severity = F.when(percent > 50, "high").when(percent > 25, "medium").otherwise("low")
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), short.alias("short_runs"), F.round(percent, 4).alias("short_percent"), F.round(F.avg("duration_s") / 3600, 4).alias("avg_hours"), severity.alias("severity"))


@query("peak_when", "SELECT user_id, max(value) AS peak, (SELECT min(ts) FROM events x WHERE x.user_id = e.user_id AND x.value = max(e.value)) AS peak_ts FROM events e GROUP BY 1")
def peak_when(spark, d):
    return series.peak(table(spark, d, "events"), ["user_id"], "value")


@query(
    "baseline_dow_hour",
    """WITH b AS (SELECT isodow(ts) AS dow, hour(ts) AS h, avg(value) AS a FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2), o AS (SELECT avg(value) AS a FROM events WHERE ts < TIMESTAMP '2024-01-16')
       SELECT event_id, round(coalesce(b.a, o.a), 4) AS baseline, round(CASE WHEN coalesce(b.a, o.a) > 0 THEN 100 * (value - coalesce(b.a, o.a)) / coalesce(b.a, o.a) ELSE 0 END, 4) AS deviation
       FROM events LEFT JOIN b ON isodow(ts) = b.dow AND hour(ts) = b.h CROSS JOIN o WHERE ts >= TIMESTAMP '2024-01-16'""",
)
def baseline_dow_hour(spark, d):
    return series.baseline_deviation(table(spark, d, "events"), SPLIT, "value").select("event_id", "baseline", "deviation")


@query(
    "energy_spikes",
    """WITH b AS (SELECT isodow(ts) AS dow, hour(ts) AS h, avg(value) AS a FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2), o AS (SELECT avg(value) AS a FROM events WHERE ts < TIMESTAMP '2024-01-16'),
       h AS (SELECT event_id, user_id, ts, value FROM events LEFT JOIN b ON isodow(ts) = b.dow AND hour(ts) = b.h CROSS JOIN o WHERE ts >= TIMESTAMP '2024-01-16' AND coalesce(b.a, o.a) > 0 AND round(100 * (value - coalesce(b.a, o.a)) / coalesce(b.a, o.a), 4) > 50),
       s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 7200000000 THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
       SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n, round(max(value), 4) AS max_value, round(avg(value), 4) AS avg_value FROM g GROUP BY user_id, k""",
)
def energy_spikes(spark, d):
    rows = series.baseline_deviation(table(spark, d, "events"), SPLIT, "value").where("deviation > 50")
    return series.sessions(rows, ["user_id"], 7200, "value", order=["event_id"])


@query("degree_days", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, round(greatest(avg(value) - 50, 0), 4) AS cdd, round(greatest(50 - avg(value), 0), 4) AS hdd FROM events GROUP BY 1")
def degree_days(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    return days.select("day", F.round(cooling_degrees(F.col("mean"), 50), 4).alias("cdd"), F.round(heating_degrees(F.col("mean"), 50), 4).alias("hdd"))


@query("previous_row", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value FROM events")
def previous_row(spark, d):
    return series.with_previous(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", "prev_value")


@query("first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def first_last(spark, d):
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query(
    "join_series_hour",
    """WITH a AS (SELECT date_trunc('hour', ts) AS bucket, round(avg(value), 4) AS avg_value FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT date_trunc('hour', ts) AS bucket, round(avg(value), 4) AS avg_value_b FROM events WHERE event_type = 'view' GROUP BY 1)
       SELECT bucket, avg_value, avg_value_b FROM a JOIN b USING (bucket)""",
)
def join_series_hour(spark, d):
    e = table(spark, d, "events")
    a = series.rollup(e.where("event_type = 'click'"), [], "value", "1 hour")
    b = series.rollup(e.where("event_type = 'view'"), [], "value", "1 hour")
    return series.join_series(a, b, [], "bucket")


@query(
    "as_of_last_purchase",
    "SELECT e.event_id, p.value AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def as_of_last_purchase(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return series.as_of(clicks, bought, ["user_id"], "value").select("event_id", "value_as_of")


@query(
    "interpolate_daily",
    """WITH g AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10', INTERVAL 1 DAY)) AS ts FROM (SELECT DISTINCT user_id FROM events)),
       l AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
       SELECT g.user_id, g.ts, l.value FROM g ASOF LEFT JOIN l ON g.user_id = l.user_id AND g.ts >= l.ts""",
)
def interpolate_daily(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return series.interpolate(last, ["user_id"], "value", "1 DAY", "2024-01-05 00:00:00", "2024-01-10 00:00:00").select("user_id", "ts", "value")


# One point holds most of all samples, so its series is cut by days.

_DAY = 86400.0
_HOT = "(SELECT * REPLACE (CASE WHEN user_id % 7 = 0 THEN user_id ELSE -1 END AS user_id) FROM events)"


def _hot(spark, d):
    return table(spark, d, "events").withColumn("user_id", F.when(F.col("user_id") % 7 == 0, F.col("user_id")).otherwise(F.lit(-1).cast("long")))


def _hot_sql(name: str) -> str:
    return SQL[name].replace("FROM events", f"FROM {_HOT}")


@query("hot_periods", _hot_sql("periods_above"))
def hot_periods(spark, d):
    found = series.periods(_hot(spark, d), ["user_id"], F.col("value") > 60, order=["event_id"], slice_s=_DAY)
    return series.lasting(found, 3600)


@query("hot_sessions", _hot_sql("sessionize_gap"))
def hot_sessions(spark, d):
    return series.sessions(_hot(spark, d), ["user_id"], 7200, "value", order=["event_id"], slice_s=_DAY)


@query("hot_streak", _hot_sql("stuck_streak"))
def hot_streak(spark, d):
    return series.longest_streak(_hot(spark, d), ["user_id"], "event_type", ["ts", "event_id"], slice_s=_DAY)


@query("hot_as_of", _hot_sql("as_of_last_purchase"))
def hot_as_of(spark, d):
    e = _hot(spark, d)
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return series.as_of(clicks, bought, ["user_id"], "value", slice_s=_DAY).select("event_id", "value_as_of")
