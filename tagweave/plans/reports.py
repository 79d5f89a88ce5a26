"""Queries over joins, aggregates and report templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import grid, reports, series
from tagweave.plans.registry import query, table


def _daily(spark, d):
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"))


@query(
    "yoy_monthly",
    """WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2),
       w AS (SELECT CAST(m AS VARCHAR) AS period, sum(CASE WHEN y = 1997 THEN v END) AS current, sum(CASE WHEN y = 1996 THEN v END) AS previous FROM m GROUP BY m),
       b AS (SELECT * FROM w WHERE current IS NOT NULL AND previous IS NOT NULL), r AS (SELECT * FROM b UNION ALL SELECT 'TOTAL', sum(current), sum(previous) FROM b)
       SELECT period, round(current, 2) AS current, round(previous, 2) AS previous, round(current - previous, 2) AS variance, round(100.0 * (current - previous) / previous, 4) AS percent,
              CASE WHEN 100.0 * (current - previous) / previous > 5 THEN 'above' WHEN 100.0 * (current - previous) / previous < -5 THEN 'below' ELSE 'steady' END AS status FROM r""",
)
def yoy_monthly(spark, d):
    monthly = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    return reports.year_over_year(monthly, "y", "m", "v", 1997)


@query(
    "budget_variance",
    """WITH daily AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY 1), m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, sum(qty) AS actual, count(DISTINCT day) AS days FROM daily WHERE day <= DATE '1997-06-10' GROUP BY 1),
       f AS (SELECT *, actual + actual / days * CASE WHEN month = DATE '1997-06-01' THEN 20 ELSE 0 END AS fc FROM m)
       SELECT month, round(actual, 2) AS actual, CAST(18000.0 AS DOUBLE) AS budget, round(actual - 18000.0, 2) AS variance, round(100.0 * actual / 18000.0, 4) AS percent, round(fc, 2) AS forecast,
              CASE WHEN fc > 1.1 * 18000.0 THEN 'over' WHEN fc > 18000.0 THEN 'watch' ELSE 'within' END AS status FROM f""",
)
def budget_variance(spark, d):
    return reports.budget_tracking(_daily(spark, d), "day", "qty", 18000.0, "1997-06-10")


@query(
    "cost_demand",
    """WITH daily AS (SELECT year(l_shipdate) AS y, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
       SELECT CAST(y AS INTEGER) AS y, round(sum(qty) * 0.12, 2) AS energy_cost, round(max(qty) * 9.5, 2) AS demand_cost, round(sum(qty) * 0.12 + max(qty) * 9.5, 2) AS total_cost, round((sum(qty) * 0.12 + max(qty) * 9.5) / sum(qty), 6) AS blended_rate FROM daily GROUP BY 1""",
)
def cost_demand(spark, d):
    daily = _daily(spark, d).withColumn("y", F.year("day"))
    return reports.cost_with_demand(daily, ["y"], "qty", 0.12, 9.5)


@query("efficiency_metrics", "WITH daily AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) SELECT CAST(year(day) AS INTEGER) AS y, round(sum(qty) / 5000.0, 4) AS eui, round(avg(qty) / max(qty), 4) AS load_factor FROM daily GROUP BY 1")
def efficiency_metrics(spark, d):
    return reports.efficiency(_daily(spark, d).withColumns({"y": F.year("day"), "area": F.lit(5000.0)}), ["y"], "qty", "area")


@query(
    "weather_normalized",
    """WITH w AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean FROM events GROUP BY 1), u AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS qty FROM events WHERE event_type = 'purchase' GROUP BY 1)
       SELECT day, round(qty, 4) AS qty, round(abs(mean - 50), 4) AS degree_days, round(CASE WHEN abs(mean - 50) > 0 THEN qty / abs(mean - 50) END, 4) AS per_degree_day FROM u JOIN w USING (day)""",
)
def weather_normalized(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return reports.normalized(e.where("event_type = 'purchase'").groupBy("day").agg(F.sum("value").alias("qty")), e.groupBy("day").agg(F.avg("value").alias("mean")), "day", "qty", "mean", 50)


@query("comfort_band", "SELECT user_id, count(value) AS n, count(*) FILTER (value < 20) AS below, count(*) FILTER (value BETWEEN 20 AND 80) AS inside, count(*) FILTER (value > 80) AS above, round(100.0 * count(*) FILTER (value BETWEEN 20 AND 80) / count(value), 4) AS compliance, round(count(*) FILTER (value NOT BETWEEN 20 AND 80) * CAST(0.25 AS DOUBLE), 4) AS hours_outside FROM events GROUP BY 1")
def comfort_band(spark, d):
    return reports.comfort(table(spark, d, "events"), ["user_id"], "value", 20, 80)


@query("comfort_violations", """WITH s AS (SELECT user_id, ts, event_id, value < 20 OR value > 80 AS on_, coalesce(lead(ts) OVER w, ts) AS nxt, lag(value < 20 OR value > 80) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM on_ THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
 SELECT user_id, min(ts) AS "start", max(nxt) AS "end", count(*) AS samples, CAST(epoch_us(max(nxt)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS duration_s FROM i WHERE on_ GROUP BY user_id, k""")
def comfort_violations(spark, d):
    return reports.comfort_violations(table(spark, d, "events"), ["user_id"], "value", 20, 80, ["event_id"])


@query("binned_averages", "SELECT round(avg(l_extendedprice) FILTER (l_quantity < 15), 4) AS cold, round(avg(l_extendedprice) FILTER (l_quantity BETWEEN 15 AND 35), 4) AS mild, round(avg(l_extendedprice) FILTER (l_quantity > 35), 4) AS hot FROM lineitem")
def binned_averages(spark, d):
    return reports.binned(table(spark, d, "lineitem"), F.col("l_quantity"), "l_extendedprice", 15, 35)


@query(
    "confusion_2x2",
    """WITH s AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events), a AS (SELECT DISTINCT date_trunc('hour', ts) AS h, 1 AS a FROM events WHERE event_type = 'click' AND value > 40), b AS (SELECT DISTINCT date_trunc('hour', ts) AS h, 1 AS b FROM events WHERE event_type = 'view' AND value > 40)
       SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS used, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS missed, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS unnecessary, count(*) FILTER (a IS NULL AND b IS NULL) AS neither,
              round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) FILTER (a IS NOT NULL), 4) AS utilisation FROM s LEFT JOIN a USING (h) LEFT JOIN b USING (h)""",
)
def confusion_2x2(spark, d):
    e = table(spark, d, "events").withColumn("h", F.date_trunc("hour", "ts"))
    return reports.confusion(e.where("event_type = 'click' AND value > 40"), e.where("event_type = 'view' AND value > 40"), e, "h")


@query(
    "ventilation_check",
    """WITH o AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup'), r AS (SELECT * FROM events e WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = e.user_id AND o.day = CAST(e.ts AS DATE)))
       SELECT count(*) AS n, count(*) FILTER (value * 0.8 >= 15) AS compliant, round(100.0 * count(*) FILTER (value * 0.8 >= 15) / count(*), 4) AS compliance, round(min(value * 0.8), 4) AS least_flow FROM r""",
)
def ventilation_check(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return reports.ventilation(e, e.where("event_type = 'signup'"), ["user_id", "day"], F.col("value") * 0.8, 15)


@query("chiller_efficiency", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity * 1000), 4) AS kw_per_ton, round(3.517 / (sum(l_extendedprice) / sum(l_quantity * 1000)), 4) AS cop, round(avg(l_tax - l_discount), 4) AS avg_delta FROM lineitem GROUP BY 1")
def chiller_efficiency(spark, d):
    return reports.chiller(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_quantity") * 1000, F.col("l_tax") - F.col("l_discount"))


@query(
    "sensor_health",
    """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
       r AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, event_type, k, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1), m AS (SELECT user_id, avg(value) AS a, stddev_pop(value) AS sd, (max(value) - min(value)) < 0.01 * avg(value) AS flat FROM events GROUP BY 1),
       p AS (SELECT user_id, any_value(flat) AS flat, round(100.0 * count(*) FILTER (abs(value - a) > 3 * sd) / count(*), 4) AS percent FROM events JOIN m USING (user_id) GROUP BY 1)
       SELECT user_id, longest, percent, concat_ws('; ', CASE WHEN longest >= 4 THEN 'stuck' END, CASE WHEN percent > 1 THEN 'outliers' END, CASE WHEN flat THEN 'flat line' END) AS issues,
              CASE WHEN (longest >= 4)::INT + (percent > 1)::INT + flat::INT >= 2 THEN 'failed' WHEN (longest >= 4)::INT + (percent > 1)::INT + flat::INT = 1 THEN 'suspect' ELSE 'ok' END AS status FROM r JOIN p USING (user_id)""",
)
def sensor_health(spark, d):
    return reports.sensor_health(table(spark, d, "events"), ["user_id"], "value", "event_type", ["ts", "event_id"])


_SEVERITY = "CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 1000 THEN 'warning' ELSE 'ok' END"


@query(
    "device_severity",
    "SELECT c_nationkey, count(*) AS points, count(*) FILTER (" + _SEVERITY + " = 'critical') AS critical, round(avg(c_acctbal), 4) AS avg_coverage, CASE WHEN count(*) FILTER (c_acctbal < 0) * 2 > count(*) THEN 'offline' WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'degraded' ELSE 'online' END AS status FROM customer GROUP BY 1",
)
def device_severity(spark, d):
    bal = F.col("c_acctbal")
    faults = table(spark, d, "customer").withColumn("severity", reports.ladder([(bal < 0, "critical"), (bal < 1000, "warning")], "ok"))
    return reports.device_rollup(faults, "c_nationkey", "severity", "c_acctbal")


@query(
    "kpi_scorecard",
    """WITH k AS (SELECT r_name, avg(c_acctbal) AS bal, count(*) AS n, 100.0 * count(*) FILTER (c_acctbal < 0) / count(*) AS bad, 100.0 * count(*) FILTER (c_mktsegment = 'BUILDING') / count(*) AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
       s AS (SELECT r_name, CASE WHEN bal >= 4600 THEN 25 WHEN bal >= 4400 THEN 20 WHEN bal >= 4000 THEN 10 ELSE 5 END + CASE WHEN n >= 310 THEN 25 WHEN n >= 290 THEN 20 WHEN n >= 250 THEN 10 ELSE 5 END + CASE WHEN bad <= 8 THEN 25 WHEN bad <= 10 THEN 20 WHEN bad <= 15 THEN 10 ELSE 5 END + CASE WHEN seg >= 22 THEN 25 WHEN seg >= 19 THEN 20 WHEN seg >= 15 THEN 10 ELSE 5 END AS score FROM k)
       SELECT r_name, CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS rating FROM s""",
)
def kpi_scorecard(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.count("*")
    k = c.groupBy("r_name").agg(F.avg("c_acctbal").alias("bal"), n.alias("n"), (100.0 * F.count_if(F.col("c_acctbal") < 0) / n).alias("bad"), (100.0 * F.count_if(F.col("c_mktsegment") == "BUILDING") / n).alias("seg"))
    score = reports.score_band(F.col("bal"), 4600, 4400, 4000) + reports.score_band(F.col("n"), 310, 290, 250) + reports.score_band(F.col("bad"), 8, 10, 15, False) + reports.score_band(F.col("seg"), 22, 19, 15)
    return k.select("r_name", score.alias("score"), reports.rating(score).alias("rating"))


@query("semi_active_users", "SELECT DISTINCT user_id FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value > 200)")
def semi_active_users(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id").distinct().join(e.where("event_type = 'purchase' AND value > 200").select("user_id"), "user_id", "left_semi")


@query("anti_never_purchased", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_never_purchased(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("hydrate_topn", "SELECT p_partkey, p_name, round(revenue, 2) AS revenue FROM (SELECT l_partkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_partkey LIMIT 20) JOIN part ON l_partkey = p_partkey")
def hydrate_topn(spark, d):
    top = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")).orderBy(F.desc("revenue"), "l_partkey").limit(20)
    return table(spark, d, "part").join(F.broadcast(top), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", F.round("revenue", 2).alias("revenue"))


@query("equip_points", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 45)")
def equip_points(spark, d):
    equips = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(equips, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("equip_inventory", "SELECT c_custkey, count(o_orderkey) AS points, count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def equip_inventory(spark, d):
    points = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return reports.inventory(table(spark, d, "customer").select("c_custkey"), points, "c_custkey", "o_orderstatus", ["O", "F"])


@query("status_snapshot", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def status_snapshot(spark, d):
    return reports.status_snapshot(table(spark, d, "events"), ["user_id"], "event_type", ["click", "view"], "value", "ts", "event_id")


@query("role_performance", "SELECT user_id, round(avg(value) FILTER (event_type = 'error'), 4) AS error_avg, round(min(value) FILTER (event_type = 'error'), 4) AS error_min, round(max(value) FILTER (event_type = 'error'), 4) AS error_max FROM events GROUP BY 1")
def role_performance(spark, d):
    return reports.role_performance(table(spark, d, "events"), ["user_id"], "event_type", ["error"], "value")


@query("consumption_report", "SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3")
def consumption_report(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name", "n_name", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("schedule_violations", "WITH h AS (SELECT user_id, date_trunc('hour', ts) AS bucket, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT user_id, bucket, round(mean, 4) AS mean FROM h WHERE mean > 60 AND hour(bucket) NOT BETWEEN 8 AND 17")
def schedule_violations(spark, d):
    return reports.schedule_violations(table(spark, d, "events"), ["user_id"], "value", 60, 8, 18)


@query("point_export", "SELECT event_id, user_id, ts, value, c_name AS dis, CASE WHEN event_type IN ('click', 'view') THEN 'sensor' ELSE 'cmd' END AS point_type FROM events JOIN customer ON user_id = c_custkey")
def point_export(spark, d):
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("dis"))
    kind = F.when(F.col("event_type").isin("click", "view"), "sensor").otherwise("cmd")
    return reports.export_points(points, table(spark, d, "events"), "user_id", kind).select("event_id", "user_id", "ts", "value", "dis", "point_type")


@query("static_sensors", "SELECT user_id, count(DISTINCT event_type) AS distinct_states FROM events WHERE value > 150 GROUP BY 1 HAVING count(DISTINCT event_type) < 3")
def static_sensors(spark, d):
    return table(spark, d, "events").where("value > 150").groupBy("user_id").agg(F.count_distinct("event_type").alias("distinct_states")).where("distinct_states < 3")


@query("kpi_rule", "SELECT user_id, round(max(value), 4) AS max_value, round(min(value), 4) AS min_value, round(avg(value), 4) AS avg_value FROM events GROUP BY 1")
def kpi_rule(spark, d):
    return series.rollup(table(spark, d, "events"), ["user_id"], "value", None, ["max", "min", "avg"])


@query(
    "daily_summary",
    """WITH e AS (SELECT CAST(ts AS DATE) AS day, round(sum(value) FILTER (event_type = 'purchase'), 4) AS energy, count(*) FILTER (event_type = 'error') AS faults, round(100.0 * count(*) FILTER (value BETWEEN 20 AND 80) / count(*), 4) AS comfort, count(DISTINCT user_id) AS equipment FROM events GROUP BY 1) SELECT * FROM e""",
)
def daily_summary(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("energy"), F.count_if(F.col("event_type") == "error").alias("faults"),
        F.round(100.0 * F.count_if(F.col("value").between(20, 80)) / F.count("*"), 4).alias("comfort"), F.count_distinct("user_id").alias("equipment"),
    )


@query("zip_positions", "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT o_orderkey, s_suppkey FROM a JOIN b USING (k)")
def zip_positions(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return grid.zip_rows(orders, ["o_orderkey"], table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"])


@query("hybrid_merge", "WITH a AS (SELECT user_id, count(*) AS s FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, 0.5 * count(*) AS s FROM events WHERE event_type = 'view' AND value > 50 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(coalesce(a.s, 0) + coalesce(b.s, 0) AS DOUBLE) AS score FROM a FULL JOIN b ON a.user_id = b.user_id")
def hybrid_merge(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("a"))
    b = e.where("event_type = 'view' AND value > 50").groupBy("user_id").agg((0.5 * F.count("*")).alias("b"))
    return a.join(b, "user_id", "full").select("user_id", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0.0))).alias("score"))


@query("set_operations", "(SELECT user_id FROM events WHERE value > 300 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 100) UNION (SELECT user_id FROM events WHERE value > 400 EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND value > 200)")
def set_operations(spark, d):
    e = table(spark, d, "events")
    u = lambda c: e.where(c).select("user_id")
    return u("value > 300").intersect(u("event_type = 'click' AND value > 100")).union(u("value > 400").subtract(u("event_type = 'view' AND value > 200"))).distinct()
