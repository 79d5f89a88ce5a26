"""Queries of the engine object, templates, and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.engine import Engine
from tagweave.functions import records, scalars
from tagweave.functions.filters import Model
from tagweave.operators import graph, grid, search, series
from tagweave.plans import templates
from tagweave.plans.graphs import nations, places
from tagweave.plans.registry import query, table


def _engine(spark, d):
    nation = table(spark, d, "nation")
    return Engine(spark, {t: table(spark, d, t) for t in ("customer", "orders", "supplier", "nation")}, Model(refs={"c_nationkey": (nation, "n_nationkey"), "s_nationkey": (nation, "n_nationkey")}))


def _history(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("point"), "ts", F.col("value").alias("v0"))


@query("engine_query_select", "SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_acctbal > 1000 ORDER BY c_custkey LIMIT 25")
def engine_query_select(spark, d):
    return _engine(spark, d).query("customer", "c_nationkey->n_regionkey == 1 and c_acctbal > 1000", ["c_custkey", "c_name"], 25, ["c_custkey"])


@query("engine_page_total", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 15 OFFSET 30")
def engine_page_total(spark, d):
    total, rows = _engine(spark, d).page("orders", 'o_orderstatus == "F"', ["o_orderkey"], 30, 15)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"))


@query("engine_read_by_ids", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (1, 3, 5)")
def engine_read_by_ids(spark, d):
    return _engine(spark, d).read_by_ids("supplier", [1, 3, 5], "s_suppkey").select("s_suppkey", "s_name")


@query("engine_record_types", "SELECT 'c_name' AS kind, count(c_name) AS n, ['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_nationkey'] AS tags FROM customer")
def engine_record_types(spark, d):
    return _engine(spark, d).record_types("customer", ["c_name"])


@query("template_demand_peak", "SELECT user_id AS point, max(value) AS peak, (SELECT min(ts) FROM events x WHERE x.user_id = e.user_id AND x.value = max(e.value)) AS peak_ts FROM events e GROUP BY 1")
def template_demand_peak(spark, d):
    return templates.run("demand-peak", {"history": _history(spark, d)})


@query("template_point_history", "SELECT user_id AS point, date_trunc('day', ts) AS bucket, round(max(value), 4) AS max_v0 FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2")
def template_point_history(spark, d):
    return templates.run("point-history", {"history": _history(spark, d)}, start="2024-01-05", end="2024-01-12", interval="1 day", fold="max")


@query(
    "template_comm_loss",
    """WITH h AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-30'), s AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM h), m AS (SELECT user_id, avg(g) AS a FROM s GROUP BY 1),
       r AS (SELECT user_id, count(*) AS n, count(*) FILTER (g > 3 * a) AS n_gaps, round(max(g) / 60, 4) AS longest_min, round(100.0 * count(*) / (40320.0 / 600.0), 4) AS coverage FROM s JOIN m USING (user_id) GROUP BY 1)
       SELECT user_id AS point, n, n_gaps, longest_min, coverage, CASE WHEN coverage < 50 THEN 'critical' WHEN coverage < 90 THEN 'warning' ELSE 'ok' END AS status FROM r""",
)
def template_comm_loss(spark, d):
    return templates.run("comm-loss", {"history": _history(spark, d)}, start="2024-01-02 00:00:00", end="2024-01-30 00:00:00", expectedMinutes=600)


@query("template_zone_comfort", "SELECT user_id AS point, count(value) AS n, count(*) FILTER (value < 30) AS below, count(*) FILTER (value BETWEEN 30 AND 70) AS inside, count(*) FILTER (value > 70) AS above, round(100.0 * count(*) FILTER (value BETWEEN 30 AND 70) / count(value), 4) AS compliance, round(count(*) FILTER (value NOT BETWEEN 30 AND 70) * CAST(0.25 AS DOUBLE), 4) AS hours_outside FROM events GROUP BY 1")
def template_zone_comfort(spark, d):
    return templates.run("zone-comfort", {"history": _history(spark, d)}, low="30", high="70")


@query("zero_readings", """WITH s AS (SELECT user_id, ts, event_id, value < 5 AS on_, coalesce(lead(ts) OVER w, ts) AS nxt, lag(value < 5) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM on_ THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s), p AS (SELECT user_id, k, epoch_us(max(nxt)) - epoch_us(min(ts)) AS us FROM i WHERE on_ GROUP BY 1, 2)
 SELECT user_id, count(*) AS runs, round(sum(us) / 3.6e9, 4) AS hours FROM p GROUP BY 1""")
def zero_readings(spark, d):
    runs = series.periods(table(spark, d, "events"), ["user_id"], F.col("value") < 5, order=["event_id"])
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.round(F.sum("duration_s") / 3600, 4).alias("hours"))


@query("number_format", "SELECT c_custkey, format('{:,.2f}', c_acctbal) || 'kWh' AS shown FROM customer")
def number_format(spark, d):
    return table(spark, d, "customer").select("c_custkey", records.format_number(F.col("c_acctbal"), 2, "kWh").alias("shown"))


@query("local_hours", "SELECT event_id, CAST(hour(ts + INTERVAL 9 HOUR) AS INTEGER) AS hour FROM events")
def local_hours(spark, d):
    return table(spark, d, "events").select("event_id", F.hour(records.local_time(F.col("ts").cast("timestamp"), "Tokyo")).alias("hour"))


@query("calls_extracted", "SELECT page_id, name FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)[ ]*\\(', 1))) AS name FROM (SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', '-', 'g') AS html FROM pages)) WHERE name NOT IN ('if', 'for', 'while', 'switch', 'return', 'catch')")
def calls_extracted(spark, d):
    """Calls in the pages' scripts."""
    bare = F.regexp_replace("html", r"[^\x00-\x7F]", "-")
    return table(spark, d, "pages").select("page_id", F.explode(graph.extract_calls(bare)).alias("name"))


@query("text_of_pages", "SELECT page_id, regexp_matches(html, '(?i)<script') AS scripted FROM pages")
def text_of_pages(spark, d):
    """The text of a page has none of its scripts and tags."""
    pages = table(spark, d, "pages").select("page_id", "html", scalars.strip_html(F.col("html")).alias("shown"))
    clean = ~F.contains("shown", F.lit("track(")) & ~F.col("shown").rlike("</[a-z]")
    return pages.select("page_id", (F.col("html").rlike("(?i)<script") & clean).alias("scripted"))


@query("subgraph_export_json", """WITH n AS (SELECT 'r' || r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1),
 e AS (SELECT 'r1' AS a, 'n' || n_nationkey AS b FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)
 SELECT '{"id":"' || id || '","name":"' || name || '"}' AS text FROM n UNION ALL SELECT '{"source":"' || a || '","target":"' || b || '","type":"contains"}' FROM e""")
def subgraph_export_json(spark, d):
    nodes, edges = places(spark, d)
    return graph.export(*graph.subgraph(nodes, edges, nodes.where("id = 'r1'"), 2), "d3")


@query("find_nodes", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE lower(n_name) LIKE '%tion%'")
def find_nodes(spark, d):
    return graph.find_nodes(nations(spark, d), "TION").select("id", "name")


@query("usage_lookup", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(text, '[Tt]h[ea]')")
def usage_lookup(spark, d):
    """Uses by name whose context fits a pattern."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("functionName"), F.col("text").alias("context"))
    return Engine(spark, {"usage": c}).function_usage("user", context="[Tt]h[ea]").select("conv_id", "turn")


@query("tool_search", "SELECT p_partkey, CAST(CASE WHEN contains(lower(p_name), '7') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_type), '7') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_brand), '7') THEN 3 ELSE 0 END AS DOUBLE) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20")
def tool_search(spark, d):
    score = search.weighted_match("7", {"name": (F.col("p_name"), 10.0), "type": (F.col("p_type"), 5.0), "brand": (F.col("p_brand"), 3.0)})
    return table(spark, d, "part").select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@query("list_edits", "SELECT user_id, list_concat(t[1:1], ['new'], t[2:]) AS inserted, t[2:] AS popped, list_concat(t, ['x']) AS added, len(t) AS n FROM (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY 1)")
def list_edits(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    t = F.col("e.event_type")
    return e.select("user_id", grid.list_insert(t, 1, F.lit("new")).alias("inserted"), grid.list_remove_at(t, 0).alias("popped"), F.array_append(t, F.lit("x")).alias("added"), F.size(t).cast("long").alias("n"))


@query("newer_records", "SELECT count(*) FILTER (a.o_orderdate > b.o_orderdate) AS newer FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def newer_records(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderdate").alias("next"))
    return o.join(b, "o_orderkey").agg(F.count_if(grid.is_newer(F.col("o_orderdate"), F.col("next"))).alias("newer"))
