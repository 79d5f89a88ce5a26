"""Queries of usage and quality statistics, synchronisation, ontology, sources, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagweave.functions.filters import apply_filter
from tagweave.operators import ontology, series, usage
from tagweave.plans.registry import query, table
from tagweave.sources import html, readers
from tagweave.sources.zinc import read_zinc, write_zinc
from tagweave.streaming import rules


@query("daily_stats", "SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(DISTINCT event_type) AS unique_tools, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def daily_stats(spark, d):
    return usage.daily_statistics(table(spark, d, "events"), "ts", "event_type", "user_id")


@query("usage_stats", "SELECT event_type, count(*) AS calls, round(avg(value), 4) AS avg_duration, count(*) FILTER (value > 100) AS errors, round(100.0 * count(*) FILTER (value > 100) / count(*), 4) AS error_percent FROM events GROUP BY 1")
def usage_stats(spark, d):
    return usage.tool_usage(table(spark, d, "events"), "event_type", "value", F.col("value") > 100)


@query("top_queries", "SELECT lower(trim(text)) AS query, count(*) AS n FROM conversations WHERE role = 'user' AND lower(trim(text)) <> '' GROUP BY 1 ORDER BY n DESC, query LIMIT 20")
def top_queries(spark, d):
    return usage.top_queries(table(spark, d, "conversations").where("role = 'user'"), "text", 20)


@query("zero_results", "SELECT lower(trim(text)) AS query FROM conversations GROUP BY 1 HAVING max(turn) = 0")
def zero_results(spark, d):
    return usage.zero_results(table(spark, d, "conversations"), "text", F.col("turn"))


@query("active_sessions", "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60")
def active_sessions(spark, d):
    e = table(spark, d, "events").withColumn("action", F.when(F.col("event_type") == "signup", "start").when((F.col("event_type") == "purchase") & (F.col("value") > 60), "end"))
    return usage.active_sessions(e, "user_id", "action", "start", "end")


@query("retention", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20' GROUP BY 1")
def retention(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return usage.retained(days, "day", "2024-01-30", 10)


@query("quality_dashboard", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad, CAST(floor(100.0 * count(*) FILTER (quality = 1) / count(*) + 0.5) AS BIGINT) AS good_percent, CAST(floor(avg(n_chars) + 0.5) AS BIGINT) AS avg_size, max(n_chars) AS max_size FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def quality_dashboard(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return usage.quality_dashboard(joined, ["lang"], "n_chars", F.col("quality") == 1, F.col("toxic") == 1)


@query("keyword_frequency", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def keyword_frequency(spark, d):
    return usage.keyword_frequency(table(spark, d, "part"), F.split("p_type", " "), 20)


@query("category_stats", "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS cost FROM part GROUP BY 1")
def category_stats(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("cost"))


@query("unused_functions", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08 AND l_quantity > 30)")
def unused_functions(spark, d):
    used = table(spark, d, "lineitem").where("l_discount > 0.08 AND l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


_SYNC = "a AS (SELECT o_orderkey, o_orderdate AS mod FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'), b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS mod FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01')"


def _snapshots(spark, d):
    """What is stored, without the last year's orders, and what comes in, without the first
    half year's and with urgent ones moved. Every order is in one of them."""
    o = table(spark, d, "orders")
    moved = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    old = o.where("o_orderdate < TIMESTAMP_NTZ '2001-01-01'").select("o_orderkey", F.col("o_orderdate").alias("mod"))
    return old, o.where("o_orderdate >= TIMESTAMP_NTZ '1995-07-01'").select("o_orderkey", moved.alias("mod"))


@query("sync_classification", f"WITH {_SYNC} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.mod = b.mod THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def sync_classification(spark, d):
    return usage.classify_changes(*_snapshots(spark, d), "o_orderkey", "mod")


@query("sync_upsert", f"WITH {_SYNC} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.mod, a.mod) AS mod FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def sync_upsert(spark, d):
    return usage.merge_upsert(*_snapshots(spark, d), "o_orderkey")


@query("keep_last_n_versions", "SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 4")
def keep_last_n_versions(spark, d):
    return usage.newest_versions(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "version")


@query("name_typos", "SELECT a.n_name || 'X' AS name, a.n_name AS suggestion, 1 AS distance FROM nation a")
def name_typos(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return usage.suggestions(n.select(F.concat("name", F.lit("X")).alias("name")), n, 1, 1)


# --- ontology ---

DEFS = [
    ontology.Def("marker"), ontology.Def("val"), ontology.Def("number", ("val",)), ontology.Def("entity", ("marker",)),
    ontology.Def("place", ("entity",)), ontology.Def("region", ("place",), mandatory=True), ontology.Def("nation", ("place",), mandatory=True),
    ontology.Def("party", ("entity",)), ontology.Def("customer", ("party",), mandatory=True), ontology.Def("building", ("marker",)),
    ontology.Def("building-customer", ("customer",)), ontology.Def("balance", ("number",), tag_on=("customer",), mandatory=True),
]


@query("ontology_closure", "WITH e AS (SELECT 'c' || c_custkey AS name, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), s AS (SELECT name FROM e UNION SELECT parent FROM e) SELECT name, name AS ancestor FROM s UNION ALL SELECT name, parent FROM e UNION ALL SELECT a.name, b.parent FROM e a JOIN e b ON a.parent = b.name")
def ontology_closure(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return ontology.closure_of(c.unionByName(n), "name", "parent")


def _tagged_customers(spark, d):
    seg = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("customer"), F.lit("building"), F.lit("balance"))).otherwise(F.array(F.lit("customer")))
    return table(spark, d, "customer").select("c_custkey", seg.alias("tags"))


@query("ontology_reflect", "SELECT c_custkey, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['customer', 'party', 'entity', 'marker', 'building', 'building-customer', 'balance', 'number', 'val'] ELSE ['customer', 'party', 'entity', 'marker'] END) AS def FROM customer")
def ontology_reflect(spark, d):
    return ontology.Namespace.build(DEFS).reflect_records(_tagged_customers(spark, d), "c_custkey", "tags")


@query("ontology_validate", "SELECT c_custkey, 'customer' AS def, 'balance' AS missing FROM customer WHERE c_mktsegment <> 'BUILDING'")
def ontology_validate(spark, d):
    found = ontology.Namespace.build(DEFS).validate_records(_tagged_customers(spark, d), "c_custkey", "tags")
    return found.where("def = 'customer'")


@query("ontology_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def ontology_filter(spark, d):
    """^party in a filter: any tag that is a party, here the marker of a building customer."""
    c = table(spark, d, "customer").withColumn("customer", F.when(F.col("c_mktsegment") == "BUILDING", True))
    return apply_filter(c, "^party and c_acctbal > 0", ontology.Namespace.build(DEFS).model()).select("c_custkey")


@query("ontology_related", "SELECT 'c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 2")
def ontology_related(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("ref"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("ref"))
    return ontology.related(c.unionByName(n), "id", "ref", "r2")


@query("relational_division", "SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def relational_division(spark, d):
    return ontology.divide(table(spark, d, "events"), "user_id", "event_type", ["click", "view", "purchase"])


# --- sources ---


@query("zinc_round_trip", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def zinc_round_trip(spark, d):
    text = write_zinc(readers.to_grid(table(spark, d, "nation")))
    return readers.infer_frame(spark, read_zinc(text))


@query("trio_records", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def trio_records(spark, d):
    """Records written as Trio where they lie, parsed back, and typed."""
    lines = readers.write_text(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "trio")
    parsed = readers.parse_texts(lines.withColumn("path", F.lit("supplier")), "trio")
    return parsed.select(readers.tag("record", "s_suppkey", "long").alias("s_suppkey"), readers.tag("record", "s_name", "string").alias("s_name"), readers.tag("record", "s_acctbal", "double").alias("s_acctbal"))


@query("export_json_rows", "SELECT 'regions' AS section, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS text FROM region")
def export_json_rows(spark, d):
    return usage.export_json(regions=table(spark, d, "region"))


@query("html_sections", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h[1-3][ >]')) AS BIGINT) AS sections, CAST(len(regexp_extract_all(regexp_extract(html, '(?is)(<h[1-3][ >].*)$', 1), '(?i)<p[ >]')) AS BIGINT) AS paragraphs FROM pages WHERE regexp_matches(html, '(?i)<h[1-3][ >]')")
def html_sections(spark, d):
    found = html.sections(table(spark, d, "pages"), "page_id", "html")
    return found.groupBy("page_id").agg(F.count("*").alias("sections"), F.sum("paragraphs").alias("paragraphs"))


@query("html_headings", "SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS raw FROM pages WHERE regexp_matches(html, '(?is)<h1[^>]*>(.*?)</h1>')")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("raw")).where(F.col("raw") != "")


# --- streams: a stream over the whole table gives the batch answer ---


def _folder(spark):
    from tagweave.functions.lineage import shared_folder

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"


@query("stream_daily_counters", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counters(spark, d):
    events = rules.read_table_stream(spark, f"{d}/events.parquet")
    return rules.drain(rules.daily_counters(events, "event_type"), "complete", _folder(spark))


@query("stream_streaks", """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM events),
 r AS (SELECT user_id, event_type, k, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT user_id, max(n) AS longest FROM r GROUP BY 1""")
def stream_streaks(spark, d):
    events = rules.read_table_stream(spark, f"{d}/events.parquet")
    shown = rules.drain(rules.streaks(events, "user_id", "event_type"), "update", _folder(spark))
    return shown.groupBy("user_id").agg(F.max("longest").alias("longest"))


@query("stream_sessions", "WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, count(*) AS n, round(max(value), 4) AS peak FROM g GROUP BY user_id, k")
def stream_sessions(spark, d):
    """The same sessions as the batch form with its 2-hour gap."""
    events = rules.read_table_stream(spark, f"{d}/events.parquet")
    return rules.drain(rules.stream_sessions(events, "user_id", "2 hours", "value"), "complete", _folder(spark)).select("user_id", "n", "peak")


@query("current_rule", "SELECT user_id, arg_max(value, ts) > 50 AS output FROM events GROUP BY 1")
def current_rule(spark, d):
    """A current-value rule on one batch: is the newest value high?"""
    return rules.current_values(table(spark, d, "events"), "user_id", F.col("value") > 50).select("user_id", "output")


@query("spark_rule", "SELECT user_id, count(*) AS n FROM (WITH s AS (SELECT user_id, ts, event_id, event_type = 'error' AS on_, coalesce(lead(ts) OVER w, ts) AS nxt, lag(event_type = 'error') OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM on_ THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, k, epoch_us(max(nxt)) - epoch_us(min(ts)) AS us FROM i WHERE on_ GROUP BY 1, 2) WHERE us >= 36000000000 GROUP BY 1")
def spark_rule(spark, d):
    """A fault rule: errors that last ten hours, per target."""
    runs = series.periods(table(spark, d, "events"), ["user_id"], F.col("event_type") == "error", order=["event_id"])
    return series.lasting(runs, 36000).groupBy("user_id").agg(F.count("*").alias("n"))
