"""Queries over filters, grids, lists, dicts and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import scalars, units
from tagweave.functions.filters import FilterBuilder, Model, apply_filter
from tagweave.operators import grid, usage
from tagweave.plans.registry import query, table


@query("filter_cmp_and_or", "SELECT event_id, event_type, value FROM events WHERE (event_type = 'click' AND value > 5) OR props IS NULL")
def filter_cmp_and_or(spark, d):
    return apply_filter(table(spark, d, "events"), '(event_type == "click" and value > 5) or not props').select("event_id", "event_type", "value")


@query("filter_has_missing_ne", "SELECT event_id, user_id FROM events WHERE props IS NOT NULL AND event_type <> 'view' AND value <= 20.5 AND user_id >= 10")
def filter_has_missing_ne(spark, d):
    return apply_filter(table(spark, d, "events"), 'props and event_type != "view" and value <= 20.5 and user_id >= 10').select("event_id", "user_id")


@query("filter_kind_mismatch", "SELECT event_id FROM events WHERE FALSE OR event_id < 5")
def filter_kind_mismatch(spark, d):
    """A number is never equal to a string tag; an unknown tag is missing."""
    return apply_filter(table(spark, d, "events"), "event_type == 5 or value == \"5\" or nothing == 1 or event_id < 5").select("event_id")


@query("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
def filter_date_range(spark, d):
    return apply_filter(table(spark, d, "orders"), "o_orderdate >= 1996-01-01T00:00 and o_orderdate < 1996-02-01T00:00").select("o_orderkey")


def _refs(spark, d):
    nation, region, customer = (table(spark, d, t) for t in ("nation", "region", "customer"))
    return Model(refs={"c_nationkey": (nation, "n_nationkey"), "n_regionkey": (region, "r_regionkey"), "o_custkey": (customer, "c_custkey"), "s_nationkey": (nation, "n_nationkey")})


@query(
    "filter_deref_region",
    "SELECT c_custkey, c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def filter_deref_region(spark, d):
    return apply_filter(table(spark, d, "customer"), 'c_nationkey->n_regionkey->r_name == "ASIA"', _refs(spark, d)).select("c_custkey", "c_name")


@query(
    "filter_deref_three_hops",
    "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE (r_name = 'EUROPE' OR r_name = 'ASIA') AND c_acctbal > 0 AND o_totalprice > 200000",
)
def filter_deref_three_hops(spark, d):
    text = '(o_custkey->c_nationkey->n_regionkey->r_name == "EUROPE" or o_custkey->c_nationkey->n_regionkey->r_name == "ASIA") and o_custkey->c_acctbal > 0 and o_totalprice > 200000'
    return apply_filter(table(spark, d, "orders"), text, _refs(spark, d)).select("o_orderkey")


@query("filter_missing_ref", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def filter_missing_ref(spark, d):
    large = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(large, "p_partkey", "left_anti").select("p_partkey")


@query("filter_builder", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY')")
def filter_builder(spark, d):
    text = FilterBuilder().greater("c_acctbal", 5000).and_().opened().equals("c_mktsegment", "BUILDING").or_().equals("c_mktsegment", "MACHINERY").closed().build()
    return apply_filter(table(spark, d, "customer"), text).select("c_custkey")


@query("filter_upward", "WITH RECURSIVE b(id) AS (SELECT 0 UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 0) SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0")
def filter_upward(spark, d):
    """Nations from which region 0 is reached by following `up` again and again."""
    region = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("up"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("up"))
    places = region.unionByName(nation)
    records = table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.lit("r"), F.col("n_regionkey")).alias("up"))
    return apply_filter(records, "up *== @r0", Model(refs={"up": (places, "id")})).select("n_nationkey", "n_name")


@query("filter_units", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49.5 AND l_quantity / 60.0 < 1")
def filter_units(spark, d):
    """A column in minutes against a literal in hours."""
    items = grid.with_column_meta(table(spark, d, "lineitem"), "l_quantity", unit="min")
    return apply_filter(items, "l_quantity < 1h and l_quantity > 49.5min").select("l_orderkey", "l_linenumber")


@query("grid_unique_by", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def grid_unique_by(spark, d):
    return grid.unique_by(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("grid_filter_by_list", "SELECT user_id FROM events GROUP BY user_id HAVING list_contains(list(event_type), 'error')")
def grid_filter_by_list(spark, d):
    users = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return grid.filter_by(users, "types", lambda x: x == "error").select("user_id")


@query("grid_all_any", "SELECT bool_or(value > 400) AS \"any\", bool_and(value > 0) AS \"all\" FROM events")
def grid_all_any(spark, d):
    e = table(spark, d, "events")
    return grid.matches(e, "value > 400").select("any").crossJoin(grid.matches(e, "value > 0").select("all"))


@query("grid_any_all_by", "WITH u AS (SELECT user_id, list(value) v FROM events GROUP BY 1) SELECT bool_or(len(list_filter(v, lambda x: x > 300)) > 0) AS \"any\", bool_and(len(list_filter(v, lambda x: x > 0)) = len(v)) AS \"all\" FROM u")
def grid_any_all_by(spark, d):
    users = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return grid.any_by(users, "v", lambda x: x > 300).crossJoin(grid.all_by(users, "v", lambda x: x > 0))


@query("grid_fold_stats", "SELECT event_type, round(sum(value), 2) AS sum_value, round(min(value), 2) AS min_value, round(max(value), 2) AS max_value, round(avg(value), 2) AS avg_value FROM events GROUP BY 1")
def grid_fold_stats(spark, d):
    return grid.fold(table(spark, d, "events"), "value", ["event_type"], 2)


@query("grid_totals_row", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), round(sum(value), 2) FROM events")
def grid_totals_row(spark, d):
    return grid.with_totals(table(spark, d, "events"), "event_type", {"n": F.count("*"), "total": F.round(F.sum("value"), 2)})


@query("grid_range_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 11")
def grid_range_page(spark, d):
    return grid.row_range(table(spark, d, "orders"), ["o_orderkey"], 11, 20).select("o_orderkey", "o_totalprice")


@query("grid_remove", "SELECT 'kept' AS part, count(*) AS n FROM events WHERE NOT (event_type = 'error' AND value > 50) UNION ALL SELECT 'removed', count(*) FROM events WHERE event_type = 'error' AND value > 50")
def grid_remove(spark, d):
    kept, gone = grid.remove(table(spark, d, "events"), 'event_type == "error" and value > 50')
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).unionByName(gone.agg(F.lit("removed").alias("part"), F.count("*").alias("n")))


@query("grid_find_first", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 100 ORDER BY ts, event_id LIMIT 1")
def grid_find_first(spark, d):
    return grid.find(table(spark, d, "events"), 'event_type == "purchase" and value > 100', ["ts", "event_id"]).select("event_id", "user_id")


@query("grid_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def grid_columns(spark, d):
    return grid.reorder_columns(grid.limit_columns(table(spark, d, "customer"), ["c_mktsegment", "c_acctbal", "c_custkey", "nothing"]), ["c_mktsegment"])


@query("grid_list_by", "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position, c_name FROM customer")
def grid_list_by(spark, d):
    return grid.list_by(table(spark, d, "customer"), "c_name", ["c_acctbal", "c_custkey"])


@query("grid_add_widen", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS DOUBLE) AS bal FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def grid_add_widen(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return grid.add_rows(a, b)


@query("record_types", "SELECT event_type, count(*) AS n, ['k'] AS tags FROM events GROUP BY 1")
def record_types(spark, d):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return grid.record_types(table(spark, d, "events"), "event_type", keys)


@query("schema_counts", "SELECT count(props) AS props, count(value) AS value, count(event_type) AS event_type FROM events")
def schema_counts(spark, d):
    return grid.schema_counts(table(spark, d, "events"), ["props", "value", "event_type"])


@query(
    "list_operators",
    """WITH u AS (SELECT user_id, list(value ORDER BY event_id) v, list(event_type ORDER BY event_id) t FROM events GROUP BY 1)
       SELECT user_id, round(list_sum(v), 2) AS total, round(list_avg(v), 4) AS mean, list_min(v) AS least, list_max(v) AS most,
              list_sort(list_distinct(t)) AS kinds, len(list_filter(v, lambda x: x > 100)) AS large, v[2:3] AS part, array_to_string(t[1:2], '; ') AS joined,
              list_contains(t[3:], 'click') AS later_click FROM u""",
)
def list_operators(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value", "event_type"))).alias("e"))
    u = e.select("user_id", F.col("e.value").alias("v"), F.col("e.event_type").alias("t"))
    return u.select(
        "user_id", F.round(grid.list_sum(F.col("v")), 2).alias("total"), F.round(grid.list_avg(F.col("v")), 4).alias("mean"),
        F.array_min("v").alias("least"), F.array_max("v").alias("most"), grid.list_sort(F.array_distinct("t")).alias("kinds"),
        F.size(F.filter("v", lambda x: x > 100)).cast("long").alias("large"), grid.list_slice(F.col("v"), 1, 2).alias("part"),
        F.array_join(F.slice("t", 1, 2), "; ").alias("joined"), grid.list_includes(F.col("t"), F.lit("click"), 2).alias("later_click"),
    )


@query(
    "dict_diff_orders",
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'),
            b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01')
       SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
              CASE WHEN a.o_orderkey IS NULL THEN 'add' WHEN b.o_orderkey IS NULL THEN 'remove' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice THEN 'same' ELSE 'update' END AS op
       FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def dict_diff_orders(spark, d):
    """Two snapshots: before the last year's orders, and without the first half year's but
    with urgent ones repriced. Every order is in one of them."""
    o = table(spark, d, "orders")
    old = o.where("o_orderdate < TIMESTAMP_NTZ '2001-01-01'")
    new = o.where("o_orderdate >= TIMESTAMP_NTZ '1995-07-01'").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return grid.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("dict_bulk_update", "SELECT c_custkey, c_acctbal < 0 AS changed FROM customer")
def dict_bulk_update(spark, d):
    """Adding a tag that is there already changes nothing."""
    tags = F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("seg"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("ok"), F.lit("yes")))
    return grid.bulk_update(table(spark, d, "customer").withColumn("tags", tags), "c_custkey", "tags", "add", {"ok": "no", "seg": "x"}).select("c_custkey", "changed")


@query("dict_display_macro", "SELECT s_suppkey, 'Supplier ' || s_name || ' in ' || CAST(s_nationkey AS VARCHAR) || ' $unknown' AS dis FROM supplier")
def dict_display_macro(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", grid.expand_macro(F.lit("Supplier $name in ${nation} $unknown"), {"name": F.col("s_name"), "nation": F.col("s_nationkey")}).alias("dis"))


@query("dict_containment", "SELECT c_custkey, n_regionkey AS regionRef FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dict_containment(spark, d):
    parents = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("regionRef"))
    c = table(spark, d, "customer").withColumn("regionRef", F.lit(None).cast("int"))
    return grid.containment_refs(c, parents, "c_nationkey", ["regionRef"]).select("c_custkey", "regionRef")


@query("dict_enum", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'part' END AS status FROM orders")
def dict_enum(spark, d):
    code = F.locate("x", F.translate(F.col("o_orderstatus"), "OFP", "012")).cast("int") + F.translate(F.col("o_orderstatus"), "OFP", "012").cast("int")
    return table(spark, d, "orders").select("o_orderkey", grid.enum_decode(code, ["open", "filled", "part"]).alias("status"))


@query("tag_names", "SELECT p_partkey, lower(substr(regexp_replace(p_name, '[^A-Za-z0-9_]+', ' ', 'g'), 1, 1)) AS head FROM part")
def tag_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring(grid.to_tag_name(F.col("p_name")), 1, 1).alias("head"))


@query("unit_convert", "SELECT event_id, round((value * 5.0 / 9.0 + 459.67 * 5.0 / 9.0 - 273.15), 4) AS celsius FROM events")
def unit_convert(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(units.convert(F.col("value"), "°F", "°C"), 4).alias("celsius"))


@query("unit_convert_rows", "SELECT event_id, round(CASE event_type WHEN 'click' THEN value * 60.0 WHEN 'view' THEN value * 3600.0 WHEN 'error' THEN NULL ELSE value END, 4) AS secs FROM events")
def unit_convert_rows(spark, d):
    u = F.when(F.col("event_type") == "click", "min").when(F.col("event_type") == "view", "h").when(F.col("event_type") == "error", "kWh").otherwise("s")
    return units.convert_rows(table(spark, d, "events").withColumn("u", u), "value", "u", "s", "secs").select("event_id", F.round("secs", 4).alias("secs"))


@query("unit_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) AS kwh FROM lineitem")
def unit_arithmetic(spark, d):
    items = grid.with_column_meta(grid.with_column_meta(table(spark, d, "lineitem"), "l_quantity", unit="kW"), "l_discount", unit="h")
    out = units.arithmetic(items, "l_quantity", "*", "l_discount", "kwh")
    if units.unit_of(out, "kwh") != "kWh":
        raise AssertionError(units.unit_of(out, "kwh"))
    return out.select("l_orderkey", "l_linenumber", F.round("kwh", 4).alias("kwh"))


@query("setpoint_reset", "SELECT event_id, round(CASE WHEN value <= 20 THEN 18.0 WHEN value >= 80 THEN 12.0 ELSE 18.0 + (value - 20) * -0.1 END, 4) AS setpoint FROM events")
def setpoint_reset(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.reset(F.col("value"), 20, 80, 18.0, 12.0), 4).alias("setpoint"))


@query("emission_factors", "SELECT l_returnflag, round(sum(l_quantity) * 0.92 / 2.20462, 2) AS kg, round(sum(l_quantity) * 0.92 / 2204.62, 4) AS metric FROM lineitem GROUP BY 1")
def emission_factors(spark, d):
    total = F.sum("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(scalars.emissions(total, 0.92, "kg"), 2).alias("kg"), F.round(scalars.emissions(total, 0.92, "metric"), 4).alias("metric"))


@query("uri_parts", "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages")
def uri_parts(spark, d):
    parts = scalars.uri_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", parts["protocol"].alias("scheme"), parts["host"].alias("host"))


@query("name_suggestions", "SELECT a.n_name AS name, b.n_name AS suggestion, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 3")
def name_suggestions(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return usage.suggestions(names, names, 3, 25)


@query("categories", "SELECT CASE WHEN contains(lower(text), 'thea') THEN 'first' WHEN contains(lower(text), 'ing') OR contains(lower(text), 'ung') THEN 'second' ELSE 'general' END AS category, count(*) AS n FROM documents GROUP BY 1")
def categories(spark, d):
    return table(spark, d, "documents").groupBy(scalars.categorize(F.col("text"), {"first": ("thea",), "second": ("ing", "ung")}, "general").alias("category")).agg(F.count("*").alias("n"))


@query("categories_default", "SELECT CASE WHEN contains(lower(text), 'hvac') OR contains(lower(text), 'ahu') OR contains(lower(text), 'vav') OR contains(lower(text), 'cooling') OR contains(lower(text), 'heating') OR contains(lower(text), 'airside') THEN 'hvac' WHEN contains(lower(text), 'energy') OR contains(lower(text), 'kwh') OR contains(lower(text), 'kw') OR contains(lower(text), 'consumption') OR contains(lower(text), 'demand') THEN 'energy' WHEN contains(lower(text), 'meter') THEN 'meter' WHEN contains(lower(text), 'spark') OR contains(lower(text), 'fault') OR contains(lower(text), 'alarm') THEN 'spark_analysis' WHEN contains(lower(text), 'report') OR contains(lower(text), 'email') OR contains(lower(text), 'summary') THEN 'reporting' WHEN contains(lower(text), 'admin') OR contains(lower(text), 'job') OR contains(lower(text), 'monitor') THEN 'admin' WHEN contains(lower(text), 'sensor') OR contains(lower(text), 'temp') OR contains(lower(text), 'pressure') THEN 'sensor' WHEN contains(lower(text), 'control') OR contains(lower(text), 'setpoint') OR contains(lower(text), 'cmd') THEN 'control' WHEN contains(lower(text), 'his') OR contains(lower(text), 'data') OR contains(lower(text), 'analysis') THEN 'data_analysis' WHEN contains(lower(text), 'util') OR contains(lower(text), 'helper') OR contains(lower(text), 'tool') THEN 'utilities' ELSE 'uncategorized' END AS category, count(*) AS n FROM documents GROUP BY 1")
def categories_default(spark, d):
    return table(spark, d, "documents").groupBy(scalars.categorize(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query("code_metrics", "SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\\b(if|else|each|while|for|catch|and|or)\\b')) AS BIGINT) AS complexity FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents)")
def code_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.complexity(F.regexp_replace("text", r"[^\x00-\x7F]", "x")).cast("long").alias("complexity"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("hash"))


@query("date_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(isodow(ts) - 1 AS INTEGER) AS dow, strftime(ts, '%b %Y') AS label FROM events")
def date_parts(spark, d):
    return table(spark, d, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.day("ts").alias("d"), F.hour("ts").alias("h"), F.weekday("ts").alias("dow"), scalars.month_label(F.col("ts")).alias("label"))
