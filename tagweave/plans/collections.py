"""Queries of positional grid operators, lists, dicts, and definitions normalised from libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import records
from tagweave.functions.filters import Symbol
from tagweave.operators import grid, normalize, ontology
from tagweave.plans.registry import query, table
from tagweave.sources.values import MARKER


@query("grid_reverse", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20")
def grid_reverse(spark, d):
    return grid.reverse(table(spark, d, "customer"), ["c_acctbal", "c_custkey"]).limit(20).select("c_custkey", "c_name")


@query("grid_positions", "WITH c AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT 'last' AS what, o_orderkey, n, n = 0 AS empty FROM c WHERE k = n - 1 UNION ALL SELECT 'get', o_orderkey, n, n = 0 FROM c WHERE k = 41")
def grid_positions(spark, d):
    """The last row, the one at a place, and how many there are."""
    o, order = table(spark, d, "orders"), ["o_orderdate", "o_orderkey"]
    found = grid.last(o, order).select(F.lit("last").alias("what"), "o_orderkey").unionByName(grid.get(o, order, 41).select(F.lit("get").alias("what"), "o_orderkey"))
    found = found.unionByName(grid.get(o, order, 1 << 30).select(F.lit("beyond").alias("what"), "o_orderkey")).unionByName(grid.get(o, order, -1).select(F.lit("before").alias("what"), "o_orderkey"))
    return found.join(F.broadcast(grid.length(o)))


@query("grid_numbered", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS position FROM lineitem")
def grid_numbered(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return grid.numbered(items, ["l_orderkey", "l_linenumber"])


@query("grid_insert", "WITH s AS (SELECT s_suppkey AS k, s_name AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier), n AS (SELECT n_nationkey AS k, n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p, count(*) OVER () AS c FROM nation) SELECT k, name, CASE WHEN p >= 3 THEN p + (SELECT count(*) FROM nation) ELSE p END AS position, NULL::INTEGER AS region FROM s UNION ALL SELECT n.k, n.name, p + 3, n_regionkey FROM n JOIN nation ON n_nationkey = n.k")
def grid_insert(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return grid.insert(s, ["k"], 3, n, ["k"])


@query("grid_set_row", "SELECT CASE WHEN n_nationkey = 4 THEN 99 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_nationkey = 4 THEN NULL ELSE n_name END AS n_name, CAST(n_nationkey AS BIGINT) AS position FROM nation")
def grid_set_row(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return grid.set_row(n, ["n_nationkey"], 4, {"n_nationkey": 99})


@query("grid_clear", "SELECT * FROM region WHERE false")
def grid_clear(spark, d):
    return grid.clear(table(spark, d, "region"))


@query("grid_flatten", "SELECT user_id, unnest(t) AS kind FROM (SELECT user_id, flatten(list([event_type, upper(event_type)])) AS t FROM events GROUP BY 1)")
def grid_flatten(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.array("event_type", F.upper("event_type"))).alias("kind"))
    return grid.flatten(e, "kind")


@query("grid_same_rows", "SELECT (SELECT count(*) FROM (SELECT * FROM customer EXCEPT ALL SELECT * FROM customer)) = 0 AS same, (SELECT count(*) FROM (SELECT * FROM supplier EXCEPT ALL SELECT * FROM supplier WHERE s_acctbal > 0)) = 0 AS other")
def grid_same_rows(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return spark.range(1).select(F.lit(grid.same_rows(c, c.orderBy("c_name"))).alias("same"), F.lit(grid.same_rows(s, s.where("s_acctbal > 0"))).alias("other"))


@query(
    "list_steps",
    """WITH u AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)
       SELECT user_id, list_reverse(v) AS back, list_filter(v, lambda x: x > 50)[1] AS first_large, round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, x: a * 0.5 + x), 4) AS smoothed,
              list_transform(v, lambda x: round(x, 0)) AS rounded, flatten([v, [1.0::DOUBLE]]) AS longer FROM u""",
)
def list_steps(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    v = F.col("e.value")
    return e.select(
        "user_id", grid.list_reverse(v).alias("back"), grid.list_find(v, lambda x: x > 50).alias("first_large"),
        F.round(grid.list_reduce(v, F.lit(0.0), lambda a, x: a * 0.5 + x), 4).alias("smoothed"), F.transform(v, lambda x: F.round(x, 0)).alias("rounded"),
        grid.list_flat(F.array(v, F.array(F.lit(1.0)))).alias("longer"),
    )


def _tags():
    pairs = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return F.when(F.col("c_acctbal") > 0, grid.dict_set(pairs, "rich", F.lit("yes"))).otherwise(pairs)


@query("dict_access", "SELECT c_custkey, c_mktsegment AS segment, coalesce(CASE WHEN c_acctbal > 0 THEN 'yes' END, 'no') AS rich, c_acctbal > 0 AS has_rich, CASE WHEN c_acctbal > 0 THEN ['name', 'rich', 'segment'] ELSE ['name', 'segment'] END AS names, CASE WHEN c_acctbal > 0 THEN 3 ELSE 2 END AS n, c_mktsegment = 'BUILDING' OR c_name = 'BUILDING' AS building FROM customer")
def dict_access(spark, d):
    c = table(spark, d, "customer").withColumn("t", _tags())
    return c.select(
        "c_custkey", grid.dict_get(F.col("t"), "segment").alias("segment"), grid.dict_get(F.col("t"), "rich", F.lit("no")).alias("rich"), grid.dict_has(F.col("t"), "rich", "name").alias("has_rich"),
        grid.dict_names(F.col("t")).alias("names"), F.size("t").alias("n"), grid.dict_matches(F.col("t"), lambda _, v: v == "BUILDING").alias("building"),
    )


@query("dict_merge", "SELECT c_custkey, 'none' AS segment, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'yes' END AS rich, CASE WHEN c_acctbal > 0 THEN 3 ELSE 2 END AS n FROM customer")
def dict_merge(spark, d):
    """The last dict wins; then one tag goes and comes back."""
    merged = grid.dict_merge(_tags(), F.create_map(F.lit("segment"), F.lit("some")), F.create_map(F.lit("segment"), F.lit("none")))
    c = table(spark, d, "customer").withColumn("t", grid.dict_set(grid.dict_remove(merged, "name"), "name", F.col("c_name")))
    return c.select("c_custkey", *(grid.dict_get(F.col("t"), k).alias(k) for k in ("segment", "name", "rich")), F.size("t").alias("n"))


# --- definitions ---


def _s(*names):
    return [Symbol(n) for n in names]


def _libs(spark, d):
    """Two libraries: kinds and associations, and the places of the tables. Nations are a
    fixed set of 25 names, so their definitions are made on the driver."""
    core = [
        {"def": Symbol("marker")}, {"def": Symbol("val")}, {"def": Symbol("feature")}, {"def": Symbol("list"), "is": _s("val")}, {"def": Symbol("str"), "is": _s("val")},
        {"def": Symbol("number"), "is": _s("val")}, {"def": Symbol("symbol"), "is": _s("val")}, {"def": Symbol("ref"), "is": _s("val")}, {"def": Symbol("association"), "is": _s("val")}, {"def": Symbol("lib"), "is": _s("feature")},
        {"def": Symbol("is"), "is": _s("association", "list"), "notInherited": MARKER}, {"def": Symbol("tagOn"), "is": _s("association", "list"), "notInherited": MARKER}, {"def": Symbol("tags"), "is": _s("association"), "computedFromReciprocal": MARKER, "reciprocalOf": Symbol("tagOn")},
        *({"def": Symbol(m), "is": _s("marker")} for m in ("notInherited", "computedFromReciprocal", "accumulate", "entity", "choice")), {"def": Symbol("reciprocalOf"), "is": _s("symbol")},
        {"def": Symbol("labels"), "is": _s("str"), "accumulate": MARKER}, {"def": Symbol("zone"), "is": _s("number")}, {"def": Symbol("enum"), "is": _s("str")},
        {"def": Symbol("tz"), "is": _s("str"), "enum": "UTC\nTokyo\nLondon"}, {"def": Symbol("area"), "is": _s("number"), "tagOn": _s("place")}, {"def": Symbol("place"), "is": _s("entity"), "labels": "place"},
        {"def": Symbol("size"), "is": _s("choice")}, {"def": Symbol("small"), "is": _s("size")}, {"def": Symbol("large"), "is": _s("size")}, {"def": Symbol("lib:core")}, {"def": Symbol("lib:places")},
    ]
    places = [{"def": Symbol(f"region{r.r_regionkey}"), "is": Symbol("place"), "zone": r.r_regionkey, "labels": r.r_name} for r in table(spark, d, "region").collect()]
    places += [{"def": Symbol(f"nation{n.n_nationkey}"), "is": _s(f"region{n.n_regionkey}")} for n in table(spark, d, "nation").collect()]
    places += [{"def": Symbol("capital"), "is": _s("marker"), "tagOn": _s("nation3")}, {"defx": Symbol("nation3"), "zone": 77, "labels": "third"}]
    return [normalize.Lib("core", (), tuple(core)), normalize.Lib("places", ("core",), tuple(places))]


@query("defs_inherited", "SELECT 'nation' || n_nationkey AS name, CASE WHEN n_nationkey = 3 THEN 77 ELSE n_regionkey END AS zone, CASE WHEN n_nationkey = 3 THEN ['third', r_name, 'place'] ELSE [r_name, 'place'] END AS labels, 'lib:places' AS lib FROM nation JOIN region ON n_regionkey = r_regionkey")
def defs_inherited(spark, d):
    """What nations have from their regions; labels accumulate, an extension adds to one."""
    out = normalize.normalize(_libs(spark, d))
    if out.problems:
        raise AssertionError(out.problems)
    rows = [(n, int(r["zone"]), list(r["labels"]), r["lib"].name) for n, r in out.defs.items() if n.startswith("nation")]
    return spark.createDataFrame(rows, "name string, zone int, labels array<string>, lib string")


@query("defs_closure", "WITH e AS (SELECT 'nation' || n_nationkey AS name, n_regionkey AS r FROM nation) SELECT name, unnest([name, 'region' || r, 'place', 'entity', 'marker']) AS ancestor FROM e")
def defs_closure(spark, d):
    closure = normalize.normalize(_libs(spark, d)).namespace().closure(spark)
    return closure.where(F.col("name").startswith("nation"))


@query("defs_associations", "SELECT 'nation' || n_nationkey AS name, unnest(CASE WHEN n_nationkey = 3 THEN ['area', 'capital'] ELSE ['area'] END) AS associated FROM nation UNION ALL SELECT 'region' || r_regionkey, 'area' FROM region UNION ALL SELECT 'place', 'area'")
def defs_associations(spark, d):
    """Tags of an entity, computed from the defs that say what they are on."""
    return normalize.normalize(_libs(spark, d)).namespace().associations_table(spark, "tags")


@query("defs_lists", "SELECT * FROM (VALUES ('choice', 'large'), ('choice', 'small'), ('feature', 'lib'), ('library', 'lib:core'), ('library', 'lib:places'), ('zone', 'London'), ('zone', 'Tokyo'), ('zone', 'UTC')) t(what, name)")
def defs_lists(spark, d):
    """Choices, features, libraries and time zones that the definitions list."""
    space = normalize.normalize(_libs(spark, d)).namespace()
    rows = [("choice", n) for names in space.choices().values() for n in names] + [("feature", n) for n in space.feature_names()]
    rows += [("library", x.name) for x in space.libs()] + [("zone", n) for n in space.timezones()]
    return spark.createDataFrame(rows, "what string, name string")


_SITE = [
    ontology.Def("marker"), ontology.Def("site", ("marker",), children=("building", "floor")), ontology.Def("building", ("marker",), children=("floor", "room")),
    ontology.Def("floor", ("marker",)), ontology.Def("room", ("marker",)),
]


@query("defs_protos", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['building', 'floor', 'room'] WHEN p_size % 3 = 1 THEN ['building', 'floor'] ELSE [] END AS protos FROM part")
def defs_protos(spark, d):
    """Child prototypes of records, by the sets of tags that occur (few)."""
    space = ontology.Namespace.build(_SITE)
    tags = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("site"), F.lit("building"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("site"))).otherwise(F.array(F.lit("room")))
    parts = table(spark, d, "part").select("p_partkey", tags.alias("tags"))
    sets = [(list(x), space.protos(x)) for x in (["site", "building"], ["site"], ["room"])]
    known = spark.createDataFrame(sets, "tags array<string>, protos array<string>")
    return parts.join(F.broadcast(known), "tags").select("p_partkey", "protos")


@query("new_records", "SELECT n_nationkey, true AS site, 0.0::DOUBLE AS area, '' AS dis, false AS open FROM nation")
def new_records(spark, d):
    """Records that start with the defaults of their tags' kinds."""
    fresh = records.new_record({"site": "marker", "area": "number", "dis": "str", "open": "bool", "opened": "date"})
    return table(spark, d, "nation").select("n_nationkey", *(F.lit(v).alias(k) for k, v in fresh.items()))
