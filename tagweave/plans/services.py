"""Queries of writers, caches, validators, stored templates, projects and history edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.engine import Engine, Workspace
from tagweave.functions import records, scalars, units
from tagweave.functions.calls import calls
from tagweave.operators import series, usage
from tagweave.plans import templates
from tagweave.plans.registry import query, table
from tagweave.sources import readers


@query("zinc_lines", """SELECT c_custkey || ',"' || replace(c_name, '#', '\\$#') || '",' || CASE WHEN c_nationkey < 12 THEN 'T' ELSE 'F' END || ',' || CASE WHEN c_nationkey < 5 THEN '' ELSE '"a\\"b\\\\c"' END || ',2024-01-0' || (1 + c_nationkey % 9) || ',' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '.5' END AS text FROM customer""")
def zinc_lines(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.replace("c_name", F.lit("#"), F.lit("$#")).alias("name"), (F.col("c_nationkey") < 12).alias("low"), F.when(F.col("c_nationkey") >= 5, F.lit('a"b\\c')).alias("odd"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey") % 9).alias("day"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(0.5)).alias("x"),
    )
    return readers.zinc_rows(c)


@query("files_changed", "SELECT 'orders.parquet' AS file, true AS since_1970, false AS since_2999, count(*) AS n_rows FROM orders UNION ALL SELECT 'documents.parquet', true, false, count(*) FROM documents")
def files_changed(spark, d):
    """Whether tables' files are newer than a time, as a cache asks, and the rows each would
    bring. A table is one file or a folder of them; it changed if any of its files did."""
    found = None
    for t in ("orders", "documents"):
        at = f"{d}/{t}.parquet"
        ages = [readers.changed_files(spark, at, since).agg(F.coalesce(F.bool_or("changed"), F.lit(False)).alias(name)) for since, name in (("1970-01-02", "since_1970"), ("2999-01-01", "since_2999"))]
        one = ages[0].crossJoin(ages[1]).crossJoin(table(spark, d, t).agg(F.count("*").alias("n_rows")))
        one = one.select(F.lit(f"{t}.parquet").alias("file"), "since_1970", "since_2999", "n_rows")
        found = one if found is None else found.unionByName(one)
    return found


_FUNCTIONS = "f AS (SELECT n_name AS name, n_nationkey % 3 AS required, n_nationkey % 3 + 1 AS most, n_nationkey = 7 AS deprecated FROM nation)"


def _functions(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), (n % 3).alias("required"), (n % 3 + 1).alias("most"), (n == 7).alias("deprecated"))


@query("calls_validated", f"WITH {_FUNCTIONS}, c AS (SELECT c_custkey, 'NATION_' || (c_nationkey + 2) AS name, c_custkey % 4 AS n_args FROM customer) SELECT c_custkey, problem FROM (SELECT c_custkey, CASE WHEN f.name IS NULL THEN 'unknown' WHEN n_args < required THEN 'too few arguments' WHEN n_args > most THEN 'too many arguments' WHEN deprecated THEN 'deprecated' END AS problem FROM c LEFT JOIN f USING (name)) WHERE problem IS NOT NULL")
def calls_validated(spark, d):
    """Calls in source texts against the functions' signatures."""
    c = F.col("c_custkey")
    given = F.array_join(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (c % 4).cast("int")), ", ")
    sources = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("x => NATION_"), F.col("c_nationkey") + 2, F.lit(" ("), given, F.lit(")")).alias("source"))
    return usage.validate_calls(usage.calls_with_arguments(sources, "c_custkey", "source"), _functions(spark, d)).select("c_custkey", "problem")


@query("calls_nested", f"""WITH {_FUNCTIONS}, c AS (SELECT c_custkey AS k, 'NATION_' || c_nationkey AS name, 'NATION_' || (c_nationkey + 1) AS inside, 'F' || (c_custkey % 7) AS d FROM customer),
 n AS (SELECT k, 0 AS seq, 2 AS line, name, 2 AS n_args, 0 AS depth, NULL AS outer_name, d FROM c UNION ALL SELECT k, 1, 3, inside, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END, 1, name, d FROM c UNION ALL SELECT k, 2, 3, 'size', 0, 2, inside, d FROM c WHERE k % 2 = 0)
 SELECT k AS c_custkey, seq, line, name, n_args, depth, outer_name, d AS definition, CASE WHEN f.name IS NULL THEN 'unknown' WHEN n_args < required THEN 'too few arguments' WHEN n_args > most THEN 'too many arguments' WHEN deprecated THEN 'deprecated' END AS problem FROM n LEFT JOIN f USING (name)
 WHERE f.name IS NULL OR n_args < required OR n_args > most OR deprecated""")
def calls_nested(spark, d):
    """Calls inside others' arguments, with the function they stand in; strings and comments
    hold none."""
    c = F.col("c_custkey")
    given = F.when(c % 2 == 0, "[a, b], rows.size()").otherwise(F.lit(""))
    source = F.concat(
        F.lit("F"), c % 7, F.lit(": (a, b) => do\n  NATION_"), F.col("c_nationkey"), F.lit("(\"NATION_1(a, b, c) // \", // NATION_2(\n    NATION_"),
        F.col("c_nationkey") + 1, F.lit("("), given, F.lit("))\n  /* NATION_3(\n a) */ (a + b)\nend\n"),
    )
    found = calls(table(spark, d, "customer").select("c_custkey", source.alias("source")), "c_custkey", "source")
    return usage.validate_calls(found, _functions(spark, d)).select("c_custkey", "seq", "line", "name", "n_args", "depth", F.col("outer").alias("outer_name"), "definition", "problem")


@query("calls_corrected", """WITH k AS (SELECT n_name AS suggestion FROM nation), u AS (SELECT lower(n_name) AS name FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'NAT'),
 p AS (SELECT u.name, suggestion, least(CASE WHEN lower(suggestion) = lower(name) THEN 0 ELSE 9 END, CASE WHEN levenshtein(lower(name), lower(suggestion)) BETWEEN 1 AND 2 THEN levenshtein(lower(name), lower(suggestion)) ELSE 9 END) AS rank FROM u, k WHERE suggestion <> name AND lower(suggestion)[1:3] = lower(name)[1:3]),
 e AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, suggestion) AS k FROM p) SELECT name, suggestion FROM e WHERE k <= 3 AND rank < 2 OR name = 'NAT' AND k <= 3""")
def calls_corrected(spark, d):
    """Known names for unknown ones: by case and edits; the ones nearest to each."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    unknown = table(spark, d, "nation").where("n_nationkey < 3").select(F.lower("n_name").alias("name")).unionByName(spark.range(1).select(F.lit("NAT").alias("name")))
    found = usage.corrections(unknown, names)
    far = F.levenshtein(F.lower("name"), F.lower("suggestion"))
    return found.where((F.col("name") == "NAT") | (far < 2))


@query("template_problems", "SELECT p_partkey AS id, problem FROM (SELECT p_partkey, unnest(list_concat(CASE WHEN p_size = 1 THEN ['missing category'] ELSE [] END, CASE WHEN p_size % 5 = 0 THEN ['no type or description: start'] ELSE [] END, CASE WHEN p_size % 2 = 0 THEN ['no parameter for span'] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['not used: start'] ELSE [] END)) AS problem FROM part)")
def template_problems(spark, d):
    size = F.col("p_size")
    body = F.concat(F.when(size % 3 == 0, "x").otherwise("{{start}}"), F.lit(" y "), F.when(size % 2 == 0, "{{span}} {{span}}").otherwise(""))
    described = F.when(size % 5 == 0, F.lit(None)).otherwise("from when")
    parameters = F.array(
        F.struct(F.lit("start").alias("name"), F.lit("date").alias("type"), described.alias("description"), F.lit(None).cast("boolean").alias("required")),
        F.struct(F.lit("note").alias("name"), F.lit("string").alias("type"), F.lit("free").alias("description"), F.lit(False).alias("required")),
    )
    stored = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(size != 1, F.col("p_brand")).alias("category"), body.alias("template"), parameters.alias("parameters"))
    return templates.problems(stored.withColumn("id", F.col("id").cast("string"))).select(F.col("id").cast("long").alias("id"), "problem")


@query("project_switch", "SELECT n_name AS name, 'east' AS project FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3 UNION ALL SELECT n_name, 'west' FROM nation WHERE n_regionkey = 2 AND n_nationkey > 3")
def project_switch(spark, d):
    """The same question to two projects."""
    n = table(spark, d, "nation")
    space = Workspace().add("east", Engine(spark, {"nation": n.where("n_regionkey = 1")})).add("west", Engine(spark, {"nation": n.where("n_regionkey = 2")}))
    first = space.engine.read_all("nation", "n_nationkey > 3").select(F.col("n_name").alias("name"), F.lit(space.current.split("/")[1]).alias("project"))
    second = space.use("west").read_all("nation", "n_nationkey > 3").select(F.col("n_name").alias("name"), F.lit(space.current.split("/")[1]).alias("project"))
    return first.unionByName(second)


@query("functions_committed", "WITH p AS (SELECT p_name || '#' || p_partkey AS name, p_type, p_size FROM part) SELECT name, CASE WHEN p_size > 40 THEN 'new' ELSE p_type END AS source, 'function' AS place FROM p UNION ALL SELECT 'Added', 'new', 'function' UNION ALL SELECT name, p_type, 'backup' FROM p WHERE p_size > 40")
def functions_committed(spark, d):
    """New sources in, the replaced ones kept."""
    p = table(spark, d, "part").select(F.concat("p_name", F.lit("#"), "p_partkey").alias("name"), F.col("p_type").alias("source"), "p_size")
    changed = p.where("p_size > 40").select("name", F.lit("new").alias("source")).unionByName(spark.range(1).select(F.lit("Added").alias("name"), F.lit("new").alias("source")))
    engine = Engine(spark, {"function": p.select("name", "source")}).commit_function(changed, "2024-01-01 00:00:00")
    backup = engine.tables["function_backup"].select("name", "source", F.lit("backup").alias("place"))
    return engine.functions().select("name", "source", F.lit("function").alias("place")).unionByName(backup)


@query("history_written", "SELECT user_id AS point, ts, CASE WHEN event_type = 'click' THEN -1.0 ELSE value END AS v0 FROM (SELECT user_id, ts, max(event_type = 'click') AS hit, event_type, value, event_id FROM events GROUP BY ALL) e WHERE event_type = 'click' OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.ts = e.ts AND x.event_type = 'click')")
def history_written(spark, d):
    """New samples replace those of their point and time."""
    h = table(spark, d, "events").select(F.col("user_id").alias("point"), "ts", F.col("value").alias("v0"), "event_type")
    new = h.where("event_type = 'click'").select("point", "ts", F.lit(-1.0).alias("v0"))
    return series.write_samples(h.drop("event_type"), new, ["point"])


@query("history_cleared", "SELECT event_id FROM events WHERE NOT (user_id IN (SELECT user_id FROM events WHERE event_type = 'error') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20')")
def history_cleared(spark, d):
    e = table(spark, d, "events")
    return series.clear_samples(e, e.where("event_type = 'error'"), ["user_id"], "2024-01-03", "2024-01-20").select("event_id")


@query("near_numbers", "SELECT l_orderkey, l_linenumber, l_extendedprice = l_extendedprice * (1 + l_discount / 50) OR abs(l_extendedprice - l_extendedprice * (1 + l_discount / 50)) <= least(abs(l_extendedprice), abs(l_extendedprice * (1 + l_discount / 50))) * 0.001 AS near FROM lineitem")
def near_numbers(spark, d):
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_discount") / 50)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.is_approximate(a, b).alias("near"))


_KINDS_SQL = " ".join(f"WHEN word IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in reversed(records.BUILTINS.items()))


@query("builtin_kinds", f"SELECT CASE {_KINDS_SQL} END AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM conversations) GROUP BY 1")
def builtin_kinds(spark, d):
    """Words of all texts by the kind of builtin that has their name."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return words.groupBy(records.builtin_kind(F.col("word")).alias("kind")).agg(F.count("*").alias("n"))


@query("unit_quantities", "SELECT event_type, count(*) AS n, round(sum(CASE event_type WHEN 'click' THEN value * 60 WHEN 'view' THEN value * 3600 ELSE 0 END), 2) AS seconds FROM events GROUP BY 1")
def unit_quantities(spark, d):
    """Values whose unit is a duration, in seconds; others count as none."""
    unit_of = {"click": "min", "view": "h", "purchase": "kWh", "error": "m"}
    durations = {k: float(units.UNITS[u].scale) for k, u in unit_of.items() if units.is_duration(u)}
    scale = F.lit(0.0)
    for kind, factor in durations.items():
        scale = F.when(F.col("event_type") == kind, factor).otherwise(scale)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * scale), 2).alias("seconds"))


@query("documents_found", "SELECT doc_id, score FROM (SELECT doc_id, CAST(50 + CASE WHEN contains(lower(text), 'with the') THEN 25 ELSE 0 END + CASE WHEN contains(lower(source), 'with the') THEN 30 ELSE 0 END + CASE WHEN contains(lower(lang), 'with the') THEN 20 ELSE 0 END + floor(20.0 * (CAST(contains(lower(text), 'with') AS INT) + CAST(contains(lower(text), 'the') AS INT)) / 2) AS INTEGER) AS score, CAST(contains(lower(text), 'with') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS hits FROM documents) WHERE hits > 0")
def documents_found(spark, d):
    """The engine's document search, all of its hits."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"), F.col("lang").alias("library"))
    return Engine(spark, {"document": docs}).search_documents("with the", n=1 << 30).select("doc_id", "score")
