"""Queries over graphs: nations and the nations they buy most from, regions, suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagweave.operators import graph, graph_dsl
from tagweave.plans.registry import query, table


def links(spark, d):
    """Each nation calls every nation that it buys from; w is the number of purchases."""
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    volume = items.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("w"))
    return volume.withColumn("kind", F.lit("calls"))


def trade(spark, d):
    """Closest partners: each nation calls the three whose sales go to it in the largest
    shares. A graph whose paths can be told apart; all links are in `links`."""
    volume = links(spark, d)
    share = F.col("w") / F.sum("w").over(Window.partitionBy("dst"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("share"), "dst"))
    return volume.withColumn("share", share).withColumn("k", nth).where("k <= 3").select("src", "dst", F.lit("calls").alias("kind"))


def nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("function").alias("kind"))


def places(spark, d):
    """Containment: region, nation, supplier."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    nodes = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("kind")))
    nodes = nodes.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("contains").alias("kind"))
    edges = edges.unionByName(s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("contains").alias("kind")))
    return nodes, edges


_E = """v AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
 e AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY share DESC, dst) AS k FROM (SELECT *, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY dst) AS DOUBLE) AS share FROM v)) WHERE k <= 3)"""
_R = "WITH RECURSIVE " + _E
_ALL = _E[: _E.index(",\n e AS")] + ", e AS MATERIALIZED (SELECT src, dst FROM v)"
_RA = "WITH RECURSIVE " + _ALL


def _id(spark, value):
    return spark.range(1).select(F.lit(value).cast("int").alias("id"))


@query("callers_depth", _RA + ", t(id, depth) AS (SELECT src, 1 FROM e WHERE dst = 3 UNION SELECT e.src, t.depth + 1 FROM e JOIN t ON e.dst = t.id WHERE t.depth < 5) SELECT id, min(depth) AS depth FROM t GROUP BY 1")
def callers_depth(spark, d):
    return graph.callers(links(spark, d), _id(spark, 3), 5)


@query("callees_depth", _RA + ", t(id, depth) AS (SELECT dst, 1 FROM e WHERE src = 3 UNION SELECT e.dst, t.depth + 1 FROM e JOIN t ON e.src = t.id WHERE t.depth < 5) SELECT id, min(depth) AS depth FROM t GROUP BY 1")
def callees_depth(spark, d):
    return graph.callees(links(spark, d), _id(spark, 3), 5)


@query("impact", _RA + ", t(id, depth) AS (SELECT src, 1 FROM e WHERE dst = 3 UNION SELECT e.src, t.depth + 1 FROM e JOIN t ON e.dst = t.id WHERE t.depth < 10), m AS (SELECT id, min(depth) AS depth FROM t GROUP BY 1) SELECT count(*) AS n, max(depth) AS max_depth, 'calls' AS kinds FROM m")
def impact(spark, d):
    return graph.impact(links(spark, d), _id(spark, 3), 10)


_PATHS = _R + ", p(id, path, len) AS (SELECT {a}, [CAST({a} AS VARCHAR)], 0 UNION ALL SELECT e.dst, list_append(p.path, CAST(e.dst AS VARCHAR)), p.len + 1 FROM e JOIN p ON e.src = p.id WHERE p.len < {depth} AND NOT list_contains(p.path, CAST(e.dst AS VARCHAR)) AND p.id <> {b} {avoid})"


@query("shortest_path", _PATHS.format(a=0, b=17, depth=6, avoid="") + " SELECT path, len AS length FROM p WHERE id = 17 ORDER BY len, path LIMIT 1")
def shortest_path(spark, d):
    return graph.shortest_path(trade(spark, d), "0", "17", 6)


@query("constrained_path", _PATHS.format(a=0, b=17, depth=6, avoid="AND e.dst NOT IN (5, 9)") + " SELECT path, len AS length FROM p WHERE id = 17 AND list_contains(path, '2') ORDER BY len, path LIMIT 1")
def constrained_path(spark, d):
    return graph.constrained_path(trade(spark, d), "0", "17", ["2"], ["5", "9"], 6)


@query("cycles_canonical", _R + ", p(first, id, path) AS (SELECT src, dst, [src] FROM e UNION ALL SELECT p.first, e.dst, list_append(p.path, p.id) FROM p JOIN e ON e.src = p.id WHERE p.id > p.first AND NOT list_contains(p.path, p.id) AND len(p.path) < 5) SELECT path AS cycle, CAST(len(path) AS INTEGER) AS length FROM p WHERE id = first")
def cycles_canonical(spark, d):
    return graph.cycles(trade(spark, d), 5)


def _rank_sql(rounds: int) -> str:
    steps = ", ".join(
        f"k{i + 1} AS MATERIALIZED (SELECT n.id, 0.15 / 25 + 0.85 * coalesce(sum(k.rank / o.c), 0) AS rank FROM n LEFT JOIN e ON e.dst = n.id LEFT JOIN k{i} k ON k.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY 1)"
        for i in range(rounds)
    )
    return f"WITH {_ALL}, n AS (SELECT n_nationkey AS id FROM nation), o AS (SELECT src, count(*) AS c FROM e GROUP BY 1), k0 AS (SELECT id, 1.0::DOUBLE / 25 AS rank FROM n), {steps} SELECT id, round(rank, 6) AS rank FROM k{rounds}"


@query("pagerank_10", _rank_sql(10))
def pagerank_10(spark, d):
    return graph.page_rank(nations(spark, d), links(spark, d), 10).select("id", F.round("rank", 6).alias("rank"))


@query("scc", _RA + ", t(a, b) AS (SELECT src, dst FROM e UNION SELECT t.a, e.dst FROM t JOIN e ON e.src = t.b), m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component, count(*) AS n FROM t x JOIN t y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT id, component FROM m WHERE n >= 2")
def scc(spark, d):
    return graph.strong_components(links(spark, d), 2)


@query(
    "betweenness",
    _R + """, p(s, id, path, len) AS (SELECT n_nationkey, n_nationkey, [n_nationkey], 0 FROM nation UNION ALL SELECT p.s, e.dst, list_append(p.path, e.dst), p.len + 1 FROM e JOIN p ON e.src = p.id WHERE p.len < 7 AND NOT list_contains(p.path, e.dst)),
 q AS (SELECT *, min(len) OVER (PARTITION BY s, id) AS least FROM p WHERE s <> id), g AS (SELECT s, id, path, count(*) OVER (PARTITION BY s, id) AS c FROM q WHERE len = least),
 u AS (SELECT s, id, c, unnest(path) AS via FROM g) SELECT via AS id, round(sum(1.0 / c), 4) AS score FROM u WHERE via <> s AND via <> id GROUP BY 1""",
)
def betweenness(spark, d):
    out = graph.betweenness(trade(spark, d), nations(spark, d), depth=7)
    return out.where("score > 0").select("id", F.round("score", 4).alias("score"))


@query("degree_metrics", "WITH " + _ALL + " SELECT n_nationkey AS id, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS in_degree, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS callers, (SELECT count(*) FROM e WHERE src = n_nationkey) AS out_degree, (SELECT count(*) FROM e WHERE src = n_nationkey) AS callees, CAST(0 AS BIGINT) AS contains FROM nation")
def degree_metrics(spark, d):
    return graph.degrees(nations(spark, d), links(spark, d))


@query("most_called", "WITH " + _ALL + " SELECT n_nationkey AS id, n_name AS name, count(*) AS calls FROM e JOIN nation ON dst = n_nationkey GROUP BY 1, 2 ORDER BY calls DESC, name LIMIT 5")
def most_called(spark, d):
    return graph.most_called(nations(spark, d), links(spark, d), 5)


@query("containment_depth", "SELECT 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier")
def containment_depth(spark, d):
    return graph.containment_depth(*places(spark, d))


@query("subgraph_khop", "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), b AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), t(id, k) AS (SELECT 'r1', 0 UNION SELECT b.b, t.k + 1 FROM b JOIN t ON b.a = t.id WHERE t.k < 2) SELECT src, dst, 'contains' AS kind FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)")
def subgraph_khop(spark, d):
    nodes, edges = places(spark, d)
    return graph.subgraph(nodes, edges, nodes.where("id = 'r1'"), 2)[1].select("src", "dst", "kind")


@query("graph_statistics", "SELECT 'node' AS what, 'region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'edge', 'contains', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)")
def graph_statistics(spark, d):
    return graph.statistics(*places(spark, d))


@query("graph_export_dot", "SELECT '  \"' || n_nationkey || '\" [label=\"' || n_name || '\"];' AS text FROM nation UNION ALL SELECT * FROM (WITH " + _E + " SELECT '  \"' || src || '\" -> \"' || dst || '\" [label=\"calls\"];' FROM e)")
def graph_export_dot(spark, d):
    return graph.export(nations(spark, d), trade(spark, d), "dot")


@query("resolve_references", "WITH r AS (SELECT s_suppkey AS src, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'R' || n_regionkey || '.' || n_name END AS name, n_nationkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT src, dst, 'calls' AS kind FROM r WHERE src % 2 = 1 OR (SELECT count(*) FROM nation x WHERE x.n_name = r.name) = 1")
def resolve_references(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey", F.lit("."), "n_name").alias("qualified"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("id"))
    refs = s.select(F.col("s_suppkey").alias("src"), F.when(F.col("s_suppkey") % 2 == 0, F.col("name")).otherwise(F.col("qualified")).alias("name"))
    return graph.resolve_references(refs, n)[0]


_DSL = 'WHERE name LIKE "A*" OR (name CONTAINS "i" AND kind = "supplier")'
_DSL_SQL = "FROM (SELECT 'r' || r_regionkey AS id, r_name AS name, 'region' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier) WHERE lower(name) LIKE 'a%' OR (lower(name) LIKE '%i%' AND kind = 'supplier')"


@query("dsl_match", "SELECT id, name, kind " + _DSL_SQL + " ORDER BY name, id LIMIT 20")
def dsl_match(spark, d):
    return graph_dsl.parse(f"MATCH {_DSL} LIMIT 20").run(*places(spark, d))


@query("dsl_count", "SELECT count(*) AS n " + _DSL_SQL)
def dsl_count(spark, d):
    return graph_dsl.parse(f"COUNT {_DSL}").run(*places(spark, d))


@query("dsl_callers", _R + ", t(id, depth) AS (SELECT src, 1 FROM e JOIN nation ON dst = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation) UNION SELECT e.src, t.depth + 1 FROM e JOIN t ON e.dst = t.id WHERE t.depth < 3), m AS (SELECT id, min(depth) AS depth FROM t GROUP BY 1) SELECT id, depth, n_name AS name, 'function' AS kind FROM m JOIN nation ON id = n_nationkey ORDER BY depth, name, id LIMIT 30")
def dsl_callers(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return graph_dsl.parse(f'MATCH function WHERE name = "{first}" CALLERS depth=3 LIMIT 30').run(nations(spark, d), trade(spark, d))


@query("dsl_path", _PATHS.format(a=0, b=17, depth=6, avoid="") + " SELECT path, len AS length FROM p WHERE id = 17 ORDER BY len, path LIMIT 1")
def dsl_path(spark, d):
    return graph_dsl.parse('PATH FROM "0" TO "17" maxDepth=6').run(nations(spark, d), trade(spark, d))


@query("builder_group", "SELECT kind, count(*) AS n FROM (SELECT s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT n_name, 'nation' FROM nation) WHERE NOT lower(name) LIKE '%zzz%' GROUP BY 1 ORDER BY n DESC, kind")
def builder_group(spark, d):
    return graph_dsl.GraphQuery().where("kind", "in", ["supplier", "nation"]).where("name", "not_equals", "zzz").group_by("kind").run(*places(spark, d))


_CALLS = _R + ", t(id, depth) AS (SELECT 3, 0 UNION SELECT e.{far}, t.depth + 1 FROM e JOIN t ON e.{near} = t.id WHERE t.depth < 2), m AS (SELECT id, min(depth) AS depth FROM t GROUP BY 1) SELECT src, dst, depth + 1 AS depth FROM e JOIN m ON e.{near} = m.id"


@query("callee_subgraph", _CALLS.format(near="src", far="dst"))
def callee_subgraph(spark, d):
    return graph.call_subgraph(trade(spark, d), _id(spark, 3), 3)


@query("caller_subgraph", _CALLS.format(near="dst", far="src"))
def caller_subgraph(spark, d):
    return graph.call_subgraph(trade(spark, d), _id(spark, 3), 3, reverse=True)


@query("impact_subgraph_nearest", "SELECT * FROM (" + _CALLS.format(near="dst", far="src") + ") ORDER BY depth, dst, src LIMIT 10")
def impact_subgraph_nearest(spark, d):
    """What is affected by a change, the nearest first."""
    return graph.call_subgraph(trade(spark, d), _id(spark, 3), 3, reverse=True, most=10)


@query("project_subgraph", "WITH " + _ALL + " SELECT src, dst FROM e WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def project_subgraph(spark, d):
    nodes = nations(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("project")), "id")
    return graph.project_subgraph(nodes, links(spark, d), F.col("project") == 2)[1].select("src", "dst")


@query("call_lists", _R + ", t(id, depth) AS (SELECT 3, 0 UNION SELECT e.dst, t.depth + 1 FROM e JOIN t ON e.src = t.id WHERE t.depth < 1) SELECT id, (SELECT list(dst ORDER BY dst) FROM e WHERE src = i.id) AS calls, (SELECT list(src ORDER BY src) FROM e WHERE dst = i.id) AS called_by FROM (SELECT DISTINCT id FROM t) i")
def call_lists(spark, d):
    return graph.call_lists(trade(spark, d), _id(spark, 3), 2)


@query("subgraph_export_cytoscape", "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation), k AS (SELECT 'r1' AS id, 'REGION' AS x UNION ALL SELECT dst, '' FROM e WHERE src = 'r1') SELECT '{\"data\":{\"id\":\"r' || r_regionkey || '\",\"label\":\"' || r_name || '\"}}' AS text FROM region WHERE r_regionkey = 1 UNION ALL SELECT '{\"data\":{\"id\":\"n' || n_nationkey || '\",\"label\":\"' || n_name || '\"}}' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '{\"data\":{\"source\":\"r1\",\"target\":\"n' || n_nationkey || '\",\"label\":\"contains\"}}' FROM nation WHERE n_regionkey = 1")
def subgraph_export_cytoscape(spark, d):
    nodes, edges = places(spark, d)
    return graph.export(*graph.subgraph(nodes, edges, nodes.where("id = 'r1'"), 1), "cytoscape")


@query("graph_build", """WITH f AS (SELECT doc_id, source AS file, source || '.' || lang || doc_id AS qualified, doc_id AS line FROM documents),
 n AS (SELECT *, lang_name AS name FROM (SELECT f.*, split_part(qualified, '.', -1) AS lang_name, substr(sha256(file || ':' || qualified || ':' || line), 1, 32) AS id FROM f)),
 r AS (SELECT n.id AS src, split_part(m.qualified, '.', -1) AS name, m.id AS dst FROM n JOIN n m ON m.doc_id = n.doc_id + 1)
 SELECT src, dst FROM r""")
def graph_build(spark, d):
    """A function for each document, which calls the next one and something unknown."""
    docs = table(spark, d, "documents")
    qualified = F.concat("source", F.lit("."), "lang", "doc_id")
    names = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.concat("lang", "doc_id").alias("next"))
    functions = docs.join(names, "doc_id", "left").select(
        F.col("source").alias("file"), qualified.alias("qualified"), F.col("doc_id").alias("line"), F.concat(F.lit("if (x) "), F.coalesce("next", F.lit("nothing")), F.lit("(unknown(1))")).alias("source")
    )
    return graph.build_graph(functions)[1].select("src", "dst")


@query("calls_by_form", """WITH l AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT conv_id, turn, role || '.map(toRec)' || chr(10) || 'if (f' || turn || '(a, b))' AS t FROM conversations))
 SELECT conv_id, turn, 1 AS line, 'map' AS name, role AS receiver, 'method' AS form FROM conversations UNION ALL SELECT conv_id, turn, 1, 'toRec', NULL, 'reference' FROM conversations UNION ALL SELECT conv_id, turn, 2, 'f' || turn, NULL, 'call' FROM conversations""")
def calls_by_form(spark, d):
    text = F.concat("role", F.lit(".map(toRec)\nif (f"), "turn", F.lit("(a, b))"))
    found = graph.extract_usages(table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), text.alias("text")), "key", "text")
    return found.select("key.conv_id", "key.turn", "line", "name", "receiver", "form")
