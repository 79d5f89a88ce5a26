from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagweave.engine import Engine
from tagweave.functions.filters import Model
from tagweave.operators import graph, grid, usage
from tagweave.plans import templates


@pytest.fixture(scope="module")
def engine(spark):
    sites = spark.createDataFrame([("s1", "North", 1200.0), ("s2", "South", None)], "id string, dis string, area double")
    points = spark.createDataFrame([("p1", "s1", True, "kW"), ("p2", "s2", None, "kW"), ("p3", "s1", True, None)], "id string, siteRef string, sensor boolean, unit string")
    start = datetime(2024, 1, 1)
    history = spark.createDataFrame([("p1", start + timedelta(minutes=15 * i), float(i % 7)) for i in range(200)], "point string, ts timestamp_ntz, v0 double")
    functions = spark.createDataFrame([("readSites", "read(site)"), ("kpi", "x => x")], "name string, source string")
    calls = spark.createDataFrame([("readSites", "a.txt", "in report", ["site"]), ("readSites", "b.txt", "x", ["equip"])], "functionName string, file string, context string, arguments array<string>")
    nodes = spark.createDataFrame([(1, "main", "function"), (2, "load", "function"), (3, "save", "function")], "id int, name string, kind string")
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (3, 1, "calls")], "src int, dst int, kind string")
    return Engine(
        spark, {"site": sites, "point": points, "history": history, "function": functions, "usage": calls, "node": nodes, "edge": edges},
        Model(refs={"siteRef": (sites, "id")}),
    )


def test_records(engine):
    assert [r.id for r in engine.query("point", "sensor and siteRef->area > 1000", ["id"], order=["id"]).collect()] == ["p1", "p3"]
    assert engine.read("site", "area", ["id"])["dis"] == "North"
    assert engine.read_by_id("site", "nowhere", checked=False) is None
    with pytest.raises(grid.GridError):
        engine.read_by_id("site", "nowhere")
    total, rows = engine.page("point", "id", ["id"], 1, 1)
    assert (total, [r.id for r in rows.collect()]) == (3, ["p2"])
    kinds = {r.kind: (r.n, r.tags) for r in engine.record_types("point", ["sensor", "unit"]).collect()}
    assert kinds == {"sensor": (2, ["id", "siteRef", "unit"]), "unit": (2, ["id", "sensor", "siteRef"])}
    assert engine.text(engine.query("site", "area", ["id", "area"]), "zinc") == 'ver:"3.0"\nid,area\n"s1",1200\n'


def test_templates(engine):
    assert templates.find("peak demand")[0][0] == "demand-peak"
    peak = engine.template("demand-peak").first()
    assert (peak.peak, peak.peak_ts) == (6.0, datetime(2024, 1, 1, 1, 30))
    assert engine.template("point-history", start="2024-01-01", end="2024-01-02", fold="max").count() == 24
    with pytest.raises(templates.TemplateError):
        engine.template("point-history", start="2024-01-01")
    with pytest.raises(templates.TemplateError):
        engine.template("zone-comfort", low="warm")
    for name, t in templates.TEMPLATES.items():
        given = {p.name: {"start": "2024-01-01 00:00:00", "end": "2024-01-03 00:00:00", "split": "2024-01-02 00:00:00"}[p.name] for p in t.parameters if p.required}
        if set(t.tables) == {"history"}:
            engine.template(name, **given).collect()


def test_functions(engine, spark):
    assert engine.function_usage("readSites", argument="^si").count() == 1
    assert [r.name for r in engine.unused_functions().collect()] == ["kpi"]
    assert engine.search_functions("read sites").first().name == "readSites"
    engine.commit_function(spark.createDataFrame([("kpi", "y => y"), ("new", "1")], "name string, source string"), "2024-01-01 00:00:00")
    assert dict(engine.functions().collect()) == {"readSites": "read(site)", "kpi": "y => y", "new": "1"}
    assert [(r.name, r.source) for r in engine.tables["function_backup"].collect()] == [("kpi", "x => x")]


def test_graph(engine, spark):
    assert {r.id: r.depth for r in engine.callers(1, 5).collect()} == {3: 1, 2: 2, 1: 3}
    assert [r.name for r in engine.find_nodes("A").collect()] == ["load", "main", "save"]
    assert {(r.src, r.dst, r.depth) for r in engine.call_subgraph(1, 2).collect()} == {(1, 2, 1), (2, 3, 2)}
    assert [(r.calls, r.called_by) for r in engine.call_graph(2).collect()] == [([3], [1])]
    assert engine.subgraph(1, 1)[0].count() == 3
    assert [r.name for r in engine.graph('MATCH WHERE name = "main" CALLEES depth=1').collect()] == ["load"]
    assert [r.cycle for r in graph.cycles(engine.tables["edge"], 5).collect()] == [[1, 2, 3]]
    assert spark.range(1).select(graph.extract_calls(F.lit("foo(bar(1), if (x) { baz.qux() })")).alias("c")).first().c == ["foo", "bar", "qux"]


def test_lists_and_dicts(spark):
    row = spark.range(1).select(
        grid.list_sort(F.array(F.lit(2), F.lit(None), F.lit(1))).alias("sorted"),
        grid.list_all(F.array().cast("array<int>"), lambda x: x > 0).alias("all_of_none"),
        grid.dict_merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("merged"),
        grid.to_tag_name(F.lit("Hello there World")).alias("tag"),
        grid.list_insert(F.array(F.lit(1), F.lit(3)), 1, F.lit(2)).alias("inserted"),
    ).first()
    assert row.sorted == [None, 1, 2] and row.all_of_none is False
    assert row.merged == {"a": 1, "b": 3} and row.tag == "helloThereWorld" and row.inserted == [1, 2, 3]


def test_empty_grid_is_neither_any_nor_all(spark):
    empty = spark.createDataFrame([], "a int")
    assert tuple(grid.matches(empty, "a")  .first()) == (False, False)


def test_cost_model(spark):
    text = "readAll(site).each(s => readAll(point).map(p => hisRead(p)))"
    row = spark.range(1).select(usage.cost_model(F.lit(text)).alias("cost"), usage.lint(F.lit(text)).alias("lint"), usage.duration_class(F.lit(300), F.lit(text)).alias("d")).first()
    assert row.cost == (1 + 10 + 10 + 20 + 2 + 2) * 10 and row.d == "1-5s" and row.lint == "n+1,nested,unbounded"


def test_words_of_a_kept_index(engine, spark, tmp_path):
    engine.add("note", spark.createDataFrame([(1, "Sensor north", "broken"), (2, "sensor", "north wing"), (3, "sensors", None)], "id int, a string, b string"))
    engine.save_index("note", "id", ["a", "b"], f"{tmp_path}/index")
    assert sorted(r.id for r in engine.search_words(f"{tmp_path}/index", ["Sensor", "nor"]).collect()) == [1, 2]
    assert sorted(r.id for r in engine.search_words(f"{tmp_path}/index", ["sensor"]).collect()) == [1, 2]
    assert sorted(r.id for r in engine.search_words(f"{tmp_path}/index", ["sensor", "wing"], every=False).collect()) == [1, 2, 3]
