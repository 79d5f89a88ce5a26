from datetime import datetime

import pytest

from tagweave.functions.filters import Quantity, Ref, Symbol, Uri
from tagweave.functions.spans import resolve
from tagweave.operators import graph_dsl, ontology
from tagweave.sources import readers
from tagweave.sources.trio import read_trio, write_trio
from tagweave.sources.units_text import read_units
from tagweave.sources.values import MARKER, NA, Coord, Grid, NamedRef, XStr, from_hayson, to_hayson
from tagweave.sources.zinc import read_zinc, write_zinc

ZINC = 'ver:"3.0" dis:"Sites" db\nid dis:"Id",area,geo,tags,nest\n@a "A",1_000.5ft²,C(1.5,-2),{x y:[1,2]},<<\nver:"3.0"\nb\n1\n>>\n@b,N,NA,"a,\\"b\\"\\n\\u0041",M\n'


def test_zinc():
    grid = read_zinc(ZINC)
    assert grid.meta == {"dis": "Sites", "db": MARKER}
    assert [c for c, _ in grid.columns] == ["id", "area", "geo", "tags", "nest"]
    assert grid.rows[0]["id"] == NamedRef("a", "A")
    assert grid.rows[0]["area"] == Quantity(1000.5, "ft²")
    assert grid.rows[0]["geo"] == Coord(1.5, -2.0)
    assert grid.rows[0]["tags"] == {"x": MARKER, "y": [Quantity(1.0), Quantity(2.0)]}
    assert grid.rows[0]["nest"].rows == [{"b": Quantity(1.0)}]
    assert grid.rows[1] == {"id": Ref("b"), "geo": NA, "tags": 'a,"b"\nA', "nest": MARKER}
    again = read_zinc(write_zinc(grid))
    assert again == grid
    assert from_hayson(to_hayson(grid)).rows == grid.rows


def test_empty_zinc():
    assert read_zinc(write_zinc(Grid())).rows == []


def test_trio():
    text = "dis: \"A\"\nsite\narea: 10ft²\nsrc:\n  line one\n    two\nurl: `http://x/`\n---\nkind: ^hot-water\nx: Foo(\"bar\")\nplain: not a literal\n"
    records = read_trio(text)
    assert records[0] == {"dis": "A", "site": MARKER, "area": Quantity(10.0, "ft²"), "src": "line one\n  two", "url": Uri("http://x/")}
    assert records[1] == {"kind": Symbol("hot-water"), "x": XStr("Foo", "bar"), "plain": "not a literal"}
    assert read_trio(write_trio(records)) == records


def test_record_tables(spark, tmp_path):
    (tmp_path / "a.zinc").write_text('ver:"3.0"\nid,n,on\n@x,1kW,M\n@y,2kW,\n')
    (tmp_path / "b.txt").write_text("no grid")
    out = readers.read_records(spark, str(tmp_path), "zinc", "*.zinc").select(
        readers.tag("record", "id", "string").alias("id"), readers.tag("record", "n", "double").alias("n"), readers.tag("record", "on", "marker").alias("on")
    )
    assert sorted(map(tuple, out.collect())) == [("x", 1.0, True), ("y", 2.0, None)]


def test_spans():
    now = datetime(2024, 3, 13, 9)
    show = lambda t: (str(resolve(t, now).start.date()), str(resolve(t, now).end.date()))
    assert show("today") == ("2024-03-13", "2024-03-14")
    assert show("lastWeek") == ("2024-03-04", "2024-03-11")
    assert show("lastQuarter") == ("2023-10-01", "2024-01-01")
    assert show("2024-01-01,2024-01-31") == ("2024-01-01", "2024-02-01")
    with pytest.raises(ValueError):
        resolve("someday", now)


def test_unit_file():
    kwh = read_units("-- energy --\nkilowatt_hour,kWh; kg1m2sec-2; 3600000.0\n")[1]
    assert (kwh.id, kwh.quantity, kwh.scale, kwh.dimension[:3]) == ("kWh", "energy", 3600000.0, (1, 2, -2))


def test_ontology():
    space = ontology.Namespace.build([ontology.Def("marker"), ontology.Def("water", ("marker",)), ontology.Def("hot", ("marker",)), ontology.Def("hot-water", ("water",))])
    assert space.fits("hot-water", "marker")
    assert space.all_subs("water") == {"hot-water"}
    assert space.reflect(["hot", "water"]) == {"hot", "water", "hot-water", "marker"}
    with pytest.raises(ontology.OntologyError):
        ontology.Namespace.build([ontology.Def("a", ("b",)), ontology.Def("b", ("a",))])


def test_query_text():
    q = graph_dsl.parse('MATCH function WHERE a = "x" AND (b LIKE "y*" OR c IN "1,2") CALLEES depth=2 LIMIT 7')
    assert (q.kind, q.direction, q.depth, q.limit) == ("function", "callees", 2, 7)
    assert [[t.op for t in c] for c in q.tests] == [["equals", "starts_with"], ["equals", "in"]]
    with pytest.raises(graph_dsl.GraphQueryError):
        graph_dsl.parse("MATCH WHERE a ~ b")


def test_current_rule_upserts_and_repeats(spark, tmp_path):
    """A rule on a file stream: each batch's outputs replace the key's earlier one."""
    from pyspark.sql import functions as F

    from tagweave.streaming import rules

    source = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 5.0), (2, "2024-01-01 00:00:00", 60.0)], "id int, ts string, v double").coalesce(1).write.parquet(str(source))
    held = {}

    def write(batch, number):
        held.update({r.id: r.output for r in batch.collect()})

    def run():
        query = rules.run_current_rule(rules.read_table_stream(spark, str(source)), "id", F.col("v") > 50, write, str(tmp_path / "state"), "1 second")
        query.processAllAvailable()
        query.stop()

    run()
    assert held == {1: False, 2: True}
    spark.createDataFrame([(1, "2024-01-01 00:01:00", 70.0)], "id int, ts string, v double").coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert held == {1: True, 2: True}


def test_windows_over_streams(spark, tmp_path):
    from tagweave.streaming import rules

    rows = [(1, f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 60, 10)]
    spark.createDataFrame(rows, "id int, t string, v double").selectExpr("id", "CAST(t AS TIMESTAMP) AS ts", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rules.read_table_stream(spark, str(tmp_path / "in"))
    out = rules.drain(rules.sliding_means(stream, "id", "v", "30 minutes", "15 minutes"), "complete", str(tmp_path / "a"))
    assert {(r.start.hour, r.start.minute): r.n for r in out.collect()} == {(23, 45): 2, (0, 0): 3, (0, 15): 3, (0, 30): 3, (0, 45): 1}
