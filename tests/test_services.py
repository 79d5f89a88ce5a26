"""Writers, caches, stored templates, projects, normalised definitions, path searches."""

import itertools
import json
import os
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.engine import Engine, Workspace
from tagweave.functions import calls
from tagweave.functions.filters import Symbol
from tagweave.operators import graph, graph_dsl, grid, normalize, ontology, search, usage
from tagweave.plans import templates
from tagweave.sources import readers
from tagweave.sources.values import MARKER
from tagweave.sources.zinc import read_zinc


def test_files_of_every_form_are_read_again(spark, tmp_path):
    rows = [(i, f'say "{i}" $x\\ and\nmore', i % 2 == 0, None if i % 3 else 1.5 * i) for i in range(50)]
    frame = spark.createDataFrame(rows, "k long, text string, even boolean, x double").repartition(3)
    for form in ("csv", "json", "zinc", "trio"):
        readers.write_files(frame, f"{tmp_path}/{form}", form)
        assert len([f for f in os.listdir(f"{tmp_path}/{form}") if f.startswith("part-")]) == 3
    assert sorted(r.k for r in spark.read.json(f"{tmp_path}/json").collect()) == list(range(50))
    grids = [read_zinc(open(f"{tmp_path}/zinc/{f}").read()) for f in os.listdir(f"{tmp_path}/zinc") if f.startswith("part-")]
    found = sorted((r for g in grids for r in g.rows), key=lambda r: r["k"].value)
    assert [(int(r["k"].value), r["text"], r["even"], r["x"].value if r.get("x") else None) for r in found] == rows
    with pytest.raises(ValueError):
        readers.write_files(frame, f"{tmp_path}/no", "no")


def test_cache_is_made_again_when_a_source_is_newer(spark, tmp_path):
    source = f"{tmp_path}/source"
    spark.range(3).write.parquet(source)
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS x")

    cache = readers.Cache(spark, f"{tmp_path}/cache", most_age_s=3600)
    assert cache.made_at("t") is None and cache.is_stale("t", [source])
    assert cache.table("t", [source], make).count() == 3 and cache.table("t", [source], make).count() == 3
    assert len(made) == 1
    for f in os.listdir(source):
        os.utime(f"{source}/{f}", (time.time() + 60, time.time() + 60))
    assert cache.is_stale("t", [source]) and cache.table("t", [source], make).count() == 3 and len(made) == 2
    for f in os.listdir(source):
        os.utime(f"{source}/{f}", (1e9, 1e9))
    assert not cache.is_stale("t", [source]) and cache.is_stale("t", [source], now=time.time() + 4000)
    cache.clear("t")
    assert cache.made_at("t") is None


def test_stored_templates(spark, tmp_path):
    good = {"id": "a", "name": "A", "category": "c", "template": "x {{p}}", "parameters": [{"name": "p", "type": "date", "description": "d"}]}
    bad = {"id": "b", "name": "B", "template": "{{q}}", "parameters": [{"name": "p", "type": "date"}, {"name": "free", "type": "s", "description": "d", "required": False}]}
    os.makedirs(f"{tmp_path}/deep/er")
    for k, t in enumerate((good, bad, {"id": "n", "name": "N", "category": "c", "template": "t"})):
        with open(f"{tmp_path}/{'deep/er/' if k else ''}{k}.json", "w") as f:
            json.dump(t, f, indent=1)
    stored = templates.load(spark, str(tmp_path))
    assert stored.count() == 3
    found = {}
    for r in templates.problems(stored).collect():
        found.setdefault(r.id, set()).add(r.problem)
    assert found == {"b": {"missing category", "no type or description: p", "no parameter for q", "not used: p"}, "n": {"missing parameters"}}


def test_projects(spark):
    one, two = (Engine(spark, {"t": spark.range(n)}) for n in (1, 2))
    space = Workspace().add("a", one).add("a", two, "other")
    assert space.list() == ["default/a", "other/a"] and space.list("other") == ["other/a"]
    assert space.engine is one and space.use("a", "other") is two and space.engine is two
    with pytest.raises(grid.GridError):
        space.use("b")
    with pytest.raises(grid.GridError):
        _ = Workspace().engine


def _s(*names):
    return [Symbol(n) for n in names]


CORE = [
    {"def": Symbol("marker")}, {"def": Symbol("val")}, {"def": Symbol("feature")}, {"def": Symbol("list"), "is": _s("val")}, {"def": Symbol("str"), "is": _s("val")}, {"def": Symbol("ref"), "is": _s("val")},
    {"def": Symbol("is"), "is": _s("list")}, {"def": Symbol("tagOn"), "is": _s("list")}, {"def": Symbol("of"), "is": _s("val")}, {"def": Symbol("choice"), "is": _s("marker")}, {"def": Symbol("relationship"), "is": _s("marker")},
    {"def": Symbol("feeds"), "is": _s("relationship")}, {"def": Symbol("doc"), "is": _s("str")}, {"def": Symbol("secret"), "is": _s("str"), "notInherited": MARKER}, {"def": Symbol("notInherited"), "is": _s("marker")}, {"def": Symbol("lib"), "is": _s("feature")},
]


def _problems(*records, more=()):
    return set(normalize.normalize([normalize.Lib("core", (), (*CORE, *records)), *more]).problems)


def test_definitions_without_problems():
    out = normalize.normalize([normalize.Lib("core", (), (*CORE, {"def": Symbol("a"), "is": Symbol("marker"), "doc": "of a", "secret": "s"}, {"def": Symbol("b"), "is": _s("a")}, {"def": Symbol("lib:x")}))])
    assert out.problems == []
    assert out.defs["b"]["doc"] == "of a" and "secret" not in out.defs["b"] and out.defs["lib:x"]["is"] == _s("lib")
    space = out.namespace()
    assert space.all_supers("b") == {"a", "marker"} and space.feature_names() == ["lib"]
    assert space.kind_of("doc") == "str" and space.kind_of("b") == "marker" and space.kind_of("tagOn") == "list"
    site = ontology.Namespace.build([ontology.Def("marker"), ontology.Def("equip", ("marker",), mandatory=True), ontology.Def("hot", ("marker",)), ontology.Def("water", ("equip",)), ontology.Def("hot-water", ("water",))])
    assert site.implementation("hot-water") == ["hot", "water", "equip"] and site.fits("hot-water", "equip")
    assert site.reflect(["hot", "water"]) == {"hot", "water", "hot-water", "equip", "marker"}


def test_problems_of_definitions():
    assert ("defined twice", "doc", "") in _problems({"def": Symbol("doc"), "is": _s("str")})
    assert ("no supertype", "lone", "is") in _problems({"def": Symbol("lone")})
    assert ("feature declares its supertype", "lib:y", "is") in _problems({"def": Symbol("lib:y"), "is": _s("lib")})
    assert ("is no str", "a", "doc") in _problems({"def": Symbol("a"), "is": _s("marker"), "doc": True})
    assert ("relationship on no ref", "a", "feeds") in _problems({"def": Symbol("a"), "is": _s("marker"), "feeds": MARKER})
    assert ("reserved name", "index", "") in _problems({"def": Symbol("index"), "is": _s("marker")})
    assert ("part is no marker", "hot-doc", "doc") in _problems({"def": Symbol("hot"), "is": _s("marker")}, {"def": Symbol("hot-doc"), "is": _s("marker")})
    assert ("choice of no marker", "c", "doc") in _problems({"def": Symbol("c"), "is": _s("choice"), "of": Symbol("doc")})
    assert ("tagOn on a conjunct or feature", "x-y", "tagOn") in _problems({"def": Symbol("x"), "is": _s("marker")}, {"def": Symbol("y"), "is": _s("marker")}, {"def": Symbol("x-y"), "is": _s("marker"), "tagOn": _s("x")})
    assert ("extension overwrites", "doc", "is") in _problems(more=[normalize.Lib("more", ("core",), ({"defx": Symbol("doc"), "is": _s("val")},))])
    assert ("outside the library's scope", "z", "marker") in _problems(more=[normalize.Lib("more", (), ({"def": Symbol("z"), "is": _s("marker")},))])
    assert ("library not found", "more", "gone") in _problems(more=[normalize.Lib("more", ("core", "gone"), ())])
    assert ("neither def nor extension", "core", "") in _problems({"doc": "x"}) and ("library without a name", "", "") in _problems(more=[normalize.Lib("")])
    for bad in ({"def": Symbol("a"), "is": _s("nowhere")}, {"def": Symbol("a"), "is": _s("a")}):
        with pytest.raises(ontology.OntologyError):
            _problems(bad)


def test_paths_against_plain_search(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        arcs = {(int(a), int(b)) for a, b in rng.integers(0, 9, (22, 2)) if a != b}
        edges = spark.createDataFrame(sorted(arcs), "src int, dst int").withColumn("kind", F.lit("calls"))
        paths = [p for n in range(2, 8) for p in itertools.permutations(range(9), n) if p[0] == 0 and p[-1] == 8 and all(x in arcs for x in itertools.pairwise(p))]
        for through, avoid in (([], []), ([3], []), ([2, 4], [5])):
            fit = sorted((len(p) - 1, [str(x) for x in p]) for p in paths if set(through) <= set(p) and not set(avoid) & set(p))
            found = [(r.length, r.path) for r in graph.constrained_path(edges, "0", "8", through, avoid, 6).collect()]
            assert found == fit[:1]
        every = sorted([str(x) for x in p] for p in paths)
        assert sorted(r.path for r in graph.simple_paths(edges, "0", "8", 6).collect()) == every


def test_path_ends_are_found_among_many_of_a_name(spark):
    nodes = spark.range(500).selectExpr("id", "CASE WHEN id < 499 THEN 'many' ELSE 'end' END AS name", "'f' AS kind")
    edges = spark.createDataFrame([(0, 7), (7, 499)], "src long, dst long").withColumn("kind", F.lit("calls"))
    assert graph_dsl.parse('PATH FROM "many" TO "end" maxDepth=4').run(nodes, edges).first().path == ["0", "7", "499"]


def test_graph_ids_stay(spark):
    functions = spark.createDataFrame([("a.txt", "m.load", 3, "save(x)"), ("b.txt", "m.save", 9, "other()")], "file string, qualified string, line int, source string")
    nodes, edges, unresolved = graph.build_graph(functions)
    again = graph.build_graph(functions.repartition(2))[0]
    assert {r.id: r.name for r in nodes.collect()} == {r.id: r.name for r in again.collect()}
    by = {r.name: r.id for r in nodes.collect()}
    assert [(r.src, r.dst) for r in edges.collect()] == [(by["load"], by["save"])]
    assert [(r.src, r.name) for r in unresolved.collect()] == [(by["save"], "other")]


def test_calls_of_a_text(spark):
    frame = spark.createDataFrame([(1, "read(a, b)\nsites.map(toRec)\nnow() + f( x )")], "id int, t string")
    found = {(r.name, r.n_args) for r in usage.calls_with_arguments(frame, "id", "t").collect()}
    assert found == {("read", 2), ("map", 1), ("now", 0), ("f", 1)}
    forms = {(r.line, r.name, r.receiver, r.form) for r in graph.extract_usages(frame, "id", "t").collect()}
    assert forms == {(1, "read", None, "call"), (2, "map", "sites", "method"), (2, "toRec", None, "reference"), (3, "now", None, "call"), (3, "f", None, "call")}


CALLS = {
    "readAll(site)": [("readAll", 1, None)],
    "add(1, 2, 3)": [("add", 3, None)],
    "now()": [("now", 0, None)],
    "add(1, _)": [("add", 2, None)],
    'readAll(site).sort("name")': [("readAll", 1, None), ("sort", 1, None)],
    "data.size": [],
    "list[0] rec->dis": [],
    "list.or(a)": [("or", 1, None)],
    "core::readAll(site)": [("readAll", 1, None)],
    "do\n  someFunc()\n  [1, 2]\nend": [("someFunc", 0, None)],
    "rewrite(id) (v, ts) => do\n  if (v == nan()) return null\n  [ts, v]\nend": [("rewrite", 2, None), ("nan", 0, None)],
    "rows.each((r, i) => f(r, i))": [("each", 1, None), ("f", 2, "each")],
    "map(rows) r => g(r)": [("map", 2, None), ("g", 1, None)],
    "f((a, b) => a, [1, 2], {a: 1, b: 2})": [("f", 3, None)],
    "f(g(h(1), 2), h())": [("f", 2, None), ("g", 2, "f"), ("h", 1, "g"), ("h", 0, "f")],
    "f((g(1, 2)), 3)": [("f", 2, None), ("g", 2, "f")],
    'f("g(1, 2)", `h(1)`) // k(1)\n/* z(1)': [("f", 2, None)],
    '"a\\"b(1)" c(2)': [("c", 1, None)],
    'r"\\" d(1)': [("d", 1, None)],
    '\"\"\"a(1)\nb()\"\"\" c(2)': [("c", 1, None)],
    '"open a(1)\nb(2)': [("b", 1, None)],
    "a\n(b + c)": [],
    "f(]1, 2) g(": [("f", 2, None), ("g", 0, None)],
    "f([1, 2) + g(3)": [("f", 1, None), ("g", 1, None)],
}


def test_calls_by_tokens(spark):
    for text, expected in CALLS.items():
        assert [(c["name"], c["n_args"], c["outer"]) for c in calls.calls_of(text)] == expected, text
    text = "load: (x, y: 3) => do\n  helper: (z) => go(z)\n  save(x,\n    y)\nend\nother: x => put(x)\nfoo(1)"
    assert [(c["name"], c["line"], c["definition"]) for c in calls.calls_of(text)] == [("go", 2, "load"), ("save", 3, "load"), ("put", 6, "other"), ("foo", 7, None)]
    rows = [(1, "f(g(1), 2)", "x"), (1, "f(g(1), 2)", "x"), (2, None, "x"), (3, "", None), (None, "h()", "y")]
    frame = spark.createDataFrame(rows, "id int, t string, name string")
    got = sorted(((r.id or 0, r.seq, r.name, r.n_args, r.depth) for r in calls.calls(frame, "id", "t").collect()))
    assert got == [(0, 0, "h", 0, 0), (1, 0, "f", 2, 0), (1, 0, "f", 2, 0), (1, 1, "g", 1, 1), (1, 1, "g", 1, 1)]
    assert calls.calls(frame.limit(0), "id", "t").count() == 0


@settings(deadline=None)
@given(st.recursive(st.just(()), lambda inner: st.lists(st.one_of(st.none(), inner), max_size=4).map(tuple), max_leaves=12))
def test_calls_of_random_nesting(tree):
    """A call is a tuple of arguments, each another call or a number."""
    expected = []

    def write(call, outer, depth):
        name = f"f{len(expected)}"
        expected.append((name, len(call), outer, depth))
        return f"{name}({', '.join('1' if a is None else write(a, name, depth + 1) for a in call)})"

    text = write(tree, None, 0)
    assert [(c["name"], c["n_args"], c["outer"], c["depth"]) for c in calls.calls_of(text)] == expected


def test_calls_of_long_texts_are_linear():
    n = 200_000
    for text, found in (("f(" * n, n), (")" * n, 0), ('"' * (n + 1), 0), ("/*" * n, 0), ("f(a, " * n + ")" * n, n), ("([{" * n + "]" * n, 0), ("(" * n + "g() " * n, n)):
        start = time.monotonic()
        assert len(calls.calls_of(text)) == found and time.monotonic() - start < 20


def test_operators_in_runs(spark):
    """Counted in the runs as they are in the whole text."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("=!<>+-*/%&|^~?:. a\n"), 60)) for _ in range(200)] + ["", None, "a...b", "-" * 50, "plain. text: yes?"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    expected = {(i, o): len(re.findall(search.operator_pattern(o), t)) for i, t in enumerate(texts) if t for o in search.OPERATORS}
    got = {(r.id, r.operator): r.n for r in search.operator_counts(frame, "id", "t").collect()}
    assert got == {k: n for k, n in expected.items() if n}
    both = {r.id for r in search.search_operators(search.operator_counts(frame, "id", "t"), "id", ["->", "&&"]).collect()}
    assert both == {i for i, _ in enumerate(texts) if expected.get((i, "->")) and expected.get((i, "&&"))} and both


def test_positions_of_grids(spark):
    frame = spark.range(10).selectExpr("id AS k", "id * 2 AS v").repartition(4)
    more = spark.createDataFrame([(100, 1), (101, 2)], "k long, v long")
    put = sorted((r.position, r.k) for r in grid.insert(frame, ["k"], 4, more, ["k"]).collect())
    assert [k for _, k in put] == [0, 1, 2, 3, 100, 101, 4, 5, 6, 7, 8, 9] and [p for p, _ in put] == list(range(12))
    assert sorted(r.position for r in grid.insert(frame, ["k"], 99, more, ["k"]).where("k >= 100").collect()) == [10, 11]
    assert grid.get(frame, ["k"], 3).first().v == 6 and grid.get(frame, ["k"], 10).isEmpty() and grid.last(frame, ["k"]).first().k == 9
    assert grid.length(grid.clear(frame)).first().asDict() == {"n": 0, "empty": True}


def test_page_rank_against_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    arcs = [(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))]
    edges = spark.createDataFrame(arcs, "src long, dst long")
    rank = dict.fromkeys(range(11), 1 / 11)  # node 11 isn't listed
    for _ in range(7):
        rank = {v: 0.15 / 11 + 0.85 * sum(rank[a] / sum(x == a for x, _ in arcs) for a, b in arcs if b == v and a in rank) for v in rank}
    for few in (100_000, 0):
        monkeypatch.setattr(graph, "FEW", few)
        found = {r.id: r["rank"] for r in graph.page_rank(spark.range(11), edges, 7).collect()}
        assert set(found) == set(rank) and all(abs(found[v] - rank[v]) < 1e-12 for v in rank)
        near = {r.id: r.depth for r in graph.reach(edges, spark.range(1), 12).collect()}
        seen, level, depth = set(), {0}, {}
        for k in range(1, 13):
            level = {b for a, b in arcs if a in level} - seen
            seen |= level
            depth |= dict.fromkeys(level, k)
        assert near == depth


def test_nearest_against_plain_cosines(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    data += [(200 + i, data[i][1]) for i in range(30)]  # copies tie
    data += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [1.0, 2.0]), (304, [2.0, 4.1]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    whole = {i: np.array(v, np.float32).astype(float) for i, v in data if i is not None and v and None not in v and any(v)}
    asked = [0, 50, 100, 200, 300, 301, 303]
    queries = frame.where(F.col("vec_id").isin(asked))
    expect = {}
    for q in asked:
        if q in whole:
            all_ = [(-round(float(v @ whole[q] / np.linalg.norm(v) / np.linalg.norm(whole[q])), 12), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
            expect[q] = [(i, -s) for s, i in sorted(all_)[:5]]
    for block, held in ((1000, 4_000_000), (2, 30)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "HELD_SCORES", held)
        found = {}
        for r in search.nearest(frame, queries, 5).collect():
            found.setdefault(r["query"], []).append((-r.score, r.vec_id))
        assert {q: [i for _, i in sorted(x)] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in expect.items()}
    assert search.nearest(frame, queries.limit(0), 5).count() == 0 and search.nearest(frame.limit(0), queries, 5).count() == 0
    assert {r["query"] for r in search.nearest(frame, queries, 3, least=0.999999).collect()} == {0, 200}


def test_nearest_skips_cells_that_hold_none_of_the_best(spark, monkeypatch):
    """Clustered rows in many cells and parts, some keys repeated: the answers are those of
    all pairs."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 12)) * 5
    data = [(i, (centres[i % 8] + rng.normal(size=12)).tolist()) for i in range(9000)]
    data += [(i, (centres[0] + rng.normal(size=12)).tolist()) for i in range(3)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    asked = frame.where("vec_id % 900 = 0 OR vec_id = 1")
    monkeypatch.setattr(search, "PART_ROWS", 300)
    keys, rows = np.array([i for i, _ in data]), np.array([v for _, v in data])
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    for least in (None, 0.97):
        expect = {}
        for q in {i for i, _ in data if i % 900 == 0 or i == 1}:
            every = [(-round(float(s), 9), int(i)) for u in units[keys == q] for i, s in zip(keys, units @ u) if i != q and (least is None or s >= least)]
            expect[q] = sorted(every)[:7]
        found = {q: [] for q in expect}
        frame_ = search.nearest(frame, asked, 7, least=least)
        for r in frame_.collect():
            found[r["query"]].append((-round(r.score, 9), r.vec_id))
        assert {q: sorted(x) for q, x in found.items()} == expect


def test_suggestions_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 12))) for _ in range(160)] + ["readAll", "readAlll", "redAl", "hisRead"]
    known = spark.createDataFrame([(w,) for w in words[::2]] + [(None,), (words[0],)], "name string")
    unknown = spark.createDataFrame([(w,) for w in words[1::2]] + [(None,), (words[1],)], "name string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return row[-1]

    for most in (1, 2, 3):
        expect = {(a, b, edits(a, b)) for a in words[1::2] for b in words[::2] if 0 < edits(a, b) <= most}
        found = [tuple(r) for r in usage.suggestions(unknown, known, most, 10**6).collect()]
        assert len(found) == len(set(found)) and set(found) == expect


def test_changed_tables_in_folders(spark, tmp_path):
    """A table may be a folder of files: one row a table, of all its rows, also without any."""
    import __spark_entry__

    spark.range(10).withColumnRenamed("id", "o_orderkey").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["files_changed"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == [("documents.parquet", True, False, 0), ("orders.parquet", True, False, 10)]
