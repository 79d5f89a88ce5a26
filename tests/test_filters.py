from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.functions import units
from tagweave.functions.filters import All_, Any_, Compare, FilterBuilder, FilterError, Has, IsA, Missing, Model, Quantity, Ref, Related, Upward, apply_filter, parse
from tagweave.operators import grid


def test_precedence_and_terms():
    assert parse("a or b and not c") == Any_((Has(("a",)), All_((Has(("b",)), Missing(("c",))))))
    assert parse("(a or b) and c->d == @x") == All_((Any_((Has(("a",)), Has(("b",)))), Compare(("c", "d"), "==", Ref("x"))))
    assert parse("^hot-water") == IsA("hot-water")
    assert parse("inputs? ^hot-water @r1") == Related("inputs", "hot-water", "r1")
    assert parse("id *== @top") == Upward(("id",), "top")
    assert parse("d >= 2024-02-29 and n < -3.5kWh") == All_((Compare(("d",), ">=", date(2024, 2, 29)), Compare(("n",), "<", Quantity(-3.5, "kWh"))))


@pytest.mark.parametrize("text", ["a = 1", "not (a)", "a and", "a ==", ")", "a == b", "(a"])
def test_rejects(text):
    with pytest.raises(FilterError):
        parse(text)


_paths = st.lists(st.from_regex(r"[a-z][a-z0-9]{0,4}", fullmatch=True).filter(lambda x: x not in ("and", "or", "not", "true", "false")), min_size=1, max_size=3).map(tuple)
_values = st.one_of(st.booleans(), st.text(max_size=8), st.integers(-1000, 1000).map(lambda n: Quantity(float(n))), st.dates())
_leaf = st.one_of(_paths.map(Has), _paths.map(Missing), st.builds(Compare, _paths, st.sampled_from(["==", "!=", "<", ">="]), _values))


def _flat(kind, parts):
    out = []
    for p in parts:
        out.extend(p.parts if isinstance(p, kind) else [p])
    return kind(tuple(out))


_tree = st.recursive(_leaf, lambda s: st.lists(s, min_size=2, max_size=3).flatmap(lambda p: st.sampled_from([_flat(Any_, p), _flat(All_, p)])), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(_tree)
def test_text_round_trip(node):
    assert parse(str(node)) == node


def test_builder():
    assert FilterBuilder().has("site").and_().opened().greater("area", 10).or_().missing("x").closed().build() == "site and ( area > 10 or not x )"


def test_null_and_kinds(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True), (2, None, None, False), (3, "b", 2.0, None)], "id int, s string, n double, m boolean")
    ids = lambda f, **k: sorted(r.id for r in apply_filter(df, f, **k).collect())
    assert ids("s") == [1, 3]
    assert ids("m") == [1, 2]
    assert ids("not s") == [2]
    assert ids('s != "a"') == [3]
    assert ids("s == 1") == []
    assert ids("missing or n >= 2") == [3]
    assert ids("not missing and n < 2") == [1]


def test_units_in_filters(spark):
    df = grid.with_column_meta(spark.createDataFrame([(1, 30.0), (2, 90.0)], "id int, d double"), "d", unit="min")
    assert [r.id for r in apply_filter(df, "d > 1h").collect()] == [2]
    assert apply_filter(df, "d == 30").count() == 0
    with pytest.raises(FilterError):
        apply_filter(df, "d > 1kWh").count()


def test_references_join_once(spark):
    sites = spark.createDataFrame([("s1", "north"), ("s2", None)], "id string, area string")
    equips = spark.createDataFrame([("e1", "s1"), ("e2", "s2"), ("e3", None)], "id string, siteRef string")
    model = Model(refs={"siteRef": (sites, "id")})
    found = apply_filter(equips, 'siteRef->area == "north" or not siteRef->area', model)
    assert sorted(r.id for r in found.collect()) == ["e1", "e2", "e3"]
    assert found.columns == ["id", "siteRef"]


def test_unit_algebra():
    assert round(units.convert(212.0, "°F", "°C"), 6) == 100
    assert units.product_unit("kW", "h") == "kWh"
    assert units.product_unit("kWh", "h", divide=True) == "kW"
    with pytest.raises(units.UnitError):
        units.sum_unit("kW", "kWh")
    with pytest.raises(units.UnitError):
        units.convert(1.0, "kW", "m")
