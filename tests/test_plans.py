"""What the planner makes of compiled operators."""

import pytest

from tagweave.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "flagship_rollup")
    assert "GreaterThan(value,5" in text and "EqualTo(event_type,click)" in text
    schema = text[text.rindex("ReadSchema:") :].split("\n")[0]
    assert "props" not in schema and "event_id" not in schema


def test_a_time_span_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(ts," in plan(spark, "his_read_span")


@pytest.mark.parametrize("name", ["filter_deref_three_hops", "consumption_report"])
def test_dimensions_join_without_a_shuffle(spark, name):
    text = plan(spark, name)
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text


def test_no_python_in_builtin_operators(spark):
    for name in ("rollup_15min_max", "periods_above", "sessionize_gap", "dict_diff_orders", "search_or", "html_sections"):
        assert "Python" not in plan(spark, name) and "Pandas" not in plan(spark, name)


def test_a_saved_index_is_read_by_its_tokens(spark):
    text = plan(spark, "search_saved")
    assert "StringStartsWith(token,licens)" in text and "StringStartsWith(token,the)" in text


def test_vector_search_pairs_no_rows(spark):
    text = plan(spark, "knn_cosine")
    assert "MapInArrow" in text and "NestedLoop" not in text and "CartesianProduct" not in text
    assert text.count("Exchange hashpartitioning(query") >= 1


def test_word_search_shuffles_each_id_once(spark):
    text = catalogue.QUERIES["search_and"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "Window" not in text
