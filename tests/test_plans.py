"""Plans stay what they were tuned to be."""

from loomwright import registry
from loomwright.plans import inspect

QUERIES, _ = registry.load()


def test_scan_takes_filters_and_columns(spark, small):
    df = QUERIES["s1_parquet"](spark, small)
    assert any("GreaterThan(l_quantity,45.0)" in f for f in inspect.pushed_filters(df))
    assert all("l_tax" not in c for c in inspect.columns_read(df))
    assert inspect.shuffles(df) == 0


def test_group_by_shuffles_once(spark, small):
    assert inspect.shuffles(QUERIES["pricing_summary"](spark, small)) == 1


def test_as_of_and_interval_joins_have_no_nested_loop(spark, small):
    for name in ("j9_asof_join", "j10_interval_join"):
        plan = inspect.operators(QUERIES[name](spark, small))
        assert not plan["BroadcastNestedLoopJoin"] and not plan["CartesianProduct"]


def test_built_ins_run_no_python(spark, small):
    for name in ("f1_strings", "f8_math", "f12_json", "w1_ranking", "star_join", "j9_asof_join"):
        assert inspect.python_nodes(QUERIES[name](spark, small)) == []
    assert inspect.python_nodes(QUERIES["x2_arrow_udf"](spark, small))


def test_built_ins_of_the_new_queries_run_no_python(spark, small):
    for name in ("j3_overlap_join", "w9_running_totals", "g6_exact_percentiles", "f14_from_xml", "j8_lateral_join", "g13_estimates"):
        assert inspect.python_nodes(QUERIES[name](spark, small)) == []
