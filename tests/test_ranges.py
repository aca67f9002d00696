"""Range joins, running totals and percentiles against loops; hot values, nulls, empty tables; what one task gets."""

import datetime as dt
import itertools
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright import registry
from loomwright.operators import ranges
from loomwright.plans import inspect

QUERIES, _ = registry.load()
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SPANS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 40)), st.one_of(st.none(), st.integers(0, 45))), max_size=25)


@SLOW
@given(SPANS, SPANS, st.sampled_from([(4, 9), (1000, 1 << 22)]))
def test_overlap_join_is_the_nested_loop(spark, left, right, sizes):
    a = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(left)], "i int, x int, y int")
    b = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(right)], "j int, u int, v int")
    got = ranges.overlap_join(a, b, ("x", "y"), ("u", "v"), *sizes).select("i", "j").collect()
    span = lambda s: None not in s and s[0] <= s[1]
    want = [(i, j) for (i, s), (j, t) in itertools.product(enumerate(left), enumerate(right)) if span(s) and span(t) and s[0] <= t[1] and t[0] <= s[1]]
    assert sorted(map(tuple, got)) == sorted(want)


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=30), st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=30), st.booleans())
def test_less_join_is_the_nested_loop(spark, left, right, or_equal):
    a = spark.createDataFrame(list(enumerate(left)), "i int, x int")
    b = spark.createDataFrame(list(enumerate(right)), "j int, _at int")
    got = ranges.less_join(a, b, "x", "_at", or_equal, pairs=16).select("i", "j").collect()
    ok = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    want = [(i, j) for (i, x), (j, y) in itertools.product(enumerate(left), enumerate(right)) if x is not None and y is not None and ok(x, y)]
    assert sorted(map(tuple, got)) == sorted(want)


@SLOW
@given(SPANS, SPANS, st.sampled_from([2, 1 << 16]))
def test_overlap_totals_are_those_of_the_nested_loop(spark, left, right, part_rows):
    a = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(left)], "i int, x int, y int")
    b = spark.createDataFrame([(j if j % 3 else None, x, y) for j, (x, y) in enumerate(right)], "j long, u int, v int")
    got = ranges.overlap_totals(a, b, ("x", "y"), ("u", "v"), part_rows, n=F.lit(1), total=F.col("j")).select("i", "n", "total").collect()
    span = lambda s: None not in s and s[0] <= s[1]
    want = []
    for i, s in enumerate(left):
        met = [j for j, t in enumerate(right) if span(s) and span(t) and s[0] <= t[1] and t[0] <= s[1]]
        some = [j for j in met if j % 3]
        want += [(i, len(met), sum(some) if some else None)] if met else []
    assert sorted(map(tuple, got)) == want


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=30), st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=30), st.booleans())
def test_less_totals_are_those_of_the_nested_loop(spark, left, right, or_equal):
    a = spark.createDataFrame(list(enumerate(left)), "i int, x int")
    b = spark.createDataFrame(list(enumerate(right)), "j int, _key int")
    of = {"n": ("sum", F.lit(1)), "least": ("min", F.col("i")), "most": ("max", F.col("x"))}
    got = ranges.less_totals(a, b, "x", "_key", or_equal, 2, **of).select("j", *of).collect()
    ok = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    met = {j: [(i, x) for i, x in enumerate(left) if x is not None and y is not None and ok(x, y)] for j, y in enumerate(right)}
    assert sorted(map(tuple, got)) == [(j, len(m), min(m)[0], max(x for _, x in m)) for j, m in met.items() if m]


def test_a_third_of_the_rows_at_one_value_is_dealt_over_blocks(spark, monkeypatch):
    """AQE off: no key of the join has more rows of a side than a block, whatever the values are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        values = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        a = spark.range(600).select(values.alias("x"), F.col("id").alias("i"))
        b = spark.range(600).select(values.alias("u"), F.col("id").alias("j"))
        for joined in (ranges.overlap_join(a, b, ("x", "x"), ("u", "u"), 64, 400), ranges.less_join(a, b, "x", "u", pairs=400)):
            plan = inspect.operators(joined)
            assert not plan["BroadcastNestedLoopJoin"] and not plan["CartesianProduct"]
        assert ranges.overlap_join(a, b, ("x", "x"), ("u", "u"), 64, 400).count() == 201 * 201 + 399
        seen = []
        monkeypatch.setattr(ranges, "_blocks", lambda n, side, f=ranges._blocks: seen.append(side) or f(n, side))
        assert ranges.less_join(a, b, "x", "u", pairs=400).count() == sum(x < y for x in [7 if i % 3 == 0 else i for i in range(600)] for y in [7 if i % 3 == 0 else i for i in range(600)])
        assert set(seen) == {20}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_blocks_are_not_sent_to_the_driver(spark):
    """A short side, that each of many blocks of the other repeats, isn't broadcast by its size before."""
    small, large = spark.range(40).select(F.col("id").alias("x")), spark.range(4000).select(F.col("id").alias("u"))
    for joined in (ranges.less_join(small, large, "x", "u", pairs=400), ranges.overlap_join(small, large, ("x", "x"), ("u", "u"), 64, 400)):
        assert inspect.operators(joined)["SortMergeJoin"] == 1 and not inspect.operators(joined)["BroadcastHashJoin"]


def test_totals_of_half_the_values_in_common_make_no_pairs(spark):
    """Every span meets every other: 40,000 rows, 400 million pairs."""
    a = spark.range(20_000).select("id", F.lit(0).alias("x"), (F.col("id") + 1).alias("y"))
    assert ranges.overlap_totals(a, a.withColumnsRenamed({"id": "j", "x": "u", "y": "v"}), ("x", "y"), ("u", "v"), n=F.lit(1)).agg(F.sum("n")).first()[0] == 20_000**2
    assert ranges.less_totals(a, a.select(F.col("id").alias("u")), "id", "u", n=("sum", F.lit(1))).agg(F.sum("n")).first()[0] == 20_000 * 19_999 // 2


def test_queries_without_equal_keys_have_no_nested_loop(spark, small):
    for name in ("j3_overlap_join", "j3_inequality_join"):
        plan = inspect.operators(QUERIES[name](spark, small))
        assert not plan["BroadcastNestedLoopJoin"] and not plan["CartesianProduct"], name


ROWS = st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.integers(-5, 5))), max_size=30)


@SLOW
@given(ROWS)
def test_running_totals_are_sums_up_to_the_row_and_its_peers(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, t int, v int")
    got = {r.i: (r.n, r.total) for r in ranges.running(df, ["k"], ["t"], part_rows=3, n=F.lit(1).cast("long"), total=F.col("v")).collect()}
    for i, (k, t, _) in enumerate(rows):
        upto = [r for r in rows if r[0] == k and (r[1] is None or (t is not None and r[1] <= t))]
        values = [r[2] for r in upto if r[2] is not None]
        assert got[i] == (len(upto), sum(values) if values else None)


def test_no_window_of_running_totals_holds_a_key(spark):
    """One key: its rows are numbered by parts of at most a few times part_rows rows."""
    df = spark.range(4000).select(F.lit("a").alias("k"), F.col("id"))
    found = ranges.running(df, ["k"], ["id"], part_rows=100, n=F.lit(1).cast("long"))
    assert found.filter("n <> id + 1").count() == 0 and found.count() == 4000
    bounds = ranges.bounds_of(df, F.struct(F.col("k").alias("k0"), F.col("id").alias("k1")), 40)
    placed = df.withColumn("b", bounds.select("bounds").scalar()).withColumn("p", ranges.part_of(F.struct(F.col("k").alias("k0"), F.col("id").alias("k1")), "b", 40))
    assert placed.groupBy("p").count().agg(F.max("count")).first()[0] < 400


@SLOW
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.one_of(st.none(), st.integers(0, 9))), max_size=40))
def test_percentiles_are_exact(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: (r.low, r.mid, r.high) for r in ranges.percentiles(df, ["k"], "v", part_rows=3, low=0.0, mid=0.5, high=0.9).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        values = [v for j, v in rows if j == k and v is not None]
        want = (min(values), statistics.median(values), float(np.quantile(values, 0.9))) if values else (None,) * 3
        assert got[k] == pytest.approx(want) if values else got[k] == want


def test_percentiles_of_a_large_group_order_few_parts(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 5000).alias("v"))
    assert ranges.percentiles(df, ["k"], "v", part_rows=100, m=0.5, p=0.99).collect() == [(1, 2499.5, 4949.01)]
    with pytest.raises(ValueError, match="between 0 and 1"):
        ranges.percentiles(df, ["k"], "v", m=50)


def test_spans_of_times(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, t, t + dt.timedelta(hours=1)), (2, t + dt.timedelta(days=9), t + dt.timedelta(days=9))], "i int, x timestamp_ntz, y timestamp_ntz")
    b = spark.createDataFrame([(t + dt.timedelta(hours=1),), (t + dt.timedelta(days=30),)], "u timestamp_ntz")
    assert ranges.overlap_join(a, b, ("x", "y"), ("u", "u")).select("i").collect() == [(1,)]
