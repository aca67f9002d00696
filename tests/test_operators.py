"""Nulls, ties, empty inputs and random tables."""

import datetime as dt

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright import registry
from loomwright.operators.joins import as_of, within
from loomwright.session import table

QUERIES, _ = registry.load()
T0 = dt.datetime(2024, 1, 1)
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 30), st.integers(0, 5)), max_size=12)
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, names):
    return spark.createDataFrame([(k, T0 + dt.timedelta(minutes=t), v) for k, t, v in rows], f"{names[0]} int, {names[1]} timestamp_ntz, {names[2]} int")


@SLOW
@given(ROWS, ROWS)
def test_as_of_is_the_last_earlier_row(spark, left, right):
    got = as_of(frame(spark, left, ("k", "t", "id")), frame(spark, right, ("k", "t", "v")), "k", "t", ["v"]).collect()
    want = []
    for k, t, i in left:
        before = [(s, v) for j, s, v in right if k is not None and j == k and s <= t]
        want.append((k, T0 + dt.timedelta(minutes=t), i, max(before)[1] if before else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_as_of_crosses_buckets_and_own_names_stay(spark):
    rows = frame(spark, [(1, 3000, 1), (1, 5, 2), (2, 3000, 3)], ("k", "t", "_side"))
    right = frame(spark, [(1, 2, 7), (1, 9000, 8), (None, 1, 9)], ("k", "t", "_bucket"))
    got = as_of(rows, right, "k", "t", ["_bucket"], seconds=600).collect()
    assert sorted((r["_side"], r["_bucket"]) for r in got if r["_bucket"] is not None) == [(1, 7), (2, 7)] and len(got) == 3


def test_times_without_a_zone_keep_their_order(spark):
    """02:30 doesn't exist that day in New York, where it would be read as later than 03:10."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        early, late = dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 10)
        kind = "k int, t timestamp_ntz, x int"
        rows, right = spark.createDataFrame([(1, late, 1)], kind), spark.createDataFrame([(1, early, 5)], kind.replace("x", "v"))
        assert as_of(rows, right, "k", "t", ["v"], seconds=600).select("v").collect() == [(5,)]
        later = spark.createDataFrame([(1, late, 6)], kind.replace("t ", "u ").replace("x", "y"))
        first = spark.createDataFrame([(1, early, 5)], kind)
        assert within(first, later, "k", "t", "u", 2400).select("x", "y").collect() == [(5, 6)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_as_of_nulls_in_time_and_values(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, T0, 2)], "k int, t timestamp_ntz, id int")
    right = spark.createDataFrame([(1, None, 5), (1, T0, None)], "k int, t timestamp_ntz, v int")
    assert sorted((r["id"], r["v"]) for r in as_of(rows, right, "k", "t", ["v"]).collect()) == [(1, None), (2, None)]


@SLOW
@given(ROWS, ROWS)
def test_within_is_the_theta_join(spark, left, right):
    a, b = frame(spark, left, ("k", "t", "x")), frame(spark, right, ("k", "u", "y"))
    got = within(a, b, "k", "t", "u", 600).select("x", "y").collect()
    want = [(x, y) for k, t, x in left for j, u, y in right if k is not None and k == j and t <= u <= t + 10]
    assert sorted(map(tuple, got)) == sorted(want)


def test_external_source_says_what_is_missing(spark):
    import pytest

    from loomwright.sources.files import read_external

    with pytest.raises(RuntimeError, match="avro needs spark-avro"):
        read_external(spark, "avro", path="/nowhere")


def test_duckdb_is_there():
    assert duckdb.sql("select 1").fetchall() == [(1,)]


def test_sketches_tell_numbers_beside_whether_they_are_close(spark, small):
    """g15_sketches: the exact numbers of the estimates that are close, the median too."""
    got = {r.event_type: r for r in QUERIES["g15_sketches"](spark, small).collect()}
    events = table(spark, small, "events")
    for r in events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"), F.median("value").alias("m")).collect():
        found = got[r.event_type]
        assert (found.users, found.hll, found.theta, found.kll) == (r.n, r.n, r.n, pytest.approx(r.m)) and found.hll_ok and found.theta_ok and found.kll_ok


def test_an_approximate_median_tells_the_number_too(spark, small):
    """g16_more_aggregates: the exact median where the estimate is close, and the type that any row of a type has."""
    medians = {r.event_type: r.m for r in table(spark, small, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("m")).collect()}
    got = QUERIES["g16_more_aggregates"](spark, small).collect()
    assert {r.any_type: r.middle for r in got} == medians and all(r.any_type == r.event_type and r.any_ok and r.middle_ok for r in got)
