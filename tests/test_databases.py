"""Tables in parts: what comes back of odd values, and the queries where executors are processes of their own."""

import datetime as dt
import decimal
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from loomwright.plans import inspect
from loomwright.sources import databases

REPO = Path(__file__).resolve().parent.parent
ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from oracle import same
from loomwright import registry

home, folder, name = sys.argv[1:]
conf = {
    "spark.master": "local-cluster[2,1,1200]", "spark.executor.memory": "700m", "spark.checkpoint.dir": f"file://{home}/shared", "spark.sql.warehouse.dir": f"{home}/warehouse",
    "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
queries, sql = registry.load()
same(queries[name](spark, folder), sql[name], folder)
print("the same as the SQL")
"""


@pytest.mark.parametrize("name", ["s7_jdbc_pushed_filter", "s7_jdbc_round_trip"])
def test_queries_where_executors_are_other_processes(small, tmp_path, name):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {
        "SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": f"{home}/local", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "TZ": "UTC",
        "PYTHONPATH": f"{REPO}:{REPO}/tests", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell",
    }
    for k in [k for k in env if k.startswith(("PYSPARK_GATEWAY", "_PYSPARK"))]:  # not this process's Spark
        del env[k]
    run = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path), small, name], env=env, capture_output=True, text=True, timeout=300)
    assert "the same as the SQL" in run.stdout, [x for x in run.stderr.splitlines() if "Error" in x]


TEXTS = ['a"b', "x,y", "line\nbreak", "", None, "  sp  ", "é😀", "cr\r\nlf\\", '"', "\t\x01", "it's", "x" * 100_000]
KINDS = "k long, s string, `d.x` double, t timestamp_ntz, b boolean, day date, m decimal(10,2), bin binary, at timestamp, n int"


def test_odd_values_come_back_from_parts(spark, monkeypatch):
    """Marks of CSV, empty and long texts, nulls, bytes and instants; no part has more rows than it may."""
    numbers = [1.5, 1e300, None, 0.1, -0.5, 1e-300, 3.0, 4.0, 123456789.12345679, 0.1 + 0.2, 5e-7, 0.0]
    row = lambda i: (i, TEXTS[i], numbers[i], dt.datetime(1997, 1, 1, 1, 2, 3, 456) if i % 3 else None, i % 2 == 0, dt.date(1990 + i, 1, 1), decimal.Decimal("12.34"), bytes([i, 255]), dt.datetime(2020, 6, 1, 0, 0, i), None)
    df = spark.createDataFrame([row(i) for i in range(len(TEXTS))], KINDS)
    monkeypatch.setattr(databases, "PART_ROWS", 5)
    urls = databases.write_parts(df, "odd", parts=2)
    found = databases.read_parts(spark, urls, "odd")
    assert len(urls) == 3 and found.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.withColumn("at", F.col("at").cast("timestamp_ntz")).collect()))
    some = found.filter("k > 3 and b").select("k")
    assert inspect.physical(some).count("*GreaterThan(k,3)") == 3 and "Filter" not in inspect.operators(some)
    assert sorted(r.k for r in some.collect()) == [4, 6, 8, 10]
    none = databases.read_parts(spark, databases.write_parts(df.filter("k < 0"), "odd"), "odd")
    assert none.count() == 0 and none.schema == found.schema


def test_a_part_that_lacks_rows_is_an_error(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "k long, s string")
    with pytest.raises(Exception, match="1 rows were to be loaded"):
        databases.write_parts(df, "short", types="s VARCHAR(2)")


def test_timestamps_come_back_from_parts_in_any_zone(spark):
    """Also before 1582, and at an hour that a zone of Java's has twice."""
    at = [dt.datetime(1, 1, 1), dt.datetime(1500, 2, 28, 1, 2, 3), dt.datetime(1997, 7, 1, 2, 30), dt.datetime(1997, 10, 26, 1, 30, 0, 456), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), None]
    df = spark.createDataFrame(list(enumerate(at)), "k int, `t``s` timestamp_ntz")
    zones = spark._jvm.java.util.TimeZone
    usual = zones.getDefault()
    zones.setDefault(zones.getTimeZone("America/New_York"))
    try:
        found = databases.read_parts(spark, databases.write_parts(df, "moments", parts=2), "moments")
        assert found.dtypes == df.dtypes and sorted(map(tuple, found.collect())) == list(enumerate(at))
    finally:
        zones.setDefault(usual)


@pytest.mark.parametrize("local", [True, False])
def test_orders_with_long_texts_and_nulls(spark, monkeypatch, tmp_path, local):
    monkeypatch.setattr(databases, "local", lambda spark: local)
    day = dt.datetime(1997, 1, 1)
    rows = [(1, 7, "F", 2e5, day, "p" * 33), (2, 7, "x" * 9, 2e5, day, "1-URGENT"), (3, 7, "F", 1.0, None, "")]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/long/orders.parquet")
    assert list(map(tuple, databases.s7_jdbc_pushed_filter(spark, f"{tmp_path}/long").collect())) == [(7, 1, day)]
    rows += [(4, None, None, None, None, "p" * 100_000), (None,) * 6]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/all/orders.parquet")
    assert sorted(map(repr, map(tuple, databases.s7_jdbc_round_trip(spark, f"{tmp_path}/all").collect()))) == sorted(map(repr, rows))
