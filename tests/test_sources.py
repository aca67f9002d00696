"""Databases, the logged source and streams with restarts: what is pushed, what a failure leaves, what comes back."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from loomwright.operators import sketches, udfs
from loomwright.plans import inspect
from loomwright.session import table
from loomwright.sources import databases, files, logged
from loomwright.streaming import events


def test_jdbc_reads_parts_and_pushes_filters(spark, small):
    to = databases.embedded(spark)
    orders = table(spark, small, "orders")
    databases.write_jdbc(orders, name="orders", types="o_orderstatus VARCHAR(8)", **to)
    found = databases.read_jdbc(spark, name="orders", column="o_orderkey", parts=4, **to)
    assert found.rdd.getNumPartitions() == 4 and found.count() == orders.count()
    some = found.filter("o_totalprice > 1000 and o_orderstatus = 'F'").select("o_orderkey")
    pushed = inspect.physical(some)
    assert "*GreaterThan(o_totalprice,1000.0)" in pushed and "*EqualTo" in pushed and "Filter" not in inspect.operators(some) and "[numPartitions=4] [o_orderkey" in pushed
    databases.write_jdbc(orders.limit(5), name="orders", mode="append", **to)
    assert found.count() == orders.count() + 5
    databases.write_jdbc(orders.limit(0), name="no_orders", **to)
    assert databases.read_jdbc(spark, name="no_orders", column="o_orderkey", **to).count() == 0


def logged_table(spark, small, parts=2):
    name, path, rows = logged.registered(spark), files.shared_folder(spark), table(spark, small, "events")
    for i in range(parts):
        rows.filter(F.col("event_id") % parts == i).orderBy("event_id").write.format(name).option("path", path).mode("append").save()
    return path, rows


def test_logged_source_leaves_out_files_and_filters_the_rest(spark, small):
    name, path, rows = logged.registered(spark), files.shared_folder(spark), table(spark, small, "events")
    rows.repartitionByRange(5, "event_id").write.format(name).option("path", path).mode("append").save()
    store = logged.Store(path.removeprefix("file:"))
    entries = store.entries()
    assert sum(e["rows"] for e in entries) == rows.count() and len(entries) == 5
    reader = logged.LoggedReader(path, rows.schema)
    left = list(reader.pushFilters([logged.LessThan(("event_id",), 100), logged.IsNotNull(("event_id",)), logged.EqualTo(("event_type",), "click"), logged.EqualTo(("a", "b"), 1)]))
    assert len(left) == 1 and len(reader.partitions()) == 1
    df = spark.read.format(name).schema(rows.schema).option("path", path).load().filter("event_id < 100 and event_type in ('click', 'view')")
    assert "Filter" not in inspect.operators(df)
    assert sorted(df.collect()) == sorted(rows.filter("event_id < 100 and event_type in ('click', 'view')").collect())


def test_a_failed_write_leaves_nothing(spark, small):
    path, rows = logged_table(spark, small, 1)
    store = logged.Store(path.removeprefix("file:"))
    before = [f.path for f in store.files.get_file_info(logged.fs.FileSelector(store.root, recursive=True))]
    broken = rows.repartition(4).withColumn("event_id", F.when(F.col("event_id") == 500, F.raise_error(F.lit("torn"))).otherwise(F.col("event_id")))
    with pytest.raises(Exception, match="torn"):
        broken.write.format(logged.Logged.name()).option("path", path).mode("append").save()
    assert [f.path for f in store.files.get_file_info(logged.fs.FileSelector(store.root, recursive=True))] == before
    with pytest.raises(Exception, match="immutable"):
        rows.write.format(logged.Logged.name()).option("path", path).mode("overwrite").save()


def test_a_stream_of_commits_goes_on_where_it_was(spark, small):
    path, rows = logged_table(spark, small, 2)
    stream = spark.readStream.format(logged.Logged.name()).schema(rows.schema).option("path", path).load()
    more = lambda: rows.limit(7).write.format(logged.Logged.name()).option("path", path).mode("append").save()
    found = events.finished(stream.select("event_id"), "append", [lambda: None, more])
    assert found.count() == rows.count() + 7 and found.distinct().count() == rows.count()


def test_a_file_sink_that_was_stopped_has_each_row_once(spark, small):
    path, out = files.shared_folder(spark), files.shared_folder(spark)
    rows = table(spark, small, "events").select("event_id")
    rows.repartition(6).write.parquet(path)
    assert events.interrupted(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), out) == 6
    found = spark.read.parquet(out)
    assert found.count() == rows.count() == found.distinct().count()


def test_state_is_forgotten_after_its_time(spark):
    """The second batch comes when what the first left is over a millisecond old."""
    batch = lambda first: spark.range(first, first + 6).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("event_id"), F.lit("a").alias("event_type"))
    assert sorted(map(tuple, events.kinds([batch(0), batch(6)], 86_400_000).collect())) == [(0, 1, 6, 2, 10), (1, 1, 6, 2, 11)]
    assert sorted(map(tuple, events.kinds([batch(0), batch(6)], 1).collect())) == [(0, 1, 3, 1, 10), (1, 1, 3, 1, 11)]


def test_estimates_keep_their_errors(spark):
    """50,000 items, a third of the rows one of them, in 8 parts that are merged."""
    df = spark.range(75_000).select(F.lit("k").alias("k"), (F.col("id") % 8).alias("day"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("item"), F.col("id").cast("double").alias("v"))
    found = sketches.merged(sketches.sketches(df, ["k", "day"], "item", "v"), ["k"]).select(
        F.hll_sketch_estimate("hll").alias("hll"), F.theta_sketch_estimate("theta").alias("theta"), F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("m"),
        sketches.cms_count("cms", F.lit(0).cast("long")).alias("hot"), sketches.cms_count("cms", F.lit(1).cast("long")).alias("cold"),
    ).first()
    assert abs(found.hll / 50_001 - 1) < sketches.HLL_ERROR and abs(found.theta / 50_001 - 1) < sketches.THETA_ERROR
    assert abs(found.m / 75_000 - 0.5) < sketches.KLL_ERROR
    assert 25_000 <= found.hot <= 25_000 + 75_000 * sketches.EPS and 1 <= found.cold <= 1 + 75_000 * sketches.EPS


def test_states_merge_over_parts_with_null_keys_and_values(spark):
    rows = [("a", 1.0), ("a", None), ("a", 4.0), (None, 2.0), ("b", None)]
    df = spark.createDataFrame(rows * 50, "event_type string, value double").repartition(7)
    done = lambda s: (s[0], s[1], s[2] / (s[0] - 1) if s[0] > 1 else None)
    found = udfs.aggregated(df, ["event_type"], "n long, mean double, m2 double", udfs.moments, udfs.both_moments, done, "n long, mean double, variance double")
    parts = inspect.operators(found)
    assert parts["FlatMapGroupsInPandas"] == 2 and parts["MapInArrow"] == 1
    got = {r.event_type: (r.n, r["mean"], r.variance) for r in found.collect()}
    assert got["a"] == (100, 2.5, pytest.approx(2.25 * 100 / 99)) and got[None][:2] == (50, 2.0) and got["b"][0] == 0


def test_a_table_function_says_what_it_needs(spark, small):
    spark.udtf.register("loomwright_gaps", F.udtf(udfs.Gaps))
    with pytest.raises(Exception, match="first argument is a table"):
        spark.sql("SELECT * FROM loomwright_gaps(TABLE(SELECT 1 AS user_id), 5)").collect()


class Handle:
    """A list state and timers of one user, and how often they are asked for."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, *_):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_user_has_one_timer_for_all_sessions():
    """500 sessions, an hour apart, that a watermark passes in three steps; each step is one call."""
    handle, hour, gap = Handle(), 3_600_000, events.Sessions.GAP
    sessions, seen = events.Sessions(), []
    sessions.init(handle)
    put = lambda *at: list(sessions.handleInputRows((1,), iter([pd.DataFrame({"at": at})]), None))
    put(*[i * hour * 1000 for i in range(10, 510)])
    put(9 * hour * 1000, 10 * hour * 1000 - gap // 2)  # an earlier one, and one that makes the first begin earlier
    for mark in (99 * hour + hour // 2, 300 * hour, 600 * hour):
        assert len(handle.timers) == 1
        (at,) = [t for t in handle.timers if t <= mark]
        frames = list(sessions.handleExpiredTimer((1,), TimerValues(0, mark), ExpiredTimerInfo(at)))
        handle.timers.discard(at)
        seen += [(r.first, r.n) for f in frames for r in f.itertuples()]
    assert not handle.timers and not handle.rows and handle.calls <= 5
    assert seen == [(9 * hour * 1000, 1), (10 * hour * 1000 - gap // 2, 2), *[(i * hour * 1000, 1) for i in range(11, 510)]]


def test_a_write_holds_few_rows(tmp_path):
    """3,000,000 rows of 16 bytes in three files; ranges are those of all rows of a file."""
    base, most = pa.total_allocated_bytes(), 0

    def batches():
        nonlocal most
        for i in range(300):
            most = max(most, pa.total_allocated_bytes() - base)
            at = np.arange(i * 10_000, (i + 1) * 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(at % 7 - i)], names=["id", "v"])

    writer = logged.LoggedWriter(str(tmp_path), False)
    writer.commit([writer.write(batches())])
    entries = logged.Store(str(tmp_path)).entries()
    assert most < 8_000_000 and len(entries) == 3 and sum(e["rows"] for e in entries) == 3_000_000
    ends = [(e["ranges"]["id"], e["ranges"]["v"]) for e in entries]
    assert [a for (a, _), _ in ends] == [0, *[b + 1 for (_, b), _ in ends[:-1]]] and ends[-1][0][1] == 2_999_999 and ends[-1][1][0] == -299
    reader = logged.LoggedReader(str(tmp_path), StructType.fromDDL("id long"))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3_000_000
    assert json.dumps(writer.write(iter([])).entries) == "[]"


def test_xml_files_have_few_rows_each(spark, small, monkeypatch):
    """A task reads a file of XML whole, so a file doesn't grow with the table."""
    monkeypatch.setattr(files, "XML_ROWS", 40)
    found = files.s3_xml_round_trip(spark, small)
    rows = table(spark, small, "customer")
    assert len(found.inputFiles()) >= rows.count() // 40 > 1 and sorted(found.collect()) == sorted(rows.collect())


def test_a_block_of_items_meets_its_sketch_once(spark):
    """Counts asked in blocks are those asked one by one; sketches added in blocks are those added at once."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), (F.col("id") % 50).alias("day"), (F.col("id") * F.col("id") % 701 - 300).alias("item"), F.lit(1.0).alias("v"))
    daily = files.settled(sketches.sketches(df, ["k", "day"], "item", "v"))
    found = files.settled(sketches.merged(daily, ["k"]).select("k", "cms"))
    at_once = daily.groupBy("k").agg(sketches.cms_union("cms").alias("cms"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, at_once.collect()))
    rows = df.groupBy("k", "item").agg(F.count(F.lit(1)).alias("n"))
    got = sketches.cms_counts(rows, found, ["k"], "item", 64)
    want = rows.join(found, "k").select("k", "item", "n", sketches.cms_count("cms", "item").alias("about"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("about < n").count() == 0
    sizes = rows.withColumn("b", F.pmod(F.xxhash64("item"), -(-rows.count() // 64))).groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert sizes <= 128 and inspect.operators(got)["FlatMapCoGroupsInArrow"]
