"""Joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.registry import query
from loomwright.session import table, views


@query("""
SELECT n_name, count(*) AS suppliers, CAST(sum(CAST(s_acctbal AS DECIMAL(14, 2))) AS DOUBLE) AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def j1_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    found = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    return found.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.sum(F.col("s_acctbal").cast("decimal(14,2)")).cast("double").alias("balance"))


@query("SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def j1_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"))


@query("""
SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20
""")
def j1_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables, on keys that leave rows of both sides without a match."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return c.join(s, c.c_custkey == s.s_suppkey * 20, "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j2_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(rich, "c_custkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j2_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("""
SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey
""")
def j3_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation").alias("a"), table(spark, sf_dir, "nation").alias("b")
    on = (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


@query("SELECT r_name, n_name FROM region JOIN nation ON n_nationkey < r_regionkey * 5")
def j3_less_than_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No equal key: a nested loop, over two tables of a fixed size."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return n.join(F.broadcast(r), n.n_nationkey < r.r_regionkey * 5).select("r_name", "n_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j4_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed pair of tiny dimension tables."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


J5 = """
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
"""


@query(J5)
def j5_correlated_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer", "orders")
    return spark.sql(J5)


J6 = """
SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
"""


@query(J6)
def j6_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer", "orders")
    return spark.sql(J6)


J6_NULL = """
SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 1) FROM customer WHERE c_acctbal > 0 OR c_custkey = 1)
"""


@query(J6_NULL)
def j6_not_in_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a null in the list no row passes."""
    views(spark, sf_dir, "customer", "orders")
    return spark.sql(J6_NULL)


J7 = """
SELECT p_partkey FROM part WHERE p_size > (SELECT avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)
"""


@query(J7)
def j7_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part", "lineitem")
    return spark.sql(J7)


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer,
LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
""")
def j8_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer", "orders")
    return spark.sql("""
        SELECT c_custkey, o_orderkey, o_totalprice FROM customer,
        LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)""")


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
""")
def j8_lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two dearest orders of each customer; outer() is a column of the side before."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    own = o.filter(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    return c.lateralJoin(own.select("o_orderkey", "o_totalprice")).select("c_custkey", "o_orderkey", "o_totalprice")


def free(prefix: str, *frames: DataFrame) -> str:
    """A column name that no frame has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while prefix in taken:
        prefix += "_"
    return prefix


def bucket_of(frame: DataFrame, time: str, seconds: int) -> Column:
    """The number of the bucket of so many seconds that a time is in; never less for a later time.

    A time without a zone is read off its fields, as in the session's zone its order may differ.
    """
    t = F.col(time)
    if frame.schema[time].dataType.typeName() == "timestamp_ntz":
        since = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60 + F.second(t)
    else:
        since = F.unix_seconds(t.cast("timestamp"))
    return F.floor(since / seconds)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], seconds: int = 86_400) -> DataFrame:
    """left with, of each of `values`, what right last had for the key at or before the row's time.

    Both sides go through one window for each key and bucket of so many seconds, and what a bucket
    begins with comes from a second window over one row a bucket. So the work grows with the rows and
    not with the earlier rows of each, and the history of one key is dealt over tasks. Of equal times in
    right the greatest values count; rows of left without an earlier one get nulls, as do those with
    a null key or time. Rows of right with a null key or time are nothing's earlier row.
    """
    side, at, bucket, last, first = (free(f"_{n}", left, right) for n in ("side", "at", "bucket", "last", "first"))
    right = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = left.select("*", F.lit(1).alias(side), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias(at))
    found = right.select(
        *[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns],
        F.lit(0).alias(side), F.struct(*values).alias(at),
    )
    every = rows.unionByName(found).withColumn(bucket, bucket_of(left, time, seconds))
    ends = every.groupBy(key, bucket).agg(F.max(F.when(F.col(side) == 0, F.struct(time, at))).alias(last))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(key, bucket, F.last(last, ignorenulls=True).over(earlier)[at].alias(first))
    inside = Window.partitionBy(key, bucket).orderBy(F.col(time), F.col(side), F.col(at)).rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumn(last, F.last(at, ignorenulls=True).over(inside)).filter(F.col(side) == 1).join(begins, [key, bucket], "left")
    best = F.coalesce(last, first)
    return out.select(*left.columns, *[best[v].alias(v) for v in values])


@query("""
WITH p AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL),
c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT c.event_id, p.purchase_id FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def j9_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return as_of(clicks, purchases, "user_id", "ts", ["purchase_id"]).select("event_id", "purchase_id")


def within(left: DataFrame, right: DataFrame, key: str, time: str, other: str, seconds: int) -> DataFrame:
    """Pairs of the same key with left[time] <= right[other] <= left[time] + seconds.

    Both times are of one type.

    Times are cut into buckets as long as the interval, and a row of left meets two of them, so the
    join is by equal keys and buckets, not a nested loop.
    """
    bucket = free("_bucket", left, right)
    a = left.withColumn(bucket, bucket_of(left, time, seconds)).withColumn(bucket, F.explode(F.array(bucket, F.col(bucket) + 1)))
    b = right.withColumn(bucket, bucket_of(right, other, seconds))
    span = F.expr(f"interval {seconds} seconds")
    return a.join(b, [key, bucket]).filter((F.col(other) >= F.col(time)) & (F.col(other) <= F.col(time) + span)).drop(bucket)


@query("""
SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'
""")
def j10_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought"))
    return within(clicks, purchases, "user_id", "ts", "bought", 3600).select("click_id", "purchase_id")


J11 = "SELECT o_orderpriority, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"


def _hinted(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey").join(orders.hint(hint), "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("lines"))


@query(J11)
def j11_sort_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hinted(spark, sf_dir, "merge")


@query(J11)
def j11_shuffled_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hinted(spark, sf_dir, "shuffle_hash")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j11_broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broadcast side is the nation table, which has a fixed size."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT s_name, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def j12_right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("s_name", "n_name")


@query("""
SELECT r_name, n_name, year(o_orderdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(14, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
GROUP BY ALL
""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name", F.year("o_orderdate").cast("long").alias("year"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"))
    )
