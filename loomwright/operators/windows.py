"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from loomwright.registry import query
from loomwright.session import table, views

def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""
SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, ntile(4) OVER u AS q
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type), u AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def w1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"),
        F.round(F.percent_rank().over(w), 9).alias("p"), F.round(F.cume_dist().over(w), 9).alias("c"), F.ntile(4).over(by_user()).cast("long").alias("q"),
    )


@query("""
SELECT event_id, lag(value, 2, -1.0) OVER w AS before, lead(event_type) OVER w AS after
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def w2_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("value", 2, -1.0).over(by_user()).alias("before"), F.lead("event_type").over(by_user()).alias("after")
    )


@query("""
SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 3) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def w3_first_last_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.first("value").over(w).alias("f"), F.last("value").over(w).alias("l"), F.nth_value("value", 3).over(w).alias("n")
    )


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events
""")
def w4_rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(by_user().rowsBetween(-2, 0)), 6).alias("s"))


W5 = """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events
"""


@query(W5)
def w5_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql(W5)


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events
""")
def w6_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame over peer groups is a range over their dense rank."""
    day = F.to_date("ts")
    ranked = table(spark, sf_dir, "events").select("event_id", "user_id", F.dense_rank().over(Window.partitionBy("user_id").orderBy(day)).alias("g"))
    return ranked.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("g").rangeBetween(-1, 0)).alias("n"))


@query("""
SELECT event_id, coalesce(round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW), 6), 0) AS s
FROM events
""")
def w7_exclude_current_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames, one on either side of the row."""
    side = lambda a, b: F.coalesce(F.sum("value").over(by_user().rowsBetween(a, b)), F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(side(-1, -1) + side(1, 1), 6).alias("s"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def w8_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_id")


W9 = """
SELECT event_id, row_number() OVER w AS n, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)
"""


@query(W9)
def w9_named_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql(W9).withColumn("n", F.col("n").cast("long"))
