"""Sketches that are stored by day and merged later, and what they answer."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from loomwright.registry import query
from loomwright.session import table
from loomwright.sources.files import settled

#: Sizes of the sketches (powers of two for HLL and theta, items for KLL), and the errors that follow: three standard ones.
HLL, THETA, KLL = 12, 12, 200
HLL_ERROR, THETA_ERROR, KLL_ERROR = 3 * 1.04 / 2**6, 3 / 2**6, 3 * 0.0133
#: The count-min sketch: error as a part of all counts, confidence, seed.
EPS, CONFIDENCE, SEED = 0.005, 0.999, 7
#: Items that meet a count-min sketch at once, and sketches that are added up at once, about.
ITEMS, ADDED = 1 << 16, 256


def sketches(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """For each of keys the sketches of an item (whole number) and a value: hll, theta, cms and kll."""
    return df.groupBy(*keys).agg(
        F.hll_sketch_agg(item, HLL).alias("hll"), F.theta_sketch_agg(item, THETA).alias("theta"),
        F.count_min_sketch(item, F.lit(EPS), F.lit(CONFIDENCE), F.lit(SEED)).alias("cms"), F.kll_sketch_agg_double(value, KLL).alias("kll"),
    )


@F.pandas_udf(BinaryType())
def cms_union(sketch: pd.Series) -> bytes:
    """Count-min sketches of one shape and seed added up: a header (version, total, depth, width), hash factors, counts."""
    first = sketch.iloc[0]
    _, _, depth, width = struct.unpack(">iqii", first[:20])
    counts, total = np.zeros(depth * width, np.int64), 0
    for s in sketch:
        if s[12 : 20 + 8 * depth] != first[12 : 20 + 8 * depth]:
            raise ValueError("count-min sketches of other shapes or seeds don't add up")
        total += struct.unpack(">q", s[4:12])[0]
        counts += np.frombuffer(s, ">i8", depth * width, 20 + 8 * depth)
    return first[:4] + struct.pack(">q", total) + first[12 : 20 + 8 * depth] + counts.astype(">i8").tobytes()


def cms_ask(sketch: bytes, items: np.ndarray) -> np.ndarray:
    """How often a count-min sketch has seen whole numbers, about, and never less."""
    _, _, depth, width = struct.unpack(">iqii", sketch[:20])
    factors = np.frombuffer(sketch, ">i8", depth, 20).astype(np.int64)
    counts = np.frombuffer(sketch, ">i8", depth * width, 20 + 8 * depth).reshape(depth, width)
    with np.errstate(over="ignore"):
        h = factors[:, None] * items.astype(np.int64)[None, :]
        h = h + (h >> 32) & np.int64((1 << 31) - 1)
    return counts[np.arange(depth)[:, None], h % width].min(axis=0).astype(np.int64)


@F.pandas_udf(LongType())
def cms_count(sketch: pd.Series, item: pd.Series) -> pd.Series:
    """How often a count-min sketch has seen a whole number, about; for few rows, as each brings its sketch."""
    return pd.Series([int(cms_ask(s, np.array([x]))[0]) for s, x in zip(sketch, item, strict=True)])


def cms_counts(rows: DataFrame, sketch: DataFrame, keys: list[str], item: str, block: int = ITEMS) -> DataFrame:
    """rows whose keys have a sketch (keys, cms), with about: how often that has seen the row's item.

    Rows are dealt over blocks by their item, and each block meets its sketch once. Items aren't null.
    """
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(item), blocks))
    each = sketch.select(*keys, "cms").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and left.num_rows:
            about = cms_ask(right["cms"][0].as_py(), left[item].to_numpy())
        else:
            left, about = left.slice(0, 0), np.zeros(0, np.int64)
        return left.drop_columns(["_block"]).append_column("about", pa.array(about))

    schema = rows.select("*", F.lit(0).cast("long").alias("about")).schema
    return dealt.groupBy(*keys, "_block").cogroup(each.groupBy(*keys, "_block")).applyInArrow(tell, schema)


def merged(daily: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of several days as those of all of them. Count-min sketches are added in blocks, then the blocks."""
    some = daily.groupBy(*keys, F.pmod(F.xxhash64("cms"), max(1, -(-daily.count() // ADDED))).alias("_block")).agg(cms_union("cms").alias("cms"))
    return daily.groupBy(*keys).agg(
        F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"), F.kll_merge_agg_double("kll").alias("kll")
    ).join(some.groupBy(*keys).agg(cms_union("cms").alias("cms")), keys)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return settled(sketches(events, ["event_type", "day"], "user_id", "value"))


def off(about: Column, exact: Column) -> Column:
    """The relative error of an estimate."""
    return F.abs(about.cast("double") / exact - 1)


@query()
def g15_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merged sketches say, as they say it: distinct users (HLL, theta), median value, events of user 1."""
    found = merged(_daily(spark, sf_dir), ["event_type"])
    return found.select(
        "event_type", F.hll_sketch_estimate("hll").alias("hll"), F.theta_sketch_estimate("theta").alias("theta"),
        F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("middle"), cms_count("cms", F.lit(1).cast("long")).alias("user_1"),
    )


@query("""
WITH b AS (SELECT count(*) AS both_ FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'))
SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS users, (SELECT both_ FROM b) AS both_, true AS theta_same, true AS theta_ok, true AS hll_ok, true AS kll_ok, true AS cms_ok, true AS both_ok
FROM events GROUP BY event_type
""")
def g15_sketches_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact numbers, and whether the sketches, stored by day and merged, keep the errors that they promise.

    theta_same: the union of the days has the very estimate of one sketch of all. kll_ok: the median
    that is told has a rank near the middle. cms_ok: no user is counted too low, nor too high by more
    than the promise. both_ok: users who clicked and purchased, by the intersection of two unions.
    """
    events = table(spark, sf_dir, "events")
    daily = _daily(spark, sf_dir)
    found = merged(daily, ["event_type"]).join(daily.groupBy("event_type").agg(F.count(F.lit(1)).alias("days")), "event_type")
    once = events.groupBy("event_type").agg(F.theta_sketch_agg("user_id", THETA).alias("once"), F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))
    counts = events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("k"))
    totals = found.select("event_type", F.conv(F.hex(F.substring("cms", 5, 8)), 16, 10).cast("long").alias("total"))
    counts, asked = cms_counts(counts, found, ["event_type"], "user_id").join(totals, "event_type"), F.col("about")
    cms = counts.select("event_type", ((asked >= F.col("k")) & (asked - F.col("k") <= EPS * F.col("total"))).alias("ok")).groupBy("event_type").agg(F.bool_and("ok").alias("cms_ok"))
    middle = found.select("event_type", F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("m"))
    ranks = events.join(middle, "event_type").groupBy("event_type").agg(
        F.avg((F.col("value") < F.col("m")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("m")).cast("double")).alias("upto")
    )
    theta = lambda kind: found.filter(F.col("event_type") == kind).select(F.col("theta").alias(kind))
    common = theta("click").join(theta("purchase"), F.lit(True)).select(F.theta_sketch_estimate(F.theta_intersection("click", "purchase")).alias("common"))
    users = lambda kind: events.filter(F.col("event_type") == kind).select("user_id")
    exact = users("click").intersect(users("purchase")).agg(F.count(F.lit(1)).alias("both_")).join(common, F.lit(True))  # one row each
    out = found.join(once, "event_type").join(cms, "event_type").join(ranks, "event_type").join(F.broadcast(exact), F.lit(True))
    about = F.theta_sketch_estimate("theta")
    return out.select(
        "event_type", "days", "users", "both_", (about == F.theta_sketch_estimate("once")).alias("theta_same"), (off(about, F.col("users")) <= THETA_ERROR).alias("theta_ok"),
        (off(F.hll_sketch_estimate("hll"), F.col("users")) <= HLL_ERROR).alias("hll_ok"),
        ((F.col("below") <= 0.5 + KLL_ERROR) & (F.col("upto") >= 0.5 - KLL_ERROR)).alias("kll_ok"), "cms_ok", (off(F.col("common"), F.col("both_")) <= 2 * THETA_ERROR).alias("both_ok"),
    )


@query()
def g13_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts as estimated, with a standard error of 2 %, 5 % (the usual) and 1 %."""
    about = {f"parts_{int(e * 100)}": F.approx_count_distinct("l_partkey", e) for e in (0.01, 0.02, 0.05)}
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[c.alias(n) for n, c in about.items()])


@query()
def g16_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles as estimated, and the bins of a histogram (centre and height)."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.approx_percentile("value", [0.25, 0.5, 0.99], 1000).alias("about"), F.histogram_numeric("value", F.lit(8)).alias("bins")
    )
