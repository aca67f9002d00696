"""User-defined functions of each kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from loomwright.registry import query
from loomwright.session import table, views


@query("SELECT c_custkey, length(c_name) * 2 AS doubled FROM customer")
def x1_python_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.udf(lambda s: len(s) * 2, "long")
    return table(spark, sf_dir, "customer").select("c_custkey", doubled("c_name").alias("doubled"))


@query("SELECT event_id, value * 2 + 1 AS scaled FROM events")
def x2_arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scale(v: pa.Array) -> pa.Array:
        return pc.add(pc.multiply(v, 2.0), 1.0)

    return table(spark, sf_dir, "events").select("event_id", F.arrow_udf(scale, "double")("value").alias("scaled"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS width FROM events GROUP BY event_type")
def x3_grouped_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest and highest of each type in each part of the input, so that no group is larger than a part; then of all."""

    @F.pandas_udf("double")
    def lowest(v: pd.Series) -> float:
        return float(v.min())

    @F.pandas_udf("double")
    def highest(v: pd.Series) -> float:
        return float(v.max())

    events = table(spark, sf_dir, "events").select("event_type", "value", F.spark_partition_id().alias("part"))
    parts = events.groupBy("event_type", "part").agg(lowest("value").alias("low"), highest("value").alias("high"))
    return parts.groupBy("event_type").agg(F.round(F.max("high") - F.min("low"), 6).alias("width"))


#: States of a key that one task merges, about; keys whose states a task holds before it hands them on.
FAN, HELD = 64, 4_096


def aggregated(
    df: DataFrame, keys: list[str], state: str, update: Callable[[pd.DataFrame], tuple], merge: Callable[[tuple, tuple], tuple], finish: Callable[[tuple], tuple], result: str
) -> DataFrame:
    """An aggregate with a state of one's own: `update` makes it of rows, `merge` of two states, `finish` the result.

    Each task makes one state a key of its rows, in Arrow batches. States are merged FAN at a time and
    then the rest, so no worker gets the rows of a group, and none all its states. Keys may be null.
    """
    names = [c.split()[0] for c in state.split(", ")]
    of_key = StructType([df.schema[k] for k in keys])
    kinds = dict(zip([c.split()[0] for c in result.split(", ")], result.split(", "), strict=True))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def out() -> pa.RecordBatch:
            t = pd.DataFrame([[*k, *s] for k, s in held.items()], columns=[*keys, *names])
            return pa.RecordBatch.from_pandas(t, schema=schema_of_parts, preserve_index=False)

        for batch in batches:
            for key, rows in batch.to_pandas().groupby(keys, dropna=False):
                key = tuple(None if pd.isna(x) else x for x in key)
                held[key] = merge(held[key], update(rows)) if key in held else update(rows)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def joined(rows: pd.DataFrame) -> tuple:
        states = rows[names].itertuples(index=False, name=None)
        total = next(states)
        for s in states:
            total = merge(total, s)
        return total

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*rows[keys].iloc[0], *joined(rows)]], columns=[*keys, *names])

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*rows[keys].iloc[0], *finish(joined(rows))]], columns=[*keys, *kinds])

    described = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in of_key.fields], state])
    empty = df.sparkSession.createDataFrame([], described)
    schema_of_parts = empty.toArrow().schema
    parts = df.mapInArrow(partial, described)
    parts = parts.withColumn("part_", F.spark_partition_id() % FAN)
    parts = parts.groupBy(*keys, "part_").applyInPandas(some, described)
    return parts.groupBy(*keys).applyInPandas(last, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in of_key.fields], result]))


def moments(rows: pd.DataFrame) -> tuple:
    """Number, mean and sum of squared deviations of the values."""
    v = rows["value"].to_numpy(float)
    v = v[~np.isnan(v)]
    return (len(v), float(v.mean()) if len(v) else 0.0, float(((v - v.mean()) ** 2).sum()) if len(v) else 0.0)


def both_moments(a: tuple, b: tuple) -> tuple:
    """The moments of two sets of values together."""
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return (n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance FROM events GROUP BY event_type")
def x3_mergeable_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance by states that are merged; a worker sees a part of the rows of a type."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    told = lambda s: (s[0], s[1], s[2] / (s[0] - 1) if s[0] > 1 else None)
    found = aggregated(events, ["event_type"], "n long, mean double, m2 double", moments, both_moments, told, "n long, mean double, variance double")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


@query("SELECT user_id, event_id, value = max(value) OVER (PARTITION BY user_id) AS highest FROM events")
def x4_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(highest=pdf["value"] == pdf["value"].max())[["user_id", "event_id", "highest"]]

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInPandas(marked, "user_id long, event_id long, highest boolean")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def x4_grouped_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(t: pa.Table) -> pa.Table:
        return pa.table({"user_id": t["user_id"][:1], "n": pa.array([t.num_rows], pa.int64())})

    return table(spark, sf_dir, "events").select("user_id").groupBy("user_id").applyInArrow(counted, "user_id long, n long")


@query("SELECT p_partkey, unnest(range(0, p_size % 4)) AS i FROM part")
def x5_python_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Counter:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    views(spark, sf_dir, "part")
    spark.udtf.register("loomwright_counter", F.udtf(Counter, returnType="i: bigint"))
    return spark.sql("SELECT p_partkey, i FROM part, LATERAL loomwright_counter(p_size % 4)")


class Gaps:
    """The time since the event before of the same user. It asks for its input itself: parts by user, in order of time."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, at_least: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"user_id", "event_id", "ts"} - {f.name for f in rows.dataType.fields}:
            raise ValueError("the first argument is a table with user_id, event_id and ts")
        schema = StructType().add("user_id", LongType()).add("event_id", LongType()).add("ts", TimestampNTZType()).add("gap", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("user_id")], orderBy=[OrderingColumn("ts"), OrderingColumn("event_id")])

    def __init__(self) -> None:
        self.last = None

    def eval(self, row, at_least: int):
        if self.last is not None:
            gap = int((row["ts"] - self.last).total_seconds())
            if gap >= at_least:
                yield row["user_id"], row["event_id"], row["ts"], gap
        self.last = row["ts"]

    def terminate(self):
        yield from ()


@query("""
SELECT user_id, event_id, ts, gap FROM (
  SELECT user_id, event_id, ts, CAST(floor(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events)
WHERE gap >= 86400
""")
def x5_table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a table; its `analyze` gives the schema and asks for the parts."""
    views(spark, sf_dir, "events")
    spark.udtf.register("loomwright_gaps", F.udtf(Gaps))
    return spark.sql("SELECT * FROM loomwright_gaps(TABLE(SELECT user_id, event_id, ts FROM events), 86400)")


class Spread:
    """Number and range of the values of each user, in Arrow batches."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        t = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else pa.table(rows)
        found = t.group_by("user_id").aggregate([("value", "count"), ("value", "min"), ("value", "max")])
        yield pa.table({"user_id": found["user_id"], "n": found["value_count"], "low": found["value_min"], "high": found["value_max"]})


@query("SELECT user_id, count(value) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY user_id")
def x5_arrow_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Arrow table function makes partial rows of each batch; Spark adds them up."""
    views(spark, sf_dir, "events")
    spark.udtf.register("loomwright_spread", F.arrow_udtf(Spread, returnType="user_id bigint, n bigint, low double, high double"))
    return spark.sql("SELECT user_id, sum(n) AS n, min(low) AS low, max(high) AS high FROM loomwright_spread(TABLE(SELECT user_id, value FROM events)) GROUP BY user_id")


@query("SELECT o_orderkey, o_totalprice * CAST(1.19 AS DOUBLE) AS gross FROM orders")
def x6_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION loomwright_gross(net DOUBLE) RETURNS DOUBLE RETURN net * 1.19D")
    return spark.sql("SELECT o_orderkey, loomwright_gross(o_totalprice) AS gross FROM orders")
