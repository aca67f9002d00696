"""Structured Streaming over the events table, run to the end of what is there."""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwright.registry import query
from loomwright.session import table
from loomwright.sources.files import shared_folder


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream; times are cast, as watermarks take no timestamp without a zone."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a plain path must be a folder
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(
    df: DataFrame, mode: str, steps: list[Callable[[], None]] | None = None, told: Callable[[StreamingQuery], None] | None = None, one_batch: bool = False
) -> DataFrame:
    """What the stream has written when all input has been read. The sink is a table in the shared folder.

    With steps the stream runs once after each, from its checkpoint, so what a step adds to the input
    is one batch. `told` sees the query after each run. With one_batch a run is one batch: state that is
    kept for some time asks for another batch again and again, so such a stream has no end by itself.
    """
    spark, path, checkpoint = df.sparkSession, shared_folder(df.sparkSession), shared_folder(df.sparkSession)
    none = spark.createDataFrame([], df.schema)

    def replace(batch: DataFrame, _: int) -> None:  # each batch is the whole result
        batch.write.mode("overwrite").parquet(path)

    def append(batch: DataFrame, number: int) -> None:  # by number, so that a repeated batch replaces itself
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    if mode == "complete":
        replace(none, 0)
    else:
        append(none, -1)
    for step in steps or [lambda: None]:
        step()
        writer = df.writeStream.outputMode(mode).foreachBatch(replace if mode == "complete" else append)
        running = writer.option("checkpointLocation", checkpoint).trigger(**({"once": True} if one_batch else {"availableNow": True})).start()
        running.awaitTermination()
        if told is not None:
            told(running)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def staged(parts: list[DataFrame]) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A file stream and the steps that add each part to its folder, written by as many tasks as the part has."""
    spark, path = parts[0].sparkSession, shared_folder(parts[0].sparkSession)
    spark.createDataFrame([], parts[0].schema).write.parquet(path)
    steps = [lambda part=part: part.write.mode("append").parquet(path) for part in parts]
    return spark.readStream.schema(parts[0].schema).parquet(path), steps


def ntz(*names: str):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_ FROM events GROUP BY event_type")
def s6_file_stream_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory sink is the driver's memory, so it gets a row for each type of event."""
    name = f"loomwright_{uuid.uuid4().hex}"
    found = stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_"))
    found.writeStream.format("memory").outputMode("complete").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def interrupted(rows: DataFrame, path: str, seconds: float = 120.0) -> int:
    """Write a stream to files, stop it after its first batch, and go on from the checkpoint; the batches of both runs."""
    checkpoint = shared_folder(rows.sparkSession)
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    first, until = writer.trigger(processingTime="0 seconds").start(), time.monotonic() + seconds
    while first.isActive and not any(p.numInputRows for p in first.recentProgress) and time.monotonic() < until:
        time.sleep(0.05)
    first.stop()
    second = writer.trigger(availableNow=True).start()
    second.awaitTermination()
    return sum(p.numInputRows > 0 for q in (first, second) for p in q.recentProgress)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def s6_file_sink_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file sink that was stopped after a batch and went on: its log of batches says which files count."""
    path, out = shared_folder(spark), shared_folder(spark)
    events = table(spark, sf_dir, "events")
    events.repartition(12, "user_id").write.parquet(path)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(path)
    interrupted(rows.filter("event_type = 'click'").select("event_id", "user_id", "value"), out)
    return spark.read.parquet(out)


@query("""
SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1
HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def t1_tumbling_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has passed; the last one isn't emitted."""
    found = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return finished(found.select(F.col("window.start").alias("start"), "n"), "append").select(*ntz("start"), "n")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t2_tumbling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return finished(found.select(F.col("window.start").alias("start"), "event_type", "n"), "complete").select(*ntz("start"), "event_type", "n")


@query("""
SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY start
""")
def t3_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream(spark, sf_dir).groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return finished(found.select(F.col("window.start").alias("start"), "n"), "complete").select(*ntz("start"), "n")


SESSIONS = """
WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
"""


@query(SESSIONS + " HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def t4_session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "30 minutes"), "user_id")
    found = sessions.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
    return finished(found, "append").select("user_id", *ntz("start"), "n")


@query(SESSIONS)
def t5_session_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT event_id FROM events")
def t6_dedup_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(twice.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


@query("""
SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'
""")
def t7_stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = stream(spark, sf_dir).filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("a"), F.col("ts").alias("clicked"))
    bought = stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("b"), F.col("ts").alias("bought"))
    on = F.expr("a = b and bought >= clicked and bought <= clicked + interval 1 hour")
    joined = clicks.withWatermark("clicked", "10 minutes").join(bought.withWatermark("bought", "10 minutes"), on)
    return finished(joined.select("click_id", "purchase_id"), "append")


@query("""
SELECT event_id AS click_id FROM events a WHERE event_type = 'click' AND EXISTS (
  SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR)
""")
def t7_stream_stream_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = stream(spark, sf_dir).filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("a"), F.col("ts").alias("clicked"))
    bought = stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("user_id").alias("b"), F.col("ts").alias("bought"))
    on = F.expr("a = b and bought >= clicked and bought <= clicked + interval 1 hour")
    joined = clicks.withWatermark("clicked", "10 minutes").join(bought.withWatermark("bought", "10 minutes"), on, "left_semi")
    return finished(joined.select("click_id"), "append")


@query("""
SELECT a.event_id AS click_id, b.event_id AS purchase_id
FROM (SELECT * FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
""")
def t7_stream_stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: the table, then a click and a purchase twenty days on by users that don't exist.

    A click without a purchase comes out when the watermark has passed its hour, so the second batch lets
    out all clicks of the table; its own stays in the state.
    """
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    later = rows.agg((F.max("ts") + F.expr("interval 20 days")).alias("ts"))
    ends = later.select(F.explode(F.expr("array(struct(-1L AS user_id, 'click' AS event_type), struct(-2L AS user_id, 'purchase' AS event_type))")).alias("e"), "ts")
    events, steps = staged([rows, ends.select(F.lit(None).cast("long").alias("event_id"), "e.*", "ts")])
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("a"), F.col("ts").alias("clicked"))
    bought = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("b"), F.col("ts").alias("bought"))
    on = F.expr("a = b and bought >= clicked and bought <= clicked + interval 1 hour")
    joined = clicks.withWatermark("clicked", "10 minutes").join(bought.withWatermark("bought", "10 minutes"), on, "left_outer")
    return finished(joined.select("click_id", "purchase_id"), "append", steps)


@query("""
SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT date_trunc('day', max(ts) + INTERVAL 10 DAY), 1 FROM events
""")
def t8_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: the table, a row ten days on, one from the first day, and one twenty days on.

    The third comes behind the watermark and is dropped; the last only moves the watermark on.
    """
    times = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    ends = times.agg(F.min("ts").alias("first_"), F.max("ts").alias("last_"))
    on = lambda days: ends.select((F.col("last_") + F.expr(f"interval {days} days")).alias("ts"))
    rows, steps = staged([times, on(10), ends.select(F.col("first_").alias("ts")), on(20)])
    found = rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return finished(found.select(F.col("window.start").alias("start"), "n"), "append", steps).select(*ntz("start"), "n")


def dropped_by(told: list[StreamingQuery]) -> int:
    """The rows that came behind the watermark, as the progress of the queries tells."""
    return sum(op.numRowsDroppedByWatermark for q in told for p in q.recentProgress for op in p.stateOperators)


@query("""
WITH late AS (SELECT count(*) AS n FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 2 DAY)
SELECT event_type, count(*) AS kept, (SELECT n FROM late) AS dropped FROM events GROUP BY event_type
""")
def t8_late_rows_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the first two days come again, under new numbers, when the watermark is far past them.

    Rows behind the watermark are told apart before the step that looks for repeats, so each is counted.
    An aggregate would count groups, as it adds up before its state.
    """
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    start = F.broadcast(rows.agg(F.min("ts").alias("start")))  # one row
    late = rows.join(start, F.col("ts") < F.col("start") + F.expr("interval 2 days")).select((-1 - F.col("event_id")).alias("event_id"), "event_type", "ts")
    events, steps = staged([rows, late])
    told: list[StreamingQuery] = []
    kept = finished(events.withWatermark("ts", "10 minutes").dropDuplicates(["event_id", "ts"]).select("event_type"), "append", steps, told.append)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept")).withColumn("dropped", F.lit(dropped_by(told)).cast("long"))


def running_total(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events and value of a user so far."""
    n, total = state.get if state.exists else (0, 0.0)
    for frame in frames:
        n, total = n + len(frame), total + float(frame["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def t9_arbitrary_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user."""
    rows = stream(spark, sf_dir).select("user_id", "value")
    found = rows.groupBy("user_id").applyInPandasWithState(
        running_total, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout
    )
    seen = finished(found, "update")
    return seen.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("s")).select("user_id", "s.n", "s.total")


class Totals(StatefulProcessor):
    """Events of a user so far, and how many batches they came in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, total double, batches long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, total, batches = self.seen.get() if self.seen.exists() else (0, 0.0, 0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
        self.seen.update((n, total, batches + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)], "batches": [batches + 1]})

    def close(self) -> None:
        pass


@query("""
WITH e AS (SELECT user_id, value, event_id < (SELECT quantile_disc(event_id, 0.5) FROM events) AS early FROM events)
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT early) AS batches FROM e GROUP BY user_id
""")
def t9_transform_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user, after two batches: the events before the median one, and the rest."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    middle = F.broadcast(rows.agg(F.expr("percentile_disc(0.5) within group (order by event_id)").cast("long").alias("middle")))
    marked = rows.crossJoin(middle).withColumn("early", F.col("event_id") < F.col("middle"))  # one row
    events, steps = staged([marked.filter("early").select("user_id", "value"), marked.filter("not early").select("user_id", "value")])
    found = events.groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, n long, total double, batches long", "update", "none")
    with rocks(spark):
        seen = finished(found, "update", steps)
    return seen.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "batches"), "n").alias("s")).select("user_id", "s.*")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store, the only one that transformWithState takes; then the one before again."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Sessions(StatefulProcessor):
    """Sessions of a user: events less than GAP microseconds apart. A timer at the end of the first open one gives out all that are over.

    The list state holds the sessions that are open, so events may come in any order within the
    watermark, and an event may join two sessions into one. A user has one timer at most: it goes off
    once for all sessions that the watermark has passed, and is set again to the end of the next.
    """

    GAP = 30 * 60 * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def due(self, last: int) -> int:
        """When a session is over, in milliseconds."""
        return -(-(last + self.GAP) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        before = min((last for _, last, _ in spans), default=None)
        for frame in rows:
            spans += [(int(t), int(t), 1) for t in frame["at"]]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(spans):
            if merged and first - merged[-1][1] < self.GAP:
                a, b, k = merged[-1]
                merged[-1] = (a, max(b, last), k + n)
            else:
                merged.append((first, last, n))
        self.open.put(merged)
        first_end = min(last for _, last, _ in merged)
        if first_end != before:
            if before is not None:
                self.handle.deleteTimer(self.due(before))
            self.handle.registerTimer(self.due(first_end))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        over = [s for s in spans if self.due(s[1]) <= now]
        left = [s for s in spans if self.due(s[1]) > now]
        if left:
            self.open.put(left)
            self.handle.registerTimer(self.due(min(s[1] for s in left)))
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame({"user_id": [key[0]] * len(over), "first": [s[0] for s in over], "n": [s[2] for s in over]})

    def close(self) -> None:
        pass


@query(SESSIONS)
def t9_session_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: the table, and an event far ahead by a user that doesn't exist, which lets all sessions end."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts"))
    end = rows.agg((F.max("ts") + F.expr("interval 20 days")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("at"))
    events, steps = staged([rows, end])
    sessions = events.withWatermark("ts", "10 minutes").groupBy("user_id")
    found = sessions.transformWithStateInPandas(Sessions(), "user_id long, first long, n long", "append", "eventTime")
    with rocks(spark):
        seen = finished(found, "append", steps)
    return seen.select("user_id", F.timestamp_micros("first").cast("timestamp_ntz").alias("start"), "n")


class Kinds(StatefulProcessor):
    """How often a user did each thing (map state), and the last event of each batch (list state); both are forgotten after `ttl` ms."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getMapState("times", "kind string", "n long", self.ttl)
        self.lasts = handle.getListState("lasts", "event_id long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, new = -1, Counter()
        for frame in rows:
            last = max(last, int(frame["event_id"].max()))
            new.update(frame["event_type"])
        for kind, n in new.items():
            seen = self.times.getValue((kind,))[0] if self.times.containsKey((kind,)) else 0
            self.times.updateValue((kind,), (seen + n,))
        self.lasts.appendValue((last,))
        counts = {k[0]: v[0] for k, v in self.times.iterator()}
        lasts = [x[0] for x in self.lasts.get()]
        yield pd.DataFrame({"user_id": [key[0]], "kinds": [len(counts)], "n": [sum(counts.values())], "batches": [len(lasts)], "last_": [max(lasts)]})

    def close(self) -> None:
        pass


def kinds(parts: list[DataFrame], ttl: int) -> DataFrame:
    """The last state of each user after a batch for each part."""
    events, steps = staged(parts)
    schema = "user_id long, kinds long, n long, batches long, last_ long"
    found = events.groupBy("user_id").transformWithStateInPandas(Kinds(ttl), schema, "update", "processingTime")
    with rocks(parts[0].sparkSession):
        seen = finished(found, "update", steps, one_batch=True)
    return seen.groupBy("user_id").agg(F.max_by(F.struct("kinds", "n", "batches", "last_"), "last_").alias("s")).select("user_id", "s.*")


@query("""
SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n, count(DISTINCT ts < TIMESTAMP '2024-01-15') AS batches, max(event_id) AS last_ FROM events GROUP BY user_id
""")
def t9_map_and_list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches by date; the states live for a day."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return kinds([rows.filter(early).drop("ts"), rows.filter(~early).drop("ts")], 86_400_000)
