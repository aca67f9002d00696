"""Mixing sources to target weights by Pfair scheduling: earliest deadline first over blocks."""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import BROADCAST_ROWS, cut, read, shielded

#: Rows in a block at least; blocks of a source in one row of the schedule; rows ordered by one task.
BLOCK, PERIOD, BUCKET_ROWS = 64, 1_000, 65_536
#: Blocks that are scheduled, about, and sources, at most: the driver keeps the schedule.
BLOCKS, SOURCES = 1 << 20, 10_000
#: The weight of a source without a target is its number of rows to this power.
POWER = 0.5


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period, by largest remainders, one at least; weights must be positive.

    For a look at a mix in whole slots; `mix` itself schedules by the exact weights.
    """
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s)):
        if sum(out.values()) >= period:
            break
        out[s] += 1
    while (over := sum(out.values()) - period) > 0:  # the ones given to tiny sources come from the largest
        top = max(out, key=lambda s: (out[s], s))
        out[top] -= min(over, out[top] - 1)
    return out


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very ratio of the weights, each taken as the decimal that it is written as."""
    ratios = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    common = math.lcm(*[r.denominator for r in ratios.values()])
    return {s: int(r * common) for s, r in ratios.items()}


def pattern(share: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, array]:
    """The slots of each source, until one has no blocks left, or without blocks for sum(share) slots.

    Block i of a source with share a of n is released at floor(i n / a) and due by
    ceil((i + 1) n / a). In each slot the released block with the earliest deadline goes (of equals,
    the first source by name). As the shares add up to n, no deadline is missed, so after any number
    of slots a source is less than one block from its target.
    """
    n = sum(share.values())
    waiting = [(0, s, 0) for s in share]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = {s: array("q") for s in share}
    slot = 0
    while blocks is not None or slot < n:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * n // share[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        if blocks is not None and i + 1 == blocks[s]:
            break
        heapq.heappush(waiting, ((i + 1) * n // share[s], s, i + 1))
        slot += 1
    return out


def phases(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, np.ndarray]:
    """The slot of every block of each source.

    A phase lasts until a source has no blocks left; then the others go on, by their weights among
    themselves. So no block is dropped or repeated. Depends on counts and weights alone.
    """
    left, start = {s: n for s, n in blocks.items() if n > 0}, 0
    share, parts = exact({s: weights[s] for s in left}), {s: [] for s in left}
    while left:
        slots = pattern({s: share[s] for s in left}, left)
        for s, x in slots.items():
            parts[s].append(np.frombuffer(x, np.int64) + start if len(x) else np.zeros(0, np.int64))
        start += sum(map(len, slots.values()))
        left = {s: n - len(slots[s]) for s, n in left.items() if n > len(slots[s])}
    return {s: np.concatenate(x) for s, x in parts.items()}


@shielded
def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source: str = "source",
    id: str = "doc_id",
    block: int | None = None,
    period: int = PERIOD,
) -> DataFrame:
    """All rows of docs with mix_block (in its source), mix_slot and mix_position in the interleaved order.

    A source's rows are ordered by a hash of the id and cut into blocks; the last may be short.
    mix_position is mix_slot * block + place in the block. Without `block` one has BLOCK rows, doubled
    until there are at most BLOCKS blocks and one for each source, so the driver keeps 8 MB of schedule
    at any size, and hands it on in rows of `period` blocks of a source. A null source is the source ''.
    Weights must be positive and are met exactly; sources that `weights` doesn't name get their row
    count to the power POWER, scaled like a whole. More than SOURCES sources are an error: they are to
    be mapped to groups first. Rows that repeat an id stay; those without an id are ordered by a
    hash of their other columns. A bucket of rows that one task orders is cut further by that hash where
    it is much too large, as with an id that many rows repeat. No rows are collected.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    key = F.coalesce(F.col(source).cast("string"), F.lit(""))
    plain = [c for c, kind in docs.dtypes if c != id and "<" not in kind and kind != "variant"]

    def hash_of(seed: int) -> Column:
        return F.when(F.col(id).isNull(), F.xxhash64(F.lit(seed), *plain)).otherwise(F.xxhash64(F.lit(seed), F.col(id)))

    n_rows = docs.count()
    bits = min(30, max(8, math.ceil(math.log2(max(n_rows, 1) / BUCKET_ROWS)) if n_rows else 8))
    bucket = F.shiftrightunsigned(hash_of(0), 64 - bits)
    order = hash_of(1)
    rows = docs.select("*", key.alias("_source"), bucket.alias("_bucket"), order.alias("_order"))
    counts = cut(rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    large = cut(counts.filter(F.col("_n") > 4 * BUCKET_ROWS).select("_source", "_bucket", F.ceil(F.col("_n") / BUCKET_ROWS).alias("_subs")))
    if large.count():  # one for each 4 * BUCKET_ROWS rows at most, so a small table
        rows = rows.join(F.broadcast(large), ["_source", "_bucket"], "left")
        rows = rows.withColumn("_sub", F.coalesce(F.pmod(F.xxhash64(F.lit(2), *plain), F.col("_subs")), F.lit(0))).drop("_subs")
        counts = cut(rows.groupBy("_source", "_bucket", "_sub").agg(F.count(F.lit(1)).alias("_n")))
    else:
        rows, counts = rows.withColumn("_sub", F.lit(0).cast("long")), counts.withColumn("_sub", F.lit(0).cast("long"))
    sources = counts.groupBy("_source").agg(F.sum("_n").alias("n")).limit(SOURCES + 1).collect()
    if len(sources) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: map them to groups and mix those")
    per_source = {r["_source"]: r["n"] for r in sources}
    if block is None:
        block = BLOCK
        while n_rows > block * BLOCKS:
            block *= 2
    total = sum(n**POWER for n in per_source.values()) or 1.0
    target = {s: n**POWER / total for s, n in per_source.items()} | {s: w for s, w in (weights or {}).items() if s in per_source}
    plan = phases({s: -(-n // block) for s, n in per_source.items()}, target)
    parts = [(s, i // period, x[i : i + period].tolist()) for s, x in sorted(plan.items()) for i in range(0, len(x), period)]
    schedule = docs.sparkSession.createDataFrame(parts, "_source string, _part long, _slots array<long>")
    n_slots = sum(len(x) for x in plan.values())
    # a row of the schedule meets period * block rows at most, so there is no hot key
    schedule = F.broadcast(schedule) if n_slots <= BROADCAST_ROWS * 10 else schedule.hint("shuffle_merge")
    ahead = Window.partitionBy("_source").orderBy("_bucket", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_source", "_bucket", "_sub", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket", "_sub").orderBy("_order", id)
    ranked = (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(before, ["_source", "_bucket", "_sub"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .withColumn("mix_block", F.floor(F.col("_rank") / block).cast("long"))
        .withColumn("_part", F.floor(F.col("mix_block") / period).cast("long"))
        .join(schedule, ["_source", "_part"])
    )
    slot = F.get("_slots", (F.col("mix_block") % period).cast("int"))
    return ranked.select(
        *[F.col(c) for c in docs.columns],
        "mix_block",
        slot.cast("long").alias("mix_slot"),
        (slot * block + F.col("_rank") % block).cast("long").alias("mix_position"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_block, mix_slot, mix_position of every document.

    The rows are numbered as they are written, so that rows without an id, or with one id, differ.
    """
    docs = cut(read(spark, sf_dir, "documents").select("doc_id", "source", F.monotonically_increasing_id().alias("row")))
    return mix(docs).drop("row")
