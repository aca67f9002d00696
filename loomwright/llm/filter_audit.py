"""Audit of how filters interact: packed bitmaps of filters, labels and parts, counted for each set of filters.

Each partition packs which rows fail each filter, and which carry each mark, into NumPy bitsets, with the
rows of a part side by side. Those that pass a set of filters are an AND-NOT of bitsets, and a popcount
counts them. The counts of all partitions are added; every order of the filters is read off the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import BROADCAST_ROWS, attach, cut, read, shielded, spread, text_key

#: Filters at most: they have that many sets, as powers of two, and orders, as factorials.
FILTERS = 7
#: Parts whose counts a task holds before it hands them on.
PARTS = 2_048


def packed(fails: list[np.ndarray], marks: list[np.ndarray], codes: np.ndarray, parts: int) -> np.ndarray:
    """Counts [part, set of filters, 1 + marks] of the rows that pass all filters of the set, and with each mark.

    The rows of a part begin a byte of the bitsets, so that bytes can be added up part by part.
    """
    rows = np.bincount(codes, minlength=parts)
    n_bytes = -(-rows // 8)
    first = np.concatenate([[0], np.cumsum(n_bytes)])
    order = np.argsort(codes, kind="stable")
    ahead = np.concatenate([[0], np.cumsum(rows)])[:-1]
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes)) + (first[:-1] * 8 - ahead)[codes[order]]

    def bits(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(int(first[-1]) * 8, bool)
        out[place] = flags
        return np.packbits(out)

    failed = [bits(f) for f in fails]
    counted = [bits(np.ones(len(codes), bool)), *[bits(m) for m in marks]]
    left = [np.full(int(first[-1]), 255, np.uint8)]
    for s in range(1, 1 << len(fails)):
        least = (s & -s).bit_length() - 1
        left.append(left[s & (s - 1)] & ~failed[least])
    out = np.empty((parts, len(left), len(counted)), np.int64)
    for s, passed in enumerate(left):
        for k, those in enumerate(counted):
            out[:, s, k] = np.add.reduceat(np.bitwise_count(passed & those).astype(np.int64), first[:-1])
    return out


@shielded
def audit(rows: DataFrame, fails: list[str], marks: list[str], part: str = "source") -> DataFrame:
    """What each filter removes, in each order of the filters and each part.

    rows has a boolean column for each filter, true where the row fails it and named by one letter, and
    for each mark. Returned are part, filter_order (letters in the order of use), step, and counts of the
    step's filter: kept (rows left after it), removed (by it here), redundant (fail it, but were removed
    earlier), unique_fails (fail it and no other), {mark}_lost (removed here, with the mark), and shapley
    (removed by it at any step, summed over all orders).

    A null flag is false. A null part is the part ''. Repeated rows count as often as they come. Without
    rows there are no parts, and so no result. Nothing but counts leaves a task: for each part in it, as
    many as there are sets of filters.
    """
    k = len(fails)
    if not 1 <= k <= FILTERS or any(len(f) != 1 for f in fails):
        raise ValueError(f"filters are 1 to {FILTERS} columns, each named by one letter")
    names = ["n", *[f"m{i}" for i in range(len(marks))]]
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(f"f{i}") for i, c in enumerate([*fails, *marks])]
    narrow = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            found = np.stack(list(sums.values()))
            keys = pa.array(list(sums), pa.string()).take(pa.array(np.repeat(np.arange(len(sums)), found.shape[1])))
            sets = pa.array(np.tile(np.arange(found.shape[1], dtype=np.int32), len(sums)))
            return pa.RecordBatch.from_arrays([keys, sets, *[pa.array(found[:, :, i].ravel()) for i in range(len(names))]], names=["part", "set", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("part").dictionary_encode()
            bits = [batch.column(f"f{i}").to_numpy(zero_copy_only=False).astype(bool) for i in range(k + len(marks))]
            found = packed(bits[:k], bits[k:], column.indices.to_numpy(zero_copy_only=False), len(column.dictionary))
            for name, x in zip(column.dictionary.to_pylist(), found, strict=True):
                sums[name] = sums[name] + x if name in sums else x
            if len(sums) > PARTS:
                yield flushed()
                sums.clear()
        if sums:
            yield flushed()

    tall = narrow.mapInArrow(counted, "part string, set int, " + ", ".join(f"{n} long" for n in names))
    tall = tall.groupBy("part", "set").agg(*[F.sum(n).alias(n) for n in names])
    # one row a part: of each count an array over the sets of filters
    wide = tall.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("set", *names))).alias("s"))
    wide = wide.select("part", *[F.col(f"s.{n}").alias(n) for n in names])

    def at(name: str, s: Column | int) -> Column:
        return F.get(name, F.lit(s) if isinstance(s, int) else s)

    def all_orders(f: int) -> Column:
        """The rows that filter f removes, over all orders: sets of earlier filters, by how many orders have them."""
        sets = [s for s in range(1 << k) if not s >> f & 1]
        return sum((at("n", s) - at("n", s | 1 << f)) * (factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in sets)

    orders = F.array(*[F.lit("".join(p)) for p in permutations(sorted(fails))])
    place = F.create_map(*[F.lit(x) for i, f in enumerate(fails) for x in (f, i)])
    steps = (
        wide.withColumn("shapleys", F.array(*[all_orders(f) for f in range(k)]))
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn("f", place[F.substring("filter_order", F.col("step"), F.lit(1))])
        .withColumn("own", F.call_function("shiftleft", F.lit(1), F.col("f")))
        .withColumn(
            "before",
            F.aggregate(
                F.sequence(F.lit(1), F.lit(k)),
                F.lit(0),
                lambda s, i: F.when(i < F.col("step"), s + F.call_function("shiftleft", F.lit(1), place[F.substring("filter_order", i, F.lit(1))])).otherwise(s),
            ),
        )
    )
    every = (1 << k) - 1
    after = F.col("before") + F.col("own")
    removed = at("n", F.col("before")) - at("n", after)
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        at("n", after).alias("kept"),
        removed.alias("removed"),
        (at("n", 0) - at("n", F.col("own")) - removed).alias("redundant"),
        (at("n", F.lit(every) - F.col("own")) - at("n", every)).alias("unique_fails"),
        *[(at(f"m{i}", F.col("before")) - at(f"m{i}", after)).alias(f"{m}_lost") for i, m in enumerate(marks)],
        F.get("shapleys", F.col("f")).alias("shapley"),
    )


def text_filters(text: Column) -> dict[str, Column]:
    """The filters of the audit that look at one text: true where it fails. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n_words, n_chars = F.size(words), F.length(text)
    return {
        "A": n_words < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n_words * 50,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > n_chars * 2,
        "D": text.rlike("[#$%&*|]"),
    }


@shielded
def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, part, the filters A to E as flags, and the marks good and toxic of every row of docs.

    E is true where the text of the row is that of a row with a smaller id; a null id is neither
    smaller than another nor has a smaller one. Of several labels of an id the greatest count; a row
    without labels has no marks. Texts are read once and compared by 128 bits of a hash.
    """
    found = docs.select(F.col(id).alias("_id"), F.col(part).alias("_part"), text_key(F.col(text)).alias("_text"), *[f.alias(f"_{k}") for k, f in text_filters(F.col(text)).items()])
    found = cut(found)
    n_rows = found.count()
    groups = found.groupBy("_text").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).filter("n > 1")
    groups = cut(groups)
    salt = spread(found)
    found = attach(found, groups, ["_text"], "n", n_rows, groups.count(), salt, "_group", broadcast_rows, complete=True)
    marks = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    marks = cut(marks)
    found = attach(found, marks, ["_id"], "n", n_rows, marks.count(), F.xxhash64("_text", "_part"), "_mark", broadcast_rows)
    return found.select(
        F.col("_id").alias(id),
        F.col("_part").alias(part),
        *[F.col(f"_{f}").alias(f) for f in "ABCD"],
        F.coalesce(F.col("_id") > F.col("_group.first"), F.lit(False)).alias("E"),
        F.coalesce(F.col("_mark.quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("_mark.toxic") == 1, F.lit(False)).alias("toxic"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(flagged(docs, read(spark, sf_dir, "labels")), list("ABCDE"), ["good", "toxic"])


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS f,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY part, f),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (SELECT filter_order, step, max(k.bit) FILTER (WHERE instr(filter_order, c) = step) AS own,
             coalesce(sum(k.bit) FILTER (WHERE instr(filter_order, c) < step), 0)::BIGINT AS before FROM s, k GROUP BY filter_order, step),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE f & (before + own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE f & before = 0 AND f & own > 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE f & before > 0 AND f & own > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE f = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE f & before = 0 AND f & own > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE f & before = 0 AND f & own > 0), 0) AS toxic_lost
  FROM g, m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
