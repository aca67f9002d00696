"""Joins, scans and selections by ranges: work on few keys, or on none, that no single task has to hold.

Rows are cut into parts by bounds among their values. The bounds are written once, so a row is in the same
part wherever it is asked for, also after an executor was lost. What parts need to know of each other
are totals, of which there is one a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.operators.joins import free
from loomwright.registry import query
from loomwright.session import table
from loomwright.sources.files import settled

#: Rows of a part, about, and parts at most: their bounds are an array that each task gets.
PART_ROWS, PARTS = 1 << 16, 4_096
#: Rows of a bin of a join, about, and bins at most; pairs that one task compares, about.
BIN_ROWS, BINS, PAIRS = 1_024, 1 << 16, 1 << 22


def bounds_of(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """One row with `bounds`, the least keys of about as many parts of equal size, sorted; empty without keys.

    Null keys are left out. Only the key is shuffled. Equal keys are in one part.
    """
    keys = df.select(key.alias("key")).filter("key is not null")
    firsts = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return settled(firsts.agg(F.sort_array(F.collect_list("key")).alias("bounds")))


def part_of(key: Column, bounds: str, parts: int) -> Column:
    """The last place in the array column `bounds` whose key isn't greater, by halving; 0 if all are greater."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        up = F.get(bounds, middle) <= key
        return F.struct(F.when(up, middle).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(F.greatest(middle - 1, s["low"])).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(parts.bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.greatest(F.size(bounds) - 1, F.lit(0)).alias("high")), halved, lambda s: s["low"])


def n_parts(n: int) -> int:
    return max(1, min(PARTS, -(-n // PART_ROWS)))


# ---- joins without an equal key


def _counted(left: DataFrame, right: DataFrame, bins: int) -> DataFrame:
    """One row with arrays `l` and `r`: the rows of each side in each bin (column _bin)."""
    of = lambda df, name: df.groupBy("_bin").agg(F.count(F.lit(1)).alias(name))
    every = left.sparkSession.range(bins).select(F.col("id").cast("int").alias("_bin"))
    both = every.join(of(left, "l"), "_bin", "left").join(of(right, "r"), "_bin", "left").na.fill(0)
    rows = F.sort_array(F.collect_list(F.struct("_bin", "l", "r")))
    return settled(both.agg(F.transform(rows, lambda x: x["l"]).alias("l"), F.transform(rows, lambda x: x["r"]).alias("r")))


def _blocks(n: Column, side: int) -> Column:
    """Blocks of `side` rows that n rows are dealt over."""
    return F.greatest(F.ceil(n / side), F.lit(1)).cast("int")


def overlap_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], bin_rows: int = BIN_ROWS, pairs: int = PAIRS
) -> DataFrame:
    """Pairs of rows whose spans (first, last; both ends included) have a value in common.

    A span of one value is a row's value: ("v", "v"). Values of both sides are cut into bins by the
    firsts of both, and a span is in every bin that it reaches into, so spans should be short beside
    the whole. A pair meets in the bin of the later of its firsts, and is compared there alone. In a bin
    of n and m rows with more than `pairs` pairs both sides are dealt over blocks, and a block meets
    every block of the other side; so no bin, whatever its values, is one task's work. A span with a
    null end, or that ends before it starts, has no value, so no pair.
    """
    (a, b), (c, d) = left_span, right_span
    n = left.count() + right.count()
    bins = max(1, min(BINS, -(-n // bin_rows)))
    firsts = left.select(F.col(a).alias("v")).unionByName(right.select(F.col(c).alias("v")))
    bounds = bounds_of(firsts, F.col("v"), bins)
    edges, low, high, bin_, blocks, mine, other, salt = (
        free(x, left, right) for x in ("_edges", "_low", "_high", "_bin", "_blocks", "_mine", "_other", "_salt")
    )

    def placed(df: DataFrame, first: str, last: str) -> DataFrame:
        rows = df.filter(F.col(first) <= F.col(last)).withColumn(edges, bounds.select("bounds").scalar())
        rows = rows.withColumn(low, part_of(F.col(first), edges, bins)).withColumn(high, part_of(F.col(last), edges, bins)).drop(edges)
        return rows.withColumn(bin_, F.explode(F.sequence(low, high)))

    l_rows, r_rows = placed(left, a, b), placed(right, c, d)
    named = lambda df: df.select(F.col(bin_).alias("_bin"))
    counts = _counted(named(l_rows), named(r_rows), bins)
    side = max(1, int(pairs**0.5))

    def dealt(df: DataFrame, own: str, its: str, where: str, at: str) -> DataFrame:
        """Each row with its block, once for each block of the other side in its bin."""
        plain = [x for x, kind in df.dtypes if "<" not in kind and kind != "variant"]
        rows = df.withColumn(blocks, counts.select(F.struct("l", "r")).scalar())
        rows = rows.withColumn(mine, F.pmod(F.xxhash64(*plain), _blocks(F.get(F.col(blocks)[own], F.col(bin_)), side)).cast("int"))
        rows = rows.withColumn(other, _blocks(F.get(F.col(blocks)[its], F.col(bin_)), side)).drop(blocks)
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumnsRenamed({mine: where, other: at})

    l_key, r_key = free("_l_block", left, right), free("_r_block", left, right)
    l_rows = dealt(l_rows, "l", "r", l_key, r_key)
    r_rows = dealt(r_rows, "r", "l", r_key, l_key)
    l_low = free("_l_low", left, right)
    joined = l_rows.withColumnRenamed(low, l_low).drop(high).join(r_rows.drop(high).hint("merge"), [bin_, l_key, r_key])  # the plan doesn't know how many rows the bins make
    met = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.greatest(F.col(l_low), F.col(low)) == F.col(bin_))
    return joined.filter(met).drop(bin_, l_key, r_key, l_low, low)


def less_join(left: DataFrame, right: DataFrame, smaller: str, larger: str, or_equal: bool = False, pairs: int = PAIRS) -> DataFrame:
    """Pairs with left[smaller] < right[larger] (<= with or_equal), and no nested loop over a whole side.

    There are as many pairs as there are, so the work is quadratic; it is cut into blocks of about
    `pairs` comparisons. Both sides are cut into bins by value; bins with many rows of one value are
    dealt over more blocks. A block of left meets the blocks of right in its bin and above, the others
    hold no pair and are never made. Nulls are in no pair.
    """
    n, m = max(left.count(), 1), max(right.count(), 1)
    skew = min(max((n / m) ** 0.5, 1 / 16), 16.0)  # a longer side has larger blocks, so that the shorter one is repeated less
    l_side, r_side = max(1, int(pairs**0.5 * skew)), max(1, int(pairs**0.5 / skew))
    bins = max(1, min(BINS, max(-(-n // l_side), -(-m // r_side))))
    values = left.select(F.col(smaller).alias("v")).unionByName(right.select(F.col(larger).alias("v")))
    bounds = bounds_of(values, F.col("v"), bins)
    edges, bin_, blocks, mine, at = (free(x, left, right) for x in ("_edges", "_bin", "_blocks", "_mine", "_at"))

    def placed(df: DataFrame, value: str) -> DataFrame:
        rows = df.filter(F.col(value).isNotNull()).withColumn(edges, bounds.select("bounds").scalar())
        return rows.withColumn(bin_, part_of(F.col(value), edges, bins)).drop(edges)

    l_rows, r_rows = placed(left, smaller), placed(right, larger)
    named = lambda df: df.select(F.col(bin_).alias("_bin"))
    counts = _counted(named(l_rows), named(r_rows), bins)
    l_key, r_key = (free(x, left, right) for x in ("_l_block", "_r_block"))
    sides = {"l": l_side, "r": r_side}

    def dealt(df: DataFrame, own: str, its: str, where: str, to: str, up: bool) -> DataFrame:
        """Each row with its block (bin and number in it), once for each block of the other side that it can meet."""
        plain = [x for x, kind in df.dtypes if "<" not in kind and kind != "variant"]
        rows = df.withColumn(blocks, counts.select(F.struct("l", "r")).scalar())
        number = F.pmod(F.xxhash64(*plain), _blocks(F.get(F.col(blocks)[own], F.col(bin_)), sides[own])).cast("int")
        reach = F.sequence(F.col(bin_), F.lit(bins - 1)) if up else F.sequence(F.lit(0), F.col(bin_))

        def blocks_of(b: Column) -> Column:
            rows_in = F.get(F.col(blocks)[its], b)
            some = F.transform(F.sequence(F.lit(0), _blocks(rows_in, sides[its]) - 1), lambda k: F.struct(b.alias("bin"), k.alias("k")))
            return F.when(rows_in > 0, some).otherwise(F.slice(some, 1, 0))

        rows = rows.withColumn(where, F.struct(F.col(bin_).alias("bin"), number.alias("k")))
        return rows.withColumn(to, F.explode(F.flatten(F.transform(reach, blocks_of)))).drop(blocks, bin_)

    l_rows = dealt(l_rows, "l", "r", l_key, r_key, True)
    r_rows = dealt(r_rows, "r", "l", r_key, l_key, False)
    joined = l_rows.join(r_rows.hint("merge"), [l_key, r_key])  # the plan doesn't know how many rows the blocks make
    met = F.col(smaller) <= F.col(larger) if or_equal else F.col(smaller) < F.col(larger)
    return joined.filter(met).drop(l_key, r_key)


# ---- totals over the pairs of such joins, without the pairs

TOTALS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def _upto(df: DataFrame, value: str, asked: DataFrame, at: str, or_equal: bool, totals: dict[str, tuple[str, Column]], part_rows: int) -> DataFrame:
    """asked with totals over all rows of df with value < at (<= with or_equal); null where there are none.

    Rows of one value are added up first, and each value is asked for once. Those rows are cut into parts by
    value: what comes before a part is one row of totals, the rest is a window in the part.
    """
    key, kind, part, edges = (free(x, df, asked) for x in ("_key", "_kind", "_part", "_edges"))
    own = {name: free(f"_own_{name}", df, asked) for name in totals}
    ahead = {name: free(f"_ahead_{name}", df, asked) for name in totals}
    fold = {name: TOTALS[how] for name, (how, _) in totals.items()}
    rows = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias(key)).agg(*[fold[n][0](c).alias(own[n]) for n, (_, c) in totals.items()])
    questions = asked.select(F.col(at).alias(key)).filter(F.col(key).isNotNull()).distinct()
    rows = rows.withColumn(kind, F.lit(0 if or_equal else 2)).unionByName(questions.withColumn(kind, F.lit(1)), allowMissingColumns=True)
    rows = settled(rows)
    parts = max(1, min(PARTS, -(-rows.count() // part_rows)))
    bounds = bounds_of(rows, F.col(key), parts)
    rows = rows.withColumn(edges, bounds.select("bounds").scalar()).withColumn(part, part_of(F.col(key), edges, parts)).drop(edges)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sums = rows.groupBy(part).agg(*[fold[n][0](own[n]).alias(ahead[n]) for n in totals]).select(part, *[fold[n][0](ahead[n]).over(before).alias(ahead[n]) for n in totals])
    inside = Window.partitionBy(part).orderBy(key, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({own[n]: fold[n][0](own[n]).over(inside) for n in totals}).filter(F.col(kind) == 1)
    told = local.join(sums, part).select(key, *[fold[n][1](F.col(own[n]), F.col(ahead[n])).alias(n) for n in totals])
    return asked.join(told, F.col(at) == F.col(key), "left").drop(key)


def less_totals(left: DataFrame, right: DataFrame, smaller: str, larger: str, or_equal: bool = False, part_rows: int = PART_ROWS, **totals: tuple[str, Column]) -> DataFrame:
    """Rows of right that have a pair in less_join, with totals over their rows of left.

    totals are ("sum", "min" or "max", a column of left) by name; ("sum", F.lit(1)) counts the pairs. No pair is
    made, so the work grows as the rows do. Sums of decimals and whole numbers are exact.
    """
    n = free("_n", left, right)
    found = _upto(left, smaller, right, larger, or_equal, {**totals, n: ("sum", F.lit(1).cast("long"))}, part_rows)
    return found.filter(F.col(n) > 0).drop(n)


def overlap_totals(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], part_rows: int = PART_ROWS, **sums: Column) -> DataFrame:
    """Rows of left that have a pair in overlap_join, with sums over their rows of right; F.lit(1) counts the pairs.

    Of the spans that start no later than a row ends, those that end before it starts have no value in common
    with it, and all others have. So a sum is the difference of two running ones, and no pair is made: the
    work grows as the rows do, whatever the lengths of the spans. Columns are whole numbers or decimals.
    """
    (a, b), (c, d) = left_span, right_span
    n = free("_n", left, right)
    some = {name: free(f"_some_{name}", left, right) for name in sums}  # how many of the values aren't null
    wanted = {n: F.lit(1).cast("long"), **sums, **{some[name]: F.when(x.isNotNull(), 1).otherwise(0).cast("long") for name, x in sums.items()}}
    kinds = dict(right.select(*[x.alias(name) for name, x in wanted.items()]).dtypes)
    if any(kinds[name] in ("float", "double") for name in sums):
        raise ValueError("differences of sums of floating-point numbers aren't exact; cast to a decimal")
    spans, rows = right.filter(F.col(c) <= F.col(d)), left.filter(F.col(a) <= F.col(b))
    begun, over = ({name: free(f"_{x}_{name}", left, right) for name in wanted} for x in ("begun", "over"))
    rows = _upto(spans, c, rows, b, True, {begun[name]: ("sum", x) for name, x in wanted.items()}, part_rows)
    rows = _upto(spans, d, rows, a, False, {over[name]: ("sum", x) for name, x in wanted.items()}, part_rows)
    left_of = lambda name: F.coalesce(F.col(begun[name]), F.lit(0)) - F.coalesce(F.col(over[name]), F.lit(0))
    return rows.filter(left_of(n) > 0).select(*left.columns, *[F.when(left_of(some[name]) > 0, left_of(name)).alias(name) for name in sums])


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 2 HOUR AS b FROM orders),
l AS (SELECT l_shipdate AS c, l_shipdate + to_seconds(CAST(l_quantity AS BIGINT) * 600) AS d, l_quantity FROM lineitem)
SELECT o_orderkey, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM o JOIN l ON a <= d AND c <= b GROUP BY o_orderkey
""")
def j3_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in shipment, for ten minutes a piece, while an order was open for two hours."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 2 hours")).alias("b"))
    took = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("l_quantity").cast("int") * 10), F.lit(0))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("c"), (F.col("l_shipdate") + took).alias("d"), F.col("l_quantity").cast("long").alias("q"))
    found = overlap_totals(orders, lines, ("a", "b"), ("c", "d"), lines=F.lit(1).cast("long"), quantity=F.col("q"))
    return found.groupBy("o_orderkey").agg(F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"))


@query("""
SELECT s_suppkey, count(*) AS poorer, max(c_acctbal) AS next_below, min(c_custkey) AS first_ FROM customer JOIN supplier ON c_acctbal < s_acctbal GROUP BY s_suppkey
""")
def j3_inequality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with less than a supplier, by totals over ranges of balances."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    one = F.lit(1).cast("long")
    found = less_totals(c, s, "c_acctbal", "s_acctbal", poorer=("sum", one), next_below=("max", F.col("c_acctbal")), first_=("min", F.col("c_custkey")))
    return found.groupBy("s_suppkey").agg(F.sum("poorer").alias("poorer"), F.max("next_below").alias("next_below"), F.min("first_").alias("first_"))


# ---- running windows over few keys


def running(df: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS, **totals: Column) -> DataFrame:
    """df with running totals over all rows of its keys up to a row and its peers, without a task for each key.

    totals are columns by name: each is added up; F.lit(1) counts, and with a unique order gives the row
    number. Rows of keys and order are cut into parts; each part is totalled (before any shuffle), the
    totals of the parts before it are added up by one row a part, and a window of each key and part adds
    what is inside. As in SQL, nulls come first, a null doesn't add, and rows with an equal order have
    equal totals; they are in one part. Sums of decimals and whole numbers are exact.
    """
    edges, part, of_key = (free(x, df) for x in ("_edges", "_part", "_key"))
    own = {name: free(f"_own_{name}", df) for name in totals}
    ahead = {name: free(f"_ahead_{name}", df) for name in totals}
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*keys, *order])])
    parts = max(1, min(PARTS, -(-df.count() // part_rows)))
    bounds = bounds_of(df, key, parts)
    rows = df.withColumns({own[n]: c for n, c in totals.items()}).withColumn(edges, bounds.select("bounds").scalar()).withColumn(of_key, key)
    rows = rows.withColumn(part, part_of(F.col(of_key), edges, parts)).drop(edges, of_key)
    sums = rows.groupBy(*keys, part).agg(*[F.sum(own[n]).alias(ahead[n]) for n in totals])
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(free(f"_{k}", df)) for k in keys], F.col(part).alias(free("_of", df)), *[F.sum(ahead[n]).over(before).alias(ahead[n]) for n in totals])
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    local = rows.withColumns({own[n]: F.sum(own[n]).over(inside) for n in totals})
    on = F.col(part) == F.col(free("_of", df))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(free(f"_{k}", df)))
    joined = local.join(sums, on, "left")
    added = [F.when(F.col(own[n]).isNull(), F.col(ahead[n])).otherwise(F.col(own[n]) + F.coalesce(F.col(ahead[n]), F.lit(0))).alias(n) for n in totals]
    return joined.select(*[F.col(c) for c in df.columns if c not in totals], *added)


@query("""
SELECT event_id, row_number() OVER w AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER w AS DOUBLE) AS total, count(*) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)) AS days
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)
""")
def w9_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys: the history of each is dealt over parts. The second order has peers."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("value").cast("decimal(18,4)").alias("v"))
    found = running(events, ["event_type"], ["event_id"], n=F.lit(1).cast("long"), total=F.col("v"))
    found = running(found.withColumn("day", F.to_date("ts")), ["event_type"], ["day"], days=F.lit(1).cast("long"))
    return found.select("event_id", "n", F.col("total").cast("double").alias("total"), "days")


# ---- exact percentiles of large groups


def percentiles(df: DataFrame, keys: list[str], value: str, part_rows: int = PART_ROWS, **fractions: float) -> DataFrame:
    """Exact percentiles (interpolated, as `percentile` gives them) of a value for each key, by counting ranges.

    Equal values are counted before any shuffle. The different values are cut into parts; the counts
    of the parts say which hold the places that are asked for, and only those are put in order, each
    part by itself. So no task holds a group. Nulls don't count; a key without values gets nulls.
    """
    if not fractions or any(not 0 <= f <= 1 for f in fractions.values()):
        raise ValueError("fractions are between 0 and 1")
    value_, count, part, edges, first, size = (free(x, df) for x in ("_value", "_count", "_part", "_edges", "_first", "_size"))
    seen = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias(value_)).agg(F.count(F.lit(1)).alias(count))
    seen = settled(seen)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*keys, value_])])
    parts = max(1, min(PARTS, -(-seen.count() // part_rows)))
    bounds = bounds_of(seen, key, parts)
    of_key = free("_key", df)
    rows = seen.withColumn(edges, bounds.select("bounds").scalar()).withColumn(of_key, key)
    rows = rows.withColumn(part, part_of(F.col(of_key), edges, parts)).drop(edges, of_key)
    per_part = rows.groupBy(*keys, part).agg(F.sum(count).alias(size))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = free("_whole", df)
    per_part = per_part.select("*", F.coalesce(F.sum(size).over(before), F.lit(0)).alias(first), F.sum(size).over(Window.partitionBy(*keys)).alias(whole))
    names = list(fractions)
    place = {n: F.lit(f) * (F.col(whole) - 1) for n, f in fractions.items()}
    ends = {n: (F.floor(place[n]), F.ceil(place[n])) for n in names}
    inside = lambda at: (at >= F.col(first)) & (at < F.col(first) + F.col(size))
    wanted = F.lit(False)
    for low, high in ends.values():
        wanted = wanted | inside(low) | inside(high)
    per_part = per_part.filter(wanted)
    on = F.col(part) == F.col(free("_of", df))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(free(f"_{k}", df)))
    here = per_part.select(*[F.col(k).alias(free(f"_{k}", df)) for k in keys], F.col(part).alias(free("_of", df)), first, whole)
    left = rows.join(here, on)
    upto = free("_upto", df)
    left = left.withColumn(upto, F.col(first) + F.sum(count).over(Window.partitionBy(*keys, part).orderBy(value_)))
    holds = lambda at: (at >= F.col(upto) - F.col(count)) & (at < F.col(upto))
    found = left.groupBy(*keys).agg(
        *[F.max(F.when(holds(low), F.col(value_))).alias(f"{n}_low") for n, (low, _) in ends.items()],
        *[F.max(F.when(holds(high), F.col(value_))).alias(f"{n}_high") for n, (_, high) in ends.items()],
        F.max(whole).alias(whole),
    )
    between = {n: place[n] - F.floor(place[n]) for n in names}
    found = found.select(*keys, *[(F.col(f"{n}_low") * (1 - between[n]) + F.col(f"{n}_high") * between[n]).alias(n) for n in names])
    every = df.select(*keys).distinct().select(*[F.col(k).alias(free(f"_{k}", df)) for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(free(f"_{k}", df)))
    return every.join(found, same, "left").select(*[F.col(free(f"_{k}", df)).alias(k) for k in keys], *names)


@query("""
SELECT event_type, round(median(value), 6) AS middle, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.999), 6) AS p999, min(value) AS least FROM events GROUP BY event_type
""")
def g6_exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", middle=0.5, p90=0.9, p999=0.999, least=0.0)
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("middle", "p90", "p999")], "least")
