"""Helpers shared by the corpus operators: reading, checkpoints and joins that survive hot keys."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast whole only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: A key is hot if it has more than this part of all rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 2_000
#: Rows of a hot key are dealt over so many salts.
SALTS = 1_021
#: A map of bits that is broadcast has at most 2 to this power of them, 32 MB.
MOST_BITS = 28


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return what was written; lineage ends there.

    The folder is the one that spark.checkpoint.dir names. Only a local master, whose executors are
    this process, gets a temporary folder where that is unset. Spark deletes what is no longer used
    if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    made_shared(df.sparkSession)
    return df.checkpoint()


def made_shared(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set here if it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="loomwright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class Rounds:
    """Frames that a loop cuts in each round, written as tables in the shared folder; older ones are deleted.

    A checkpoint hands on the size that Spark estimates, which multiplies in joins: after some rounds of
    joins it has so many digits that planning takes longer than the query, and longer with each round.
    A table has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{made_shared(spark)}/rounds-{uuid.uuid4().hex}", []

    def cut(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        if len(self.paths) > 2:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths[-3])
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])


def spread(df: DataFrame, *skip: str) -> Column:
    """A salt for the rows of df, from its plain columns and the partition; the same when a task runs again."""
    plain = [c for c, kind in df.dtypes if c not in skip and "<" not in kind and kind not in ("variant", "binary")]
    return F.xxhash64(F.spark_partition_id(), *plain)


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    count: str,
    n_rows: int,
    n_table: int,
    salt: Column,
    name: str,
    broadcast_rows: int = BROADCAST_ROWS,
    complete: bool = False,
) -> DataFrame:
    """Left join of rows with table, which has one row for each key, as a struct column `name`.

    n_table is the number of rows of the table, or of the numbers in it if its rows have arrays. A
    table of at most broadcast_rows is broadcast. Otherwise only hot keys are, and the rest is joined
    by a shuffle in which rows of hot keys, and those with a null key, which match nothing, are dealt
    by `salt`; so no key gathers in one task. If the table is `complete`, it has all keys that more
    than one row carries, and table[count] says how many do; else hot keys are counted among the rows.
    """
    values = F.struct(*[c for c in table.columns if c not in keys])
    if n_table <= broadcast_rows:
        return rows.join(F.broadcast(table.select(*keys, values.alias(name))), keys, "left")
    table = table.select(*keys, values.alias("_cold"))
    if complete:
        hot = table.filter(F.col("_cold")[count] * HOT_PARTS > n_rows).withColumnRenamed("_cold", "_hot")
    else:
        often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_often")).filter(F.col("_often") * HOT_PARTS > n_rows)
        often = cut(often.dropna(subset=keys).select(*keys))
        hot = cut(often.join(table.withColumnRenamed("_cold", "_hot"), keys, "left"))
    hot = hot.withColumn("_is_hot", F.lit(True))
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_is_hot") | alone, 1 + F.pmod(F.xxhash64(salt), F.lit(SALTS))).otherwise(0).cast("int")
    )
    # always 0, but no constant: Spark would take a constant out of the keys, and hash by the rest alone
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    return (
        dealt.join(table.withColumn("_salt", zero), [*keys, "_salt"], "left")
        .withColumn(name, F.coalesce("_hot", "_cold"))
        .drop("_hot", "_cold", "_salt", "_is_hot")
    )


def sieve(rows: DataFrame, hashed: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """rows with a column _maybe: true for each row whose hash is one of keys (_hash), and for few others.

    The keys are bits of a map of about eight bits a key, so one in eight of the other rows passes too.
    The map has at most 2 ** MOST_BITS bits (32 MB), and is broadcast at any size; beyond an eighth as
    many keys more of the other rows pass.
    """
    bits = 1 << min(MOST_BITS, max(15, math.ceil(math.log2(8 * max(n_keys, 1)))))

    def place(h: Column) -> Column:
        return F.pmod(h, F.lit(bits))

    maps = keys.select(place(F.col("_hash")).alias("_at")).groupBy(F.shiftright("_at", 15).alias("_part"))
    maps = maps.agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(32767)).alias("_map"))
    marked = rows.withColumn("_at", place(hashed)).withColumn("_part", F.shiftright("_at", 15))
    marked = marked.join(F.broadcast(maps), "_part", "left")
    inside = F.col("_at").bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), inside.bitwiseAND(7))).cast("int"), F.lit(2))
    return marked.withColumn("_maybe", F.coalesce(bit == 1, F.lit(False))).drop("_part", "_at", "_map")


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def only(rows: DataFrame, ids: DataFrame, key: str, n_ids: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is in ids (distinct): a broadcast if that was counted to be small, else a shuffle."""
    return rows.join(F.broadcast(ids) if n_ids <= broadcast_rows else ids.hint("shuffle_merge"), key, "left_semi")


def in_fold(id: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest` when divided by `of`; a null id counts as ''."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % of == rest


def labelled(docs: DataFrame, labels: DataFrame, bound: int, id: str = "doc_id", every_label: bool = False) -> DataFrame:
    """At most `bound` rows of docs with the label of `labels` (id, label), the first by a hash of the id.

    The ids are chosen among all labelled rows first, so only their texts are read on. An id that
    repeats in docs counts once, with the row that has the greatest hash of its plain columns; of several
    labels of an id the greatest counts. So the same rows come out of every run.
    With every_label, a label that would get less has all its rows or an equal part of half the bound,
    so the rows are at most one and a half times the bound, and no label is missed where there are many.
    """
    one = cut(labels.filter(F.col(id).isNotNull() & F.col("label").isNotNull()).groupBy(id).agg(F.max("label").alias("label")))
    order = [F.xxhash64(F.col(id)), F.col(id)]
    counts = one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(bound).collect()
    size, total = {r["label"]: r["n"] for r in counts}, sum(r["n"] for r in counts) or 1

    def below(n: int, of: int) -> float:
        """A bound on the hash that the first n of so many rows, and about as many more, are below."""
        return float(2**64 * min(1.0, (2 * n + 100) / of) - 2**63)

    # rows below such a bound only, so that what one task sorts doesn't grow with the input
    scarce, part = [], bound // (2 * max(len(counts), 1))
    if every_label:
        scarce = [k for k, n in size.items() if bound * n // total < min(n, part)]
    most = one.filter(~F.col("label").isin(scarce)) if scarce else one
    left = total - sum(size[k] for k in scarce)
    chosen = most.filter(order[0] <= below(bound, max(left, 1))).orderBy(*order).limit(bound)
    if scarce:
        limit = F.create_map(*[F.lit(x) for k in scarce for x in (k, below(part, size[k]))])
        rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
        own = one.filter(F.col("label").isin(scarce)).filter(order[0] <= limit[F.col("label")])
        chosen = cut(own.withColumn("_rank", rank).filter(F.col("_rank") <= part).drop("_rank").unionByName(chosen))
    found = docs.join(F.broadcast(chosen), id)
    plain = [c for c, kind in docs.dtypes if "<" not in kind and kind != "variant"]
    one_each = found.groupBy(id).agg(F.max_by(F.struct(*[c for c in found.columns if c != id]), F.xxhash64(*plain)).alias("_row"))
    return one_each.select(id, "_row.*").select(*found.columns)


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with those of its columns that are in names renamed, and the function that names them back."""
    taken = [c for c in df.columns if c in set(names)]
    other = {c: f"aside{len(df.columns)}_{c}" for c in taken}
    return df.withColumnsRenamed(other), lambda out: out.withColumnsRenamed({v: k for k, v in other.items()})


def shielded(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets the columns of the first argument have names that f uses inside, which start with an underscore."""

    @wraps(f)
    def g(docs: DataFrame, *args, **kwargs) -> DataFrame:
        docs, back = aside(docs, [c for c in docs.columns if c.startswith("_")])
        return back(f(docs, *args, **kwargs))

    return g
