"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import BROADCAST_ROWS, attach, cut, read, shielded, sieve, spread

PREFIX = 64
ADDED = ["keep_id", "group_size", "kept", "full_hash"]
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def measured(docs: DataFrame, text: str) -> DataFrame:
    """docs with the length of the normalised text, the hash of its first PREFIX characters, and the original's length."""
    norm = normalised(F.col(text))
    return docs.select(
        "*",
        F.length(norm).alias("_len"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("_pre"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("_n"),
    )


def refined(rows: DataFrame, id: str, full: Column, broadcast_rows: int, narrow: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows with full_hash where one was needed, the groups of equal texts, the number of rows).

    narrow has _len and _pre of all rows. Lengths that occur once are left out first, then prefix
    hashes that occur once among the lengths that are left. The full hash is taken of what remains,
    and of one in eight of the other rows (see `sieve`), which then are alone. rows has a column _tie,
    by which rows of equal length and id are told apart.
    """
    n_rows = narrow.count()
    of_length, of_prefix = F.xxhash64("_len"), F.xxhash64("_len", "_pre")

    def often(df: DataFrame, hashed: Column) -> DataFrame:
        return cut(df.groupBy(hashed.alias("_hash")).agg(F.count(F.lit(1)).alias("_count")).filter("_count > 1").select("_hash"))

    lengths = often(narrow, of_length)
    left = sieve(narrow.select("_len", "_pre"), of_length, lengths, lengths.count()).filter("_maybe")
    prefixes = often(left, of_prefix)
    rows = sieve(rows, of_prefix, prefixes, prefixes.count())
    rows = rows.withColumn("full_hash", F.when(F.col("_maybe"), full)).drop("_maybe")
    hashed = cut(rows.filter("full_hash is not null").select("full_hash", F.col(id).alias("_id"), "_n", "_tie"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_tie").alias("tie")))
    groups = hashed.groupBy("full_hash").agg(F.count(F.lit(1)).alias("_count"), best.alias("_best")).filter("_count > 1")
    groups = cut(groups.select("full_hash", "_count", F.col("_best.id").alias("_keep"), F.col("_best.tie").alias("_tie"), (-F.col("_best.n")).alias("_n")))
    return rows, groups, n_rows


def told(rows: DataFrame, groups: DataFrame, n_rows: int, id: str, columns: list[str], broadcast_rows: int) -> DataFrame:
    """columns of rows, with keep_id, group_size, kept and full_hash."""
    salt = spread(rows.select(id, "_pre"))
    found = attach(rows, groups, ["full_hash"], "_count", n_rows, groups.count(), salt, "_group", broadcast_rows, complete=True)
    keep = F.when(F.col("_group").isNull(), F.col(id)).otherwise(F.col("_group._keep"))
    return found.select(
        *columns,
        keep.alias("keep_id"),
        F.coalesce("_group._count", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_group").isNull() | (F.col(id).eqNullSafe(keep) & (F.col("_n") == F.col("_group._n")) & (F.col("_tie") == F.col("_group._tie")))).alias("kept"),
        "full_hash",
    )


@shielded
def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with keep_id, group_size and kept, and a column full_hash where one was taken.

    Rows are grouped by normalised length, then by the hash of the first PREFIX normalised characters;
    only what is left gets a full hash, and is grouped by it. Of equal texts the longest original
    stays, then the smallest id.

    Null text is empty text, and empty texts are equal to each other. A null id loses every tie. Rows of
    equal length and id are told apart by a hash of their columns (but arrays, maps and structs), so of
    different rows one is kept. Rows that are the same in all of these are one document: each is kept
    if one is, and `first_of_repeats` leaves one of them. Columns that clash with the ones added here
    are replaced.
    """
    docs = docs.drop(*ADDED)
    plain = [c for c, kind in docs.dtypes if "<" not in kind and kind != "variant"]
    rows = measured(docs, text).withColumn("_tie", F.xxhash64(*plain))
    rows, groups, n_rows = refined(rows, id, F.sha2(normalised(F.col(text)), 256), broadcast_rows, cut(rows.select("_len", "_pre")))
    return told(rows, groups, n_rows, id, docs.columns, broadcast_rows)


def first_of_repeats(kept: DataFrame, columns: list[str], id: str = "doc_id") -> DataFrame:
    """The kept rows of exact_dedup, once each even where a row was repeated whole.

    Only rows whose group has more than one member can be repeats, so only those are shuffled.
    """
    alone = kept.filter("group_size = 1").select(*columns)
    repeats = kept.filter("group_size > 1").dropDuplicates([id, "full_hash"]).select(*columns)
    return alone.unionByName(repeats)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document.

    The result has the full hash of every text, so it is taken in the one scan that there is, and only
    ids, lengths and hashes are worked on from there. Those are written with a number for each row, so
    exactly one row of a group is kept, also of rows that repeat id and length.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = measured(docs.withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256)), "text")
    narrow = cut(rows.select("doc_id", "_len", "_pre", "_n", F.unhex("text_sha256").alias("_sha"), F.monotonically_increasing_id().alias("_tie")))
    rows, groups, n_rows = refined(narrow, "doc_id", F.col("_sha"), BROADCAST_ROWS, narrow)
    found = told(rows, groups, n_rows, "doc_id", ["doc_id", "_sha"], BROADCAST_ROWS)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
