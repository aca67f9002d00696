"""Document fingerprints by I-Match: terms of a band of inverse document frequency, hashed by random subsets of the lexicon.

The lexicon has CELLS cells, and a term is a word whose hash falls in a cell; so it has one size at any
size of the corpus, and fits a map of bits. A cell's document frequency counts the documents with a word
in it. Rare words share cells, but even all together are far below the band.

A single hash of all terms would change with any term. So the lexicon is also cut at random into 2^l
subsets, and the terms in each of the first SUBSETS are hashed by themselves. l follows the number of
terms, such that a subset has about one or two of them; the next two levels have half and a quarter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import cut, read, shielded, sieve, text_key
from loomwright.llm.decontaminate import words_of

#: Cells of the lexicon, as a power of two.
CELL_BITS = 20
#: Documents per document with the term: a term is kept if this is in the band, ends included.
BAND = (10, 1_000)
#: Subsets of a level that are hashed, and levels.
SUBSETS, LEVELS = 32, 3
#: Hexadecimal digits of a subset's hash, what stands for a subset without terms, and the hash of an array of none.
DIGITS, EMPTY, NOTHING = 4, "....", 42
#: Documents in one bucket of neighbours, about, until there are so many buckets; keys that one task puts in order.
BUCKET_ROWS, BUCKETS, RANGE_ROWS = 256, 1 << 16, 1 << 14


def power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("int")


def word_hashes(text: Column) -> Column:
    """The hashes of the different words of a text."""
    return F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row with `bits`: the cells whose document frequency is in the band, as an array of 64-bit numbers.

    Frequencies are counted over all rows, each as a document. Tasks count before they shuffle, at most
    one row for each cell.
    """
    n = docs.count()
    cells = docs.select(F.explode(F.array_distinct(F.transform(word_hashes(F.col(text)), cell))).alias("_cell"))
    seen = cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("_df"))
    kept = seen.filter((F.col("_df") * band[0] <= n) & (F.col("_df") * band[1] >= n))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_cell").bitwiseAND(63))
    numbers = kept.groupBy(F.shiftright("_cell", 6).cast("long").alias("id")).agg(F.bit_or(bit).alias("_bits"))
    every = docs.sparkSession.range(1 << (CELL_BITS - 6)).join(numbers, "id", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0)).alias("_bits")))), lambda x: x["_bits"]).alias("bits"))


@shielded
def fingerprinted(docs: DataFrame, lex: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text: whole hash, level, and the subsets' hashes of LEVELS levels.

    Only words of the lexicon's band count; a text without one is known by all its words, and a text
    without words by its characters, so each text has a fingerprint, equal texts have equal ones, and
    order and number of words don't count. Null is the empty text. An own column of this name is replaced.
    """
    docs = docs.drop(name)
    text_ = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("_all", word_hashes(text_)).withColumn("_bits", lex.select("bits").scalar())
    inside = F.filter("_all", lambda h: F.getbit(F.get("_bits", F.shiftright(cell(h), 6)), cell(h).bitwiseAND(63)) == 1)
    found = found.withColumn("_band", inside).drop("_bits")
    terms = F.when(F.size("_band") > 0, F.col("_band")).when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(F.xxhash64(text_)))
    found = found.withColumn("_terms", F.sort_array(terms)).drop("_all", "_band")
    found = found.withColumn("_level", F.length(F.bin(F.size("_terms"))) - 1)

    def digits(h: Column, n: int) -> Column:
        return F.lower(F.lpad(F.hex(h), n, "0"))

    parts = [digits(F.xxhash64("_terms"), 16), F.lpad(F.col("_level").cast("string"), 2, "0")]

    def hashed(name: str, most: str) -> Column:
        """The hashes of the first subsets of a level, one after the other; `most` has the number of the last."""

        numbers = F.sequence(F.lit(0).cast("long"), F.col(most))
        hashes = F.transform(numbers, lambda j: F.xxhash64(F.filter(name, lambda g: g.bitwiseAND(F.col(most)) == j)))
        shown = F.transform(hashes, lambda h: F.when(h == NOTHING, EMPTY).otherwise(digits(h.bitwiseAND((1 << 4 * DIGITS) - 1), DIGITS)))
        return F.array_join(shown, "")

    def first(name: str, mask: Column) -> Column:
        return F.filter(name, lambda g: g.bitwiseAND(mask) < SUBSETS)

    # the bits of a hash above its cell say which subset of a level it is in; one of a level is part of one of the level before
    found = found.withColumn("_in", F.transform("_terms", lambda h: F.shiftrightunsigned(h, CELL_BITS)))
    for i in range(LEVELS):
        mask = power(F.col("_level") + i) - 1
        found = found.withColumn(f"_most{i}", F.least(mask, F.lit(SUBSETS - 1).cast("long")))
        found = found.withColumn(f"_in{i}", first(f"_in{i - 1}" if i else "_in", mask))
        parts.append(hashed(f"_in{i}", f"_most{i}"))
    return found.select(*docs.columns, F.concat_ws(":", *parts).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """The part of the subsets with terms in either text that have the same hash in both, over all common levels.

    1 for equal fingerprints, 0 where the numbers of terms are so far apart that no level is common.
    """
    x, y = F.split(a, ":"), F.split(b, ":")
    p, q = x[1].cast("int"), y[1].cast("int")
    n = LEVELS - F.abs(p - q)

    def levels(parts: Column, own: Column) -> Column:
        return F.array_join(F.slice(parts, 3 + F.greatest(p, q) - own, n), "")

    def at(s: Column, i: Column) -> Column:
        return F.substring(s, i * DIGITS + 1, F.lit(DIGITS))

    def counted(two: Column) -> Column:
        s, t = two["s"], two["t"]
        places = F.sequence(F.lit(0), F.floor(F.length(s) / DIGITS).cast("int") - 1)
        some = F.filter(places, lambda i: (at(s, i) != EMPTY) | (at(t, i) != EMPTY))
        same = F.filter(some, lambda i: at(s, i) == at(t, i))
        return F.coalesce(F.try_divide(F.size(same).cast("double"), F.size(some).cast("double")), F.lit(0.0))

    pairs = F.transform(F.array(F.struct(levels(x, p).alias("s"), levels(y, q).alias("t"))), counted)
    return F.when(a == b, 1.0).when(n <= 0, 0.0).otherwise(F.get(pairs, 0))


@shielded
def with_next(docs: DataFrame, text: str = "text", id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, text and `carry` of every row, with next_text and next_{c} of the next document; after the last comes the first.

    Documents are ordered by the id, null ids last, and of equal ids by a hash of the text. Rows that
    repeat both id and text are one document here and have the same next one. `carry` are columns that
    depend on the text alone. A null text is empty.

    Ids are cut into ranges of about BUCKET_ROWS documents; the bounds of at most BUCKETS ranges are an
    array of a few MB. A text goes to its range's bucket, and the first one of a range to the bucket before
    it too, so each bucket finds its next texts by itself, whatever the ids are. Copies of a row are
    merged before, so a much repeated row doesn't gather.
    """
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_own"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("_text", text_key(F.col("_own")))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text").alias("text"))
    keys = cut(rows.groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_copies")))
    n_keys = keys.count()
    every = max(BUCKET_ROWS, -(-n_keys // BUCKETS))
    in_order = keys.select(order.alias("_key")).repartitionByRange(max(1, -(-n_keys // RANGE_ROWS)), "_key").sortWithinPartitions("_key")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its partition
    ranges = in_order.select("_key", place.alias("_place")).filter(F.col("_place") % every == 0).select("_key")
    bounds = cut(ranges.agg(F.sort_array(F.collect_list("_key")).alias("bounds")))
    n_buckets = max(1, bounds.select(F.size("bounds")).first()[0])
    again = cut(keys.filter("_copies > 1").select("_id", "_text", "_copies"))
    n_again = again.count()
    if n_again:
        hashed = F.xxhash64("_id", "_text")
        rows = sieve(rows, hashed, again.select(hashed.alias("_hash")), n_again)
        firsts = [F.first(c).alias(c) for c in rows.columns if c == "_own" or c.startswith("_c")]
        merged = rows.filter("_maybe").groupBy("_id", "_text").agg(*firsts, F.count(F.lit(1)).alias("_copies"))
        rows = rows.filter("not _maybe").drop("_maybe").withColumn("_copies", F.lit(1).cast("long")).unionByName(merged)
    else:
        rows = rows.withColumn("_copies", F.lit(1).cast("long"))
    rows = rows.withColumn("_key", order).withColumn("_bounds", bounds.select("bounds").scalar())

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        up = F.get("_bounds", middle) <= F.col("_key")
        return F.struct(F.when(up, middle).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(middle - 1).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(n_buckets.bit_length() + 1))
    low = F.aggregate(steps, F.struct(F.lit(0).alias("low"), (F.size("_bounds") - 1).alias("high")), halved, lambda s: s["low"])
    rows = rows.withColumn("_low", low)
    before = F.pmod(F.col("_low") - 1, F.size("_bounds"))
    places = F.array(F.struct(F.col("_low").alias("_bucket"), F.lit(False).alias("_ghost")), F.struct(before.alias("_bucket"), F.lit(True).alias("_ghost")))
    places = F.when(F.get("_bounds", F.col("_low")) == F.col("_key"), places).otherwise(F.slice(places, 1, 1))
    rows = rows.withColumn("_places", places).drop("_bounds", "_key", "_low").withColumn("_place", F.explode("_places"))
    rows = rows.select(*[c for c in rows.columns if c not in ("_places", "_place")], "_place.*")
    near = Window.partitionBy("_bucket").orderBy("_ghost", F.col("_id").isNull(), "_id", "_text")
    found = rows.select("*", F.lead("_own").over(near).alias("_next"), *[F.lead(f"_c{i}").over(near).alias(f"_n{i}") for i in range(len(carry))])
    found = found.filter("not _ghost").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return found.select(
        F.col("_id").alias(id), F.col("_own").alias(text), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_next").alias("next_text"), *[F.col(f"_n{i}").alias(f"next_{c}") for i, c in enumerate(carry)],
    )


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lex = cut(lexicon(docs))
    found = with_next(fingerprinted(docs, lex), carry=("fingerprint",))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    found = fingerprinted(found, lex, "edited", "edited_fingerprint")
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
