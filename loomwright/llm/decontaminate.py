"""Benchmark decontamination by winnowing: the least k-gram hash of each window is its fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import BROADCAST_ROWS, attach, cut, read, shielded, sieve, spread, text_key

#: Words in a window that counts as contamination, and words in a hashed gram. Each run of WINDOW
#: shared words holds WINDOW - GRAM + 1 grams, whose least hash is a fingerprint on both sides.
WINDOW, GRAM = 10, 5
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Array of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def positions(n: Column) -> Column:
    """0 .. n-1, empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def grams(words: str, n: int, tag: bool = False) -> Column:
    """Hashes of all runs of n entries of an array column of word hashes."""
    head = [F.lit(n)] if tag else []
    return F.transform(
        positions(F.size(words) - (n - 1)), lambda i: F.xxhash64(*head, *[F.get(words, i + j) for j in range(n)])
    )


def least(hashes: str, n: int) -> Column:
    """Least of each n neighbours in an array column."""
    return F.transform(
        positions(F.size(hashes) - (n - 1)), lambda i: F.least(*[F.get(hashes, i + j) for j in range(n)])
    )


def fingerprinted(rows: DataFrame, words: str, shorts: list[int]) -> DataFrame:
    """rows with `_mins` (fingerprint of each window start) and `_short{L}` for each length in shorts."""
    rows = rows.withColumn("_wh", F.transform(words, lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_kh", grams("_wh", GRAM))
    rows = rows.withColumn("_mins", least("_kh", WINDOW - GRAM + 1))
    return rows.withColumns({f"_short{n}": grams("_wh", n, tag=True) for n in shorts})


def fingerprints(shorts: list[int]) -> Column:
    return F.array_distinct(F.concat("_mins", *[F.col(f"_short{n}") for n in shorts]))


def weight(df: DataFrame, *arrays: str) -> int:
    """Rows of df and the entries of its arrays together."""
    return df.agg(F.coalesce(F.sum(sum((F.size(a) for a in arrays), F.lit(1))), F.lit(0)).alias("n")).first()["n"]


def shared_windows(
    docs: DataFrame, bench: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(a narrow frame of all docs columns but text, with _text and n_words; hits by _text).

    A window is WINDOW consecutive words of an item, or a whole shorter item. Fingerprints of both
    sides are joined, and each hit is compared word by word, so the hits are exact: _text (128 bits of
    a hash of the text), n_hit (words inside some occurrence), items (ids, sorted as strings), copies
    (rows with that text). Null texts have no words; items without id or words have no windows.

    The fingerprints of the items are broadcast if they were counted to be few. Then those of a document
    are looked up in the scan, and only the hits are written. Otherwise both sides are shuffled.
    """
    items = cut(
        bench.filter("item_id is not null")
        .select(F.col("item_id").cast("string").alias("_item"), words_of(F.col("text")).alias("_words"))
        .filter("size(_words) > 0")
    )
    shorts = sorted(r[0] for r in items.select(F.size("_words")).distinct().filter(f"size(_words) < {WINDOW}").collect())
    item_prints = cut(
        fingerprinted(items, "_words", shorts)
        .select(
            F.explode(
                F.when(F.size("_words") >= WINDOW, F.array_distinct("_mins")).otherwise(
                    F.array(F.coalesce(*[F.when(F.size("_words") == n, F.get(f"_short{n}", F.lit(0))) for n in shorts], F.lit(0)))
                    .cast("array<bigint>")
                )
            ).alias("_fp")
        )
        .distinct()
    )
    length = F.least(F.size("_words"), F.lit(WINDOW))
    item_windows = items.select(
        "_item",
        F.explode(
            F.transform(
                positions(F.size("_words") - length + 1),
                lambda i: F.array_join(F.transform(positions(length), lambda j: F.get("_words", i + j)), " "),
            )
        ).alias("_window"),
    ).distinct()
    item_windows = cut(item_windows)

    rest = [c for c in docs.columns if c != text]
    key = text_key(F.col(text))
    scanned = fingerprinted(docs.select(*rest, key.alias("_text"), words_of(F.col(text)).alias("_words")), "_words", shorts)
    scanned = scanned.select(*rest, "_text", F.size("_words").cast("long").alias("n_words"), fingerprints(shorts).alias("_fps"))
    if item_prints.count() <= broadcast_rows:
        # place 0 stands for the row itself, and is kept for every row
        tried = scanned.select(*rest, "_text", "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "_fps")).alias("_place", "_fp"))
        tried = tried.join(F.broadcast(item_prints.withColumn("_is", F.lit(True))), "_fp", "left").filter("_place = 0 or _is")
        own = [F.when(F.col("_place") == 0, F.col(c)).alias(c) for c in rest]
        tried = cut(tried.select(*own, "_text", "n_words", "_place", "_fp"))
        narrow = tried.filter("_place = 0").select(*rest, "_text", "n_words")
        found = tried.filter("_place > 0").select("_text", "_fp")
    else:
        scanned = cut(scanned)
        narrow = scanned.drop("_fps")
        each = scanned.select("_text", F.explode("_fps").alias("_fp"))
        marked = item_prints.withColumn("is", F.lit(True))
        found = attach(each, marked, ["_fp"], "is", weight(scanned, "_fps"), item_prints.count(), F.xxhash64("_text"), "_in", broadcast_rows)
        found = found.filter("_in is not null").select("_text", "_fp")
    wanted = cut(
        found.groupBy("_text", "_fp")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("_text")
        .agg(F.collect_list("_fp").alias("_prints"), F.max("copies").alias("copies"))
    )
    n_wanted = weight(wanted, "_prints")
    # one row of each text, before the join
    texts = sieve(docs.select(F.col(text).alias("_whole"), key.alias("_text")), F.xxhash64("_text"), wanted.select(F.xxhash64("_text").alias("_hash")), wanted.count())
    texts = texts.filter("_maybe").groupBy("_text").agg(F.first("_whole").alias("_whole"))
    texts = texts.join(F.broadcast(wanted) if n_wanted <= broadcast_rows else wanted, "_text").select("_text", "_whole", "_prints")
    again = fingerprinted(texts.withColumn("_words", words_of(F.col("_whole"))).drop("_whole"), "_words", shorts)

    def starts(name: str, n: int) -> Column:
        hit = F.filter(positions(F.size(name)), lambda i: F.array_contains("_prints", F.get(name, i)))
        return F.transform(hit, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n")))

    hits = again.select(
        "_text",
        "_words",
        F.explode(F.concat(starts("_mins", WINDOW), *[starts(f"_short{n}", n) for n in shorts])).alias("_hit"),
    ).select(
        "_text",
        "_hit.start",
        (F.col("_hit.start") + F.col("_hit.n")).alias("end"),
        F.array_join(F.transform(positions(F.col("_hit.n")), lambda j: F.get("_words", F.col("_hit.start") + j)), " ").alias("_window"),
    )
    # the items of a window are listed once, whatever the number of texts that have it
    of_window = cut(item_windows.groupBy("_window").agg(F.collect_list("_item").alias("items")))
    hits = cut(hits)
    hits = attach(hits, of_window, ["_window"], "items", hits.count(), weight(of_window, "items"), F.xxhash64("_text", "start"), "_of", broadcast_rows)
    hits = cut(hits.filter("_of is not null").select("_text", "start", "end", "_window", F.col("_of.items").alias("_items")))

    def step(state: Column, x: Column) -> Column:
        gained = F.greatest(x["end"] - F.greatest(x["start"], state["end"]), F.lit(0))
        return F.struct(
            (state["n"] + gained).cast("long").alias("n"), F.greatest(state["end"], x["end"]).cast("int").alias("end")
        )

    covered = hits.groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    covered = covered.select(
        "_text",
        F.aggregate(
            "_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end")), step, lambda s: s["n"]
        ).alias("n_hit"),
    )
    named = (
        hits.select("_text", "_window", "_items")
        .dropDuplicates(["_text", "_window"])
        .groupBy("_text")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items"))
    )
    result = covered.join(named, "_text").join(wanted.select("_text", "copies"), "_text")
    return narrow, cut(result)


@shielded
def decontaminate(
    docs: DataFrame, bench: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """All columns of docs but text, with n_words, n_hit, items (array of ids) and contaminated.

    A null or empty text has no words and no hits. Repeated rows stay. Own columns with these names are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    narrow, hits = shared_windows(docs, bench, text, broadcast_rows)
    found = attach(narrow, hits, ["_text"], "copies", narrow.count(), weight(hits, "items"), spread(narrow), "_hits", broadcast_rows)
    return found.select(
        *[c for c in docs.columns if c != text],
        "n_words",
        F.coalesce("_hits.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_hits.items", F.array().cast("array<string>")).alias("items"),
        F.col("_hits").isNotNull().alias("contaminated"),
    )


@shielded
def clean_of(docs: DataFrame, bench: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, whole, that share no window with the benchmark. Rows without words, and repeats, stay."""
    narrow, hits = shared_windows(docs.select(text), bench, text, broadcast_rows)
    rows = docs.withColumn("_text", text_key(F.col(text)))
    found = attach(rows, hits.select("_text", "copies"), ["_text"], "copies", narrow.count(), hits.count(), spread(docs, text), "_hits", broadcast_rows)
    return found.filter("_hits is null").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM ds),
hit AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, t)),
pos AS (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM pos GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
