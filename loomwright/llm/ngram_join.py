"""Near duplicates: a Jaccard join of word n-gram sets by MinHash banding, with every link verified.

Documents with the same n-gram set are one class of copies, and the join is among classes. In each
band bucket one member is the centre, and the others are compared with it on their full sets. Jaccard
distance is a metric, so if one of two linked members is linked to the centre, the other is within
twice the limit of it. Such members of a centre are its canopy, and links inside a canopy are counted
block against block: no row stands for a pair, and blocks of members whose distances from the centre
add up to no more than the limit are linked throughout and not compared at all. Members that are linked
to no such centre, but within twice the limit of one that many are near, are compared in blocks with all
that they share a bucket with. What is left is banded again, with longer bands that only
similar sets have in common, and those few pairs are enumerated and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.arrays import Words, as_bytes, mixed, pieces
from loomwright.llm.common import BROADCAST_ROWS, Rounds, attach, cut, only, read, shielded, spread, text_key

#: Words in an n-gram, least similarity, hashes in a band, part of the pairs at that similarity that meet.
WIDTH, THRESHOLD, ROWS, RECALL = 5, 0.8, 4, 0.99999
#: Hashes in a band of the second banding; sets that a centre must be home to, for a canopy, unless it
#: meets few: so many in all its buckets together.
LONG_ROWS, HOST, FEW = 12, 16, 200
#: Sets without a home that must be near one centre, to be compared in blocks and not pair by pair.
CROWD = 1_000
#: Steps in which distances are rounded up; sets and n-grams of a block, about; columns compared at once.
STEPS, BLOCK_SETS, BLOCK_GRAMS, WIDE = 1_000, 200, 60_000, 8_192


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands needed for pairs at the threshold to share one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def ngrams(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct word n-grams; a shorter text is one n-gram, if it has words."""
    words = Words(*as_bytes(texts))
    h, out = words.hashes(), []
    if len(h):
        n = max(len(h) - width + 1, 0)
        grams = np.zeros(n, np.uint64)
        for j in range(width):
            grams = (grams + h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        grams = mixed(grams)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for x in h[a:b]:
                short = (short + x) * np.uint64(0xD1B54A32D192ED03)
            out.append(mixed(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(grams: np.ndarray) -> bytes:
    """128 bits that tell n-gram sets apart."""
    return mixed(np.array([grams.sum(), mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64)).tobytes()


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Hashes of all bands of each set; sets must not be empty."""
    if not sets:
        return np.zeros((0, bands), np.uint64)
    random = np.random.default_rng(1)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), np.uint64(b + 1))
        for _ in range(rows):
            a, c = random.integers(1, 2**32, 2, dtype=np.uint32)
            least = np.minimum.reduceat(low * (a | np.uint32(1)) ^ c, first)
            key = (key + least) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(29)
        out[:, b] = mixed(key)
    return out


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """docs (_id, _text, text) with _set (null if no words), _size and _bands."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = ngrams(piece.column("text"), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = signatures([sets[i] for i in full], bands, rows).view(np.int64)
                row = dict(zip(full, keys, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("_id"),
                        piece.column("_text"),
                        pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([row.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    names=["_id", "_text", "_set", "_size", "_bands"],
                )

    return docs.mapInArrow(tell, "_id long, _text binary, _set binary, _size long, _bands array<long>")


def _banded(grams: DataFrame, bands: int, rows: int) -> DataFrame:
    """_set and _bands of _set and _grams."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                keys = signatures([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("_grams")], bands, rows).view(np.int64)
                at = pa.array(np.arange(len(keys) + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("_set"), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=["_set", "_bands"])

    return grams.select("_set", "_grams").mapInArrow(tell, "_set binary, _bands array<long>")


def _grams_of(docs: DataFrame, width: int) -> DataFrame:
    """_set and its n-grams as bytes, of docs (text)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = ngrams(piece.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_set", "_grams"]
                )

    return docs.mapInArrow(tell, "_set binary, _grams binary")


def _compared(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """pairs (a, b) with both, the number of shared n-grams, and either, of all."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(np.intersect1d(p, q, assume_unique=True))
                both.append(n)
                either.append(len(p) + len(q) - n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"]
            )

    joined = pairs.join(grams.select(F.col("_set").alias("a"), F.col("_grams").alias("_x")).hint("shuffle_merge"), "a").join(
        grams.select(F.col("_set").alias("b"), F.col("_grams").alias("_y")).hint("shuffle_merge"), "b"
    )
    return joined.select("a", "b", "_x", "_y").mapInArrow(tell, "a binary, b binary, both long, either long")


def _counted(rows: DataFrame, threshold: float) -> DataFrame:
    """Links between the sets of two blocks of a canopy, or inside one, on their full n-gram sets.

    Gives (_set, null, w): copies of the sets that it is linked to, and (_set, other, null): links that
    hold nodes together, as few as do. A pair belongs to the greatest home of its tight members, so that
    it is counted in one canopy only; pairs of near members of a canopy in several blocks are left out.
    """
    kind = "_set binary, other binary, w long"

    def tell(table: pa.Table) -> pa.Table:
        n = table.num_rows
        order = np.lexsort((np.array(table["_set"].to_pylist(), object),)) if n else np.zeros(0, np.int64)
        table = table.take(pa.array(order))
        host = table["host"][0].as_py()
        names, home, node = table["_set"].to_pylist(), table["home"].to_pylist(), table["node"].to_pylist()
        tight, ring = np.array(table["tight"].to_pylist()), np.array(table["_ring"].to_pylist())
        copies, whole = np.array(table["_copies"].to_pylist()), table["_parts"][0].as_py() == 1
        mine = np.array(table["_mine"].to_pylist())
        same = table["_block"][0].as_py() == table["_other"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table["_grams"].to_pylist()]
        size = np.array([len(x) for x in sets])
        every, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        shared = np.zeros((n, n), np.float32)
        for c in range(0, len(every), WIDE):
            a, b = np.searchsorted(column, [c, c + WIDE])
            dense = np.zeros((n, min(WIDE, len(every) - c)), np.float32)
            dense[row[a:b], column[a:b] - c] = 1
            shared += dense @ dense.T
        link = shared >= (size[:, None] + size - shared) * (threshold - 1e-9)
        np.fill_diagonal(link, False)
        if not same:
            link &= mine[:, None] != mine
        if not whole:
            link &= ~((ring[:, None] == 0) & (ring == 0))
        rank = {x: k for k, x in enumerate(sorted({host, *home}))}
        at = np.where(tight, np.array([rank[x] for x in home]), -1)
        link &= np.maximum(at[:, None], at) == rank[host]
        w = link @ copies
        label = np.arange(n)
        while True:
            low = np.minimum(label, np.where(link, label, n).min(axis=1, initial=n))
            if (low == label).all():
                break
            label = low
        apart = [(names[i], names[k]) for i, k in enumerate(label.tolist()) if node[i] != node[k]]
        some = np.flatnonzero(w)
        return pa.table(
            {
                "_set": pa.array([*[names[i] for i in some], *[p for p, _ in apart]], pa.binary()),
                "other": pa.array([*[None] * len(some), *[q for _, q in apart]], pa.binary()),
                "w": pa.array([*w[some].tolist(), *[None] * len(apart)], pa.int64()),
            }
        )

    return rows.groupBy("host", "_block", "_other").applyInArrow(tell, kind)


def components(edges: DataFrame) -> DataFrame:
    """node and label, the same for all nodes that edges (a, b) connect; label is the least node."""
    rounds = Rounds(edges.sparkSession)
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = rounds.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node").select("node", F.least("label", "_near").alias("label"), F.col("label").alias("_old"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        fresh = rounds.cut(lower.join(of_label, "label", "left").select("node", F.least("label", "_next").alias("label"), "_old"))
        changed = fresh.filter("label <> _old").limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    rows: int = ROWS,
    recall: float = RECALL,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row for each of docs: id, _text (a hash of the text), class_id, n_links, n_copies.

    Words are runs of letters and digits, lower-cased in A-Z. class_id is the least id among the
    documents that links connect; n_links is the number of other documents with similarity of at
    least `threshold`; n_copies the number of documents with the same n-gram set, itself counted.
    Texts without words (null too) are alone, with no links. Ids are whole numbers; a null id counts as
    the greatest id, and rows that repeat an id are documents of their own. An empty table has no rows.
    """
    hashed = text_key(F.col(text))
    source = docs.select(F.col(id).cast("long").alias("_id"), hashed.alias("_text"), F.col(text).alias("text"))
    signed = cut(_signed(source, width, band_count(threshold, rows, recall), rows))
    n_rows = signed.count()
    sets = cut(
        signed.filter("_set is not null")
        .groupBy("_set", "_size")
        .agg(F.count(F.lit(1)).alias("_copies"), F.min("_id").alias("_least"), F.min("_text").alias("_one"), F.first("_bands").alias("_bands"))
    )
    slots = sets.select("_set", "_size", F.explode("_bands").alias("_key"))
    buckets = cut(slots.groupBy("_key").agg(F.count(F.lit(1)).alias("_in")).filter("_in > 1"))
    n_slots, n_buckets = sets.count() * band_count(threshold, rows, recall), buckets.count()
    members = cut(
        attach(slots, buckets, ["_key"], "_in", n_slots, n_buckets, F.col("_set"), "_bucket", broadcast_rows, complete=True)
        .filter("_bucket is not null")
        .select("_key", "_set", "_size", F.col("_bucket._in").alias("_in"))
    )
    # the centre of a bucket is the set that meets most others in all its buckets
    fame = cut(members.groupBy("_set").agg(F.sum("_in").alias("_fame")))
    famous = cut(members.join(fame, "_set"))
    centres = cut(
        famous.groupBy("_key").agg(
            F.max(F.struct("_fame", F.col("_set").alias("centre"), F.col("_size").alias("centre_size"))).alias("_best"), F.count(F.lit(1)).alias("_in")
        )
    ).select("_key", "_in", "_best.centre", "_best.centre_size")
    placed = cut(
        attach(famous.drop("_in"), centres, ["_key"], "_in", n_slots, n_buckets, F.col("_set"), "_c", broadcast_rows, complete=True).select(
            "_key", "_set", "_size", "_fame", "_c.centre", "_c.centre_size"
        )
    )

    def fits(a: str, b: str, least: float):
        """What the sizes allow for a similarity of `least`."""
        return F.least(a, b) >= F.greatest(a, b) * (least - 1e-9)

    near, wide = 1 - threshold, 1 - 2 * (1 - threshold)
    limit = int(round(near * STEPS))
    bin = F.ceil((F.col("either") - F.col("both")) * STEPS / F.col("either") - F.lit(1e-9)).cast("int")
    is_link = F.col("both") >= F.col("either") * (threshold - 1e-9)
    wanted = cut(members.select("_set").distinct().join(sets.select("_set", F.col("_one").alias("_text")), "_set").select("_text").distinct())
    texts = only(source.select("_text", "text"), wanted, "_text", wanted.count(), broadcast_rows).dropDuplicates(["_text"])
    grams = cut(_grams_of(texts.select("text"), width))

    def compared(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with the rounded distance and whether they are linked, as far as the canopy goes."""
        found = _compared(pairs, grams).select("a", "b", F.least(bin, F.lit(2 * limit + 1)).alias("bin"), is_link.alias("link"))
        return cut(found.filter(F.col("link") | (F.col("bin") <= 2 * limit)))

    stars = cut(
        placed.filter("_set <> centre").filter(fits("_size", "centre_size", wide)).select(F.col("centre").alias("a"), F.col("_set").alias("b")).distinct()
    )
    starred = compared(stars)
    # each set's home is the centre with most links that it is linked to, or itself; small ones don't count
    degree = cut(starred.filter("link").groupBy("a").agg(F.count(F.lit(1)).alias("_links")))
    choice = starred.filter("link").join(degree, "a").select(F.col("b").alias("_set"), F.struct("_links", F.col("a").alias("home")).alias("_c"))
    itself = fame.select(F.col("_set").alias("a")).join(degree, "a", "left")
    itself = itself.select(F.col("a").alias("_set"), F.struct(F.coalesce("_links", F.lit(0)).alias("_links"), F.col("a").alias("home")).alias("_c"))
    chosen = cut(choice.union(itself).groupBy("_set").agg(F.max("_c").alias("_c")).select("_set", "_c.home"))
    hosts = cut(chosen.groupBy(F.col("home").alias("host")).agg(F.count(F.lit(1)).alias("_guests")).filter("_guests > 1"))
    hosts = cut(hosts.join(fame.withColumnRenamed("_set", "host"), "host").filter((F.col("_guests") >= HOST) | (F.col("_fame") <= FEW)).drop("_fame"))
    is_host = cut(chosen.join(hosts.select(F.col("host").alias("_set"), F.lit(True).alias("_is")), "_set", "left"))
    with_home = attach(is_host, hosts.withColumnRenamed("host", "home"), ["home"], "_guests", n_slots, hosts.count(), F.col("_set"), "_h", broadcast_rows, complete=True)
    settled = with_home.select(
        "_set",
        F.when(F.col("_h").isNotNull(), F.col("home")).otherwise(F.col("_set")).alias("home"),
        (F.col("_h").isNotNull() | F.col("_is").isNotNull()).alias("tight"),
    )
    settled, hosts = cut(settled), hosts.select("host")
    lodged = cut(placed.join(settled, "_set").select("_key", "_set", "_size", "centre", "home", "tight"))
    # where a bucket's members have another home than its centre, all its members meet that one too
    others = lodged.filter("tight and home <> centre").select("_key", F.col("home").alias("a")).distinct()
    others = others.join(sets.select(F.col("_set").alias("a"), F.col("_size").alias("a_size")), "a")
    guests = others.hint("shuffle_merge").join(lodged.select("_key", "_set", "_size"), "_key").filter((F.col("a") != F.col("_set")) & fits("_size", "a_size", wide))
    guests = guests.select("a", F.col("_set").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    visited = starred.union(compared(guests))

    def in_blocks(canopy: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """canopy (host, _set, _size, _copies, home, node, tight, _ring) of at least so many sets: their blocks, links, sizes."""
        sizes = cut(canopy.groupBy("host").agg(F.count(F.lit(1)).alias("_in"), F.sum("_size").alias("_grams")))
        parts = F.greatest(F.lit(1), F.ceil(F.col("_in") / BLOCK_SETS), F.ceil(F.col("_grams") / BLOCK_GRAMS)).cast("long")
        dealt = attach(canopy, sizes.withColumn("_parts", parts), ["host"], "_in", canopy.count(), sizes.count(), F.col("_set"), "_s", broadcast_rows, complete=True)
        # ring 0: near (all linked to each other), 1: the rest; blocks of either by a hash
        block = F.when(F.col("_s._parts") == 1, F.lit(0)).otherwise(F.col("_ring") * F.col("_s._parts") + F.pmod(F.xxhash64("_set"), F.col("_s._parts")))
        dealt = cut(
            dealt.filter(F.col("_s._in") >= least).select("host", "_set", "home", "node", "tight", "_copies", F.col("_s._parts").alias("_parts"), "_ring", block.cast("long").alias("_block"))
        )
        blocks = dealt.groupBy("host", "_block").agg(F.first("_parts").alias("_parts"), F.max("_ring").alias("_ring"))
        one, two = blocks, blocks.select("host", F.col("_block").alias("_other"), F.col("_ring").alias("_other_ring"))
        turns = one.join(two, "host").filter("_block <= _other and (_parts = 1 or _ring = 1 or _other_ring = 1)")
        turns = cut(turns.select("host", "_block", "_other"))
        sides = turns.select("host", F.col("_block").alias("_mine"), "_block", "_other").union(
            turns.filter("_block <> _other").select("host", F.col("_other").alias("_mine"), "_block", "_other")
        )
        full = dealt.withColumnRenamed("_block", "_mine").join(grams.hint("shuffle_merge"), "_set").join(sides, ["host", "_mine"])
        return dealt, cut(_counted(full, threshold)), sizes

    copies = sets.select("_set", "_size", "_copies")
    # sets without a home: those near a centre that many such are near go to its canopy, with all they share a bucket with
    loose = cut(lodged.filter("not tight").select("_set", "_size").distinct())
    around = starred.select("a", F.col("b").alias("_set")).join(loose.select("_set").hint("shuffle_merge"), "_set", "left_semi")
    company = cut(around.groupBy("a").agg(F.count(F.lit(1)).alias("_near")).filter(F.col("_near") >= CROWD))
    crowds = []
    if company.count():
        lodging = around.join(company, "a").select("_set", F.struct("_near", F.col("a").alias("home")).alias("_c"))
        landlord = company.join(loose, company["a"] == loose["_set"]).select("_set", F.struct("_near", F.col("a").alias("home")).alias("_c"))
        lodging = cut(lodging.union(landlord).groupBy("_set").agg(F.max("_c").alias("_c")).select("_set", F.col("_c.home").alias("_lodging")))
        seated = cut(lodged.filter("not tight").select("_key", "_set").join(lodging, "_set", "left"))
        tables = seated.filter("_lodging is not null").select("_key", F.col("_lodging").alias("host")).distinct()
        outer = tables.hint("shuffle_merge").join(seated, "_key").select("host", "_set", "_lodging").distinct().join(copies, "_set")
        outer = cut(
            outer.select("host", "_set", "_size", "_copies", F.coalesce("_lodging", "_set").alias("home"), F.col("_set").alias("node"), F.col("_lodging").isNotNull().alias("tight"), F.lit(1).alias("_ring"))
        )
        crowds.append(in_blocks(outer, 2)[1])
        loose = cut(loose.join(lodging.hint("shuffle_merge"), "_set", "left_anti"))
    # pairs of which neither has either
    keyed = _banded(grams.join(loose.select("_set").hint("shuffle_merge"), "_set", "left_semi"), band_count(threshold, LONG_ROWS, recall), LONG_ROWS)
    keyed = cut(keyed.select("_set", F.explode("_bands").alias("_key")))
    shared = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_in")).filter("_in > 1").select("_key")
    keyed = cut(keyed.join(shared.hint("shuffle_merge"), "_key").join(loose, "_set"))
    left, right = keyed.select("_key", F.col("_set").alias("a"), F.col("_size").alias("a_size")), keyed.withColumnRenamed("_set", "b")
    strays = left.hint("shuffle_merge").join(right, "_key").filter((F.col("a") < F.col("b")) & fits("_size", "a_size", threshold))
    strays = cut(compared(strays.select("a", "b").distinct()).filter("link").select("a", "b"))

    # canopies: all sets within twice the limit of a host
    canopy = visited.join(hosts.select(F.col("host").alias("a")), "a").select(F.col("a").alias("host"), F.col("b").alias("_set"), "bin")
    canopy = canopy.union(hosts.select("host", F.col("host").alias("_set"), F.lit(0).alias("bin")))
    ring = F.when((F.col("home") == F.col("host")) & (F.col("bin") * 2 <= limit), 0).otherwise(1)
    canopy = cut(canopy.join(settled, "_set").join(copies, "_set").withColumn("node", F.col("home")).withColumn("_ring", ring))
    n_canopy = canopy.count()
    dealt, told, sizes = in_blocks(canopy, 3)
    for crowd in crowds:
        told = told.union(crowd)
    # near members of a canopy in blocks are all linked
    rings = dealt.filter("_parts > 1 and _ring = 0").groupBy("host").agg(F.sum("_copies").alias("_all"), F.count(F.lit(1)).alias("_in"))
    near_ones = dealt.filter("_parts > 1 and _ring = 0")
    implied = attach(near_ones, cut(rings), ["host"], "_in", n_canopy, sizes.count(), F.col("_set"), "_r", broadcast_rows, complete=True)
    implied = implied.select("_set", (F.col("_r._all") - F.col("_copies")).alias("w"))
    # a canopy of two is one pair, and a stray pair is counted as it is
    linked = visited.filter("link").select(F.col("a").alias("host"), F.col("b").alias("_set"))
    two_only = canopy.join(sizes.filter("_in = 2").select("host"), "host").filter("_set <> host").join(linked, ["host", "_set"])
    host_home = settled.select(F.col("_set").alias("host"), F.col("home").alias("host_home"))
    owner = F.when(F.col("tight"), F.greatest("home", "host_home")).otherwise(F.col("host_home"))
    two_only = two_only.join(host_home, "host").filter(owner == F.col("host"))
    single = cut(strays.union(two_only.select("host", "_set")))
    weight = sets.select(F.col("_set").alias("b"), F.col("_copies").alias("w"))
    direct = single.union(single.select("b", "a")).join(weight, "b").select(F.col("a").alias("_set"), "w")
    counted = told.filter("other is null").select("_set", "w").union(implied).union(direct).groupBy("_set").agg(F.sum("w").alias("_links"))
    # classes: sets by homes, homes by the links between them
    of_set = settled.select(F.col("_set").alias("a"), F.col("home").alias("a_home"))
    far = told.filter("other is not null").select(F.col("_set").alias("a"), F.col("other").alias("b"))
    crossed = strays.union(far).union(starred.filter("link").select("a", "b"))
    edges = crossed.join(of_set, "a").join(of_set.select(F.col("a").alias("b"), F.col("a_home").alias("b_home")), "b").select(F.col("a_home").alias("a"), F.col("b_home").alias("b"))
    labels = components(edges.filter("a <> b"))
    named = cut(
        settled.join(counted, "_set", "left")
        .join(labels.withColumnRenamed("node", "home"), "home", "left")
        .join(sets.select("_set", "_least"), "_set")
        .select("_set", "_least", F.coalesce("label", "home").alias("_label"), F.coalesce("_links", F.lit(0)).alias("_links"))
    )
    classes = cut(named.groupBy("_label").agg(F.min("_least").alias("class_id"), F.count(F.lit(1)).alias("_in")))
    named = attach(named, classes, ["_label"], "_in", n_slots, classes.count(), F.col("_set"), "_k", broadcast_rows, complete=True).select(
        "_set", "_links", F.col("_k.class_id").alias("class_id")
    )
    # sets that meet no other have only their own copies
    whole = cut(
        sets.join(named, "_set", "left")
        .filter("_copies > 1 or _links > 0")
        .select("_set", "_copies", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("class_id", "_least").alias("class_id"))
    )
    keyed = signed.select("_id", "_text", "_set")
    found = attach(keyed, whole, ["_set"], "_copies", n_rows, whole.count(), spread(keyed), "_w", broadcast_rows, complete=True)
    return found.select(
        F.col("_id").alias(id),
        "_text",
        F.when(F.col("_w").isNull(), F.col("_id")).otherwise(F.col("_w.class_id")).alias("class_id"),
        F.coalesce(F.col("_w._links") + F.col("_w._copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_w._copies", F.lit(1)).cast("long").alias("n_copies"),
    )


@shielded
def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, whole, with the least id of each class of near duplicates; one if it repeats.

    A null id counts as the greatest. Texts without words stay, all of them.
    """
    found = cut(near_duplicates(docs, text, id, broadcast_rows=broadcast_rows))
    linked = found.filter("n_links > 0")
    first = linked.filter(F.col(id).eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("_class")).agg(F.min("_text").alias("_first"), F.count(F.lit(1)).alias("_times"))
    judged = cut(
        linked.join(first, F.col(id).eqNullSafe(F.col("_class")), "left")
        .select(F.col(id).alias("_of"), F.col("_text").alias("_whose"), F.coalesce(F.col("_first") == F.col("_text"), F.lit(False)).alias("_stays"), "_times")
        .distinct()
    )
    rows = docs.select("*", F.col(id).cast("long").alias("_id"), text_key(F.col(text)).alias("_text"))
    few = judged.count() <= broadcast_rows
    told = rows.join(F.broadcast(judged) if few else judged, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_whose")), "left")
    once = told.filter("_stays is null or _stays and _times = 1").select(*docs.columns)
    repeated = told.filter("_stays and _times > 1").dropDuplicates(["_id", "_text"]).select(*docs.columns)
    return once.unionByName(repeated)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("_text")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (
  SELECT a, b, k = x.n AND k = y.n AS same FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY a),
degrees AS (SELECT a AS r, count(*) AS n_links, count(*) FILTER (WHERE same) AS twins FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(twins, 0) + 1 AS n_copies
FROM d JOIN classes USING (r) LEFT JOIN degrees USING (r)
"""
