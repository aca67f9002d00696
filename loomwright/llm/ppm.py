"""Language-model scores by prediction by partial matching over bytes, and a unigram base.

A text is its tokens: runs of anything but white space, lower-cased in A-Z, each followed by one
space, and an end byte. The model is a trie of byte contexts, counted over all training documents.
A byte that the longest context has not seen is predicted by the next shorter one after an escape
(method C: escapes weigh as much as there are different bytes), which leaves out the bytes that the
longer context has seen.

A trie of at most NODES strings of context and byte is held by the workers. Of a larger one every
string is kept too, but in tables: the values of all strings of the scored texts are found by joins
(`values`), the workers hold those of the most frequent strings, and the rest are joined to the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.arrays import SOLID, Table, Words, as_bytes, mixed, pieces, sums, tallied
from loomwright.llm.common import cut, in_fold, read, shielded

#: Bytes of context; strings of context and byte, and words, that workers hold at most, the most
#: frequent ones, while the values of all others are joined.
ORDER, NODES, HELD = 5, 1 << 22, 1 << 20
#: Distinct keys that a worker gathers before it sends their counts on.
GATHERED = 1 << 19
#: Bytes of text worked on at once; the arrays that this takes are about a hundred times as large.
PART = 1 << 18
WORD, GRAM = 0, 1
MASKS = [np.uint64((1 << 8 * k) - 1) for k in range(8)] + [np.uint64(2**64 - 1)]
#: The token that ends every text.
END = int(mixed(np.array([1], np.uint64))[0])


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts as bytes, with the end byte 0 and ORDER - 1 more after each text; text starts."""
    size = np.array(sums(words.lengths + 1, words.first)) + ORDER
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(first[-1]) + ORDER, np.uint8)  # ORDER zeros in front of the first text
    if len(words):
        begin = np.cumsum(words.lengths + 1) - (words.lengths + 1)
        begin += np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(size - ORDER)])[:-1], words.counts) + ORDER
        inside = np.arange(len(words.bytes)) + np.repeat(begin - (np.cumsum(words.lengths) - words.lengths), words.lengths)
        out[inside] = words.bytes
        out[begin + words.lengths] = 0x20
    return out, first


def codes(out: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte that counts, it and the ORDER bytes before it as one number; text starts among them."""
    wide = out.astype(np.uint64)
    code = wide[ORDER:].copy()
    for j in range(1, ORDER + 1):
        code |= wide[ORDER - j : len(wide) - j] << np.uint64(8 * j)
    size = np.diff(first)
    keep = np.ones(len(code), bool)
    for j in range(1, ORDER):
        keep[first[1:] - j] = False
    return code[keep], np.concatenate([[0], np.cumsum(size - (ORDER - 1))])


def count_corpus(docs: DataFrame, kinds: tuple[int, ...] = (WORD, GRAM)) -> DataFrame:
    """kind (WORD or GRAM, those in kinds), key, n over all rows of docs (text)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            return tallied(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))

        def rows(kind: int) -> pa.RecordBatch:
            keys, n = merged(kind)
            held[kind] = []
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"]
            )

        texts = 0
        for batch in batches:
            for piece in pieces(batch, most=PART):
                words = Words(*as_bytes(piece.column("text")), SOLID)
                texts += piece.num_rows
                for kind in kinds:
                    held[kind].append(tallied(words.hashes() if kind == WORD else codes(*stream(words))[0]))
                    if sum(len(k) for k, _ in held[kind]) > GATHERED:
                        held[kind] = [merged(kind)]
                        if len(held[kind][0][0]) > GATHERED // 2:
                            yield rows(kind)
        if WORD in kinds:
            held[WORD].append((np.full(min(texts, 1), END, np.uint64), np.full(min(texts, 1), texts)))
        for kind in kinds:
            if held[kind]:
                yield rows(kind)

    found = docs.select("text").mapInArrow(tell, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Order:
    """What is needed of the contexts of one length."""

    grams: Table  # context and byte
    context: Table
    log_seen: np.ndarray  # of each gram: log10 of its probability without exclusion
    log_count: np.ndarray  # of each gram: log10 of its count
    log_escape: np.ndarray  # of each context, without exclusion
    log_rest: np.ndarray  # of each context: log10 of what the next shorter one has left after exclusion
    log_leave: np.ndarray  # of each context: log10 of an escape from the next shorter one after exclusion


class Trie:
    """Contexts of up to ORDER bytes with their counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        grams, counts = [None] * (ORDER + 1), [None] * (ORDER + 1)
        grams[ORDER], counts[ORDER] = tallied(keys.astype(np.uint64), n)
        for k in range(ORDER - 1, -1, -1):
            grams[k], counts[k] = tallied(grams[k + 1] & MASKS[k + 1], counts[k + 1])
        contexts, total, kinds = [], [], []
        for k in range(ORDER + 1):
            c, t = tallied(grams[k] >> np.uint64(8), counts[k])
            contexts.append(c)
            total.append(t)
            kinds.append(tallied(grams[k] >> np.uint64(8))[1])
        self.orders: list[Order] = []
        self.left = 256 - len(grams[0])  # bytes that no context has seen
        for k in range(ORDER + 1):
            at = np.searchsorted(contexts[k], grams[k] >> np.uint64(8))
            all_ = total[k] + kinds[k]
            rest, leave = np.zeros(0), np.zeros(0)
            if k:
                below = np.searchsorted(grams[k - 1], grams[k] & MASKS[k])
                used = np.bincount(at, counts[k - 1][below], len(contexts[k]))
                up = np.searchsorted(contexts[k - 1], contexts[k] & MASKS[k - 1])
                fewer = kinds[k - 1][up] - kinds[k]
                rest = np.log10(np.maximum(total[k - 1][up] - used + fewer, 1))
                leave = np.where(fewer > 0, np.log10(np.maximum(fewer, 1)) - rest, 0.0)
            self.orders.append(
                Order(
                    Table(mixed(grams[k])), Table(mixed(contexts[k])),
                    *[x.astype(np.float32) for x in (np.log10(counts[k]) - np.log10(all_)[at], np.log10(counts[k]), np.log10(kinds[k]) - np.log10(all_), rest, leave)],
                )
            )

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte after its context."""
        out = np.zeros(len(code))
        todo, from_ = np.arange(len(code)), np.full(len(code), -1)  # the context of the order above, if it is known
        for k in range(ORDER, -1, -1):
            now, o = code[todo] & MASKS[k + 1], self.orders[k]
            gram = o.grams.find(mixed(now))
            hit, known = gram >= 0, from_ >= 0
            above = self.orders[k + 1] if k < ORDER else None
            a = hit & ~known
            out[todo[a]] += o.log_seen[gram[a]]
            if above is not None:
                b = hit & known
                out[todo[b]] += o.log_count[gram[b]] - above.log_rest[from_[b]]
            miss = ~hit
            todo, from_, now, known = todo[miss], from_[miss], now[miss], known[miss]
            if not len(todo):
                return out
            context = o.context.find(mixed(now >> np.uint64(8)))
            first = ~known & (context >= 0)
            out[todo[first]] += o.log_escape[context[first]]
            if above is not None:
                out[todo[known]] += above.log_leave[from_[known]]
            from_ = context.astype(np.int64)
        out[todo] -= np.log10(max(self.left, 1)) if self.orders[0].context.size else np.log10(256)
        return out


@dataclass
class Model:
    """A trie and the counts of the most frequent words, with the sums over all words."""

    trie: Trie | None  # None if it has more than NODES strings
    words: Table
    log_word: np.ndarray  # log10(count + 1) of each held word
    end_count: int
    total: int
    distinct: int
    grams: DataFrame | None = None  # all strings (key, n) if they are more than NODES
    held: Table | None = None  # without a trie: strings whose values the workers hold
    log_held: np.ndarray | None = None

    def log10(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each byte after its context, 0 if it isn't held; whether it is."""
        if self.trie is not None:
            return self.trie.log10(code), np.ones(len(code), bool)
        found = self.held.find(mixed(code))
        known = found >= 0
        out = np.zeros(len(code))
        out[known] = self.log_held[found[known]]
        return out, known


def top(counted: DataFrame, most: int) -> int | None:
    """The least n of the most frequent rows of counted (n), of which there are at most `most`; None: all rows fit.

    Of rows with equal n all or none are among them.
    """
    if counted.count() <= most:
        return None
    least = counted.groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    steps = sorted(((r["n"], r["keys"]) for r in least.orderBy(F.desc("n")).limit(most + 1).collect()), reverse=True)
    held, floor = 0, steps[0][0] + 1
    for n, keys in steps:
        if held + keys > most:
            break
        held, floor = held + keys, n
    return floor


def values(codes: DataFrame, grams: DataFrame) -> DataFrame:
    """codes (key, distinct, and other columns) with value, as Trie.log10 has it for the trie of all grams (key, n).

    Every order has a table of its strings, one of its contexts, and one of the ends of codes, which
    takes from the order below what is added there. At most 256 rows of a table meet in one row of
    another, so no key is hot.
    """

    def end(k: int):
        return F.col("key").bitwiseAND((1 << 8 * k) - 1)

    tables, asked = {ORDER: grams.select("key", "n")}, {ORDER: codes.select("key")}
    for k in range(ORDER - 1, -1, -1):
        tables[k] = cut(tables[k + 1].groupBy(end(k + 1).alias("key")).agg(F.sum("n").alias("n")))
        asked[k] = asked[k + 1].select(end(k + 1).alias("key")).distinct()
    of_context = [F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")]
    before = F.shiftright("key", 8)
    # of each context: rest is what the next shorter one has left, fewer how many bytes it has seen besides
    contexts = tables[0].groupBy(before.alias("context")).agg(*of_context)
    contexts = cut(contexts.withColumns({"rest": F.lit(1).cast("long"), "fewer": F.lit(0).cast("long")}))
    known = {r["key"]: r["n"] for r in tables[0].collect()}
    left = -math.log10(max(256 - len(known), 1))
    found = None
    for k in range(ORDER + 1):
        if k:
            below = tables[k - 1].select(F.col("key").alias("_end"), F.col("n").alias("_n"))
            up = contexts.select(F.col("context").alias("_end"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"))
            own = tables[k].withColumn("_end", end(k)).join(below, "_end")
            own = own.groupBy(before.alias("context")).agg(*of_context, F.sum("_n").alias("_used"))
            own = own.withColumn("_end", F.col("context").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(up, "_end")
            fewer = F.col("_kinds") - F.col("kinds")
            contexts = cut(own.select("context", "total", "kinds", (F.col("_total") - F.col("_used") + fewer).alias("rest"), fewer.alias("fewer")))
        seen = tables[k].select("key", F.log10("n").alias("hit"))
        rows = asked[k].join(seen, "key", "left").withColumn("context", before).join(contexts, "context", "left")
        if k:
            rows = rows.withColumn("_end", end(k)).join(found, "_end", "left")
        else:
            rows = rows.withColumns({"_hit": F.lit(None).cast("double"), "_rest": F.lit(0.0), "_value": F.lit(0.0)})
        every = F.log10(F.col("total") + F.col("kinds"))
        after = F.log10(F.greatest("rest", F.lit(1)))
        leave = F.when(F.col("fewer") > 0, F.log10(F.greatest("fewer", F.lit(1))) - after).otherwise(0.0)
        # what is added below this order once its context is known
        rest = F.coalesce(F.col("_hit") - after, leave + F.col("_rest")) if k else F.lit(left)
        rows = rows.withColumn("_below", F.when(F.col("total").isNotNull(), rest))
        value = F.coalesce(F.col("hit") - every, F.log10("kinds") - every + F.col("_below"), F.col("_value"))
        found = rows.select(F.col("key").alias("_end"), F.col("hit").alias("_hit"), F.col("_below").alias("_rest"), value.alias("_value"))
        if k < ORDER:
            found = cut(found)
    return codes.join(found.select(F.col("_end").alias("key"), F.col("_value").alias("value")), "key")


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows of docs (text), and the words that it doesn't hold: key, n."""
    counts = cut(count_corpus(docs))
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    sizes = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = words.filter(F.col("key") == F.lit(np.uint64(END).astype(np.int64).item())).first()
    grams, trie = counts.filter(F.col("kind") == GRAM).select("key", "n"), None
    if grams.count() <= NODES:
        whole = grams.toArrow().to_pandas()
        trie, grams = Trie(whole["key"].to_numpy(np.int64).view(np.uint64), whole["n"].to_numpy(np.int64)), None
    floor = top(words, HELD)
    held = (words if floor is None else words.filter(F.col("n") >= floor)).toArrow().to_pandas()
    model = Model(
        trie,
        Table(held["key"].to_numpy(np.int64).view(np.uint64)),
        np.log10(held["n"].to_numpy(np.float64) + 1),
        end["n"] if end else 0, sizes["n"], sizes["v"], grams,
    )
    few = words.filter(F.lit(False) if floor is None else F.col("n") < floor)
    return model, few


def with_values(docs: DataFrame, model: Model) -> tuple[Model, DataFrame]:
    """A model without a trie with the values of the most frequent strings of docs (text), and all other strings: key, value."""
    found = cut(values(count_corpus(docs, (GRAM,)).select("key", "n"), model.grams))
    floor = top(found, NODES)
    held = (found if floor is None else found.filter(F.col("n") >= floor)).select("key", "value").toArrow().to_pandas()
    few = found.filter(F.lit(False) if floor is None else F.col("n") < floor).select("key", "value")
    table = Table(mixed(held["key"].to_numpy(np.int64).view(np.uint64)))
    return replace(model, grams=None, held=table, log_held=held["value"].to_numpy(np.float32)), few


@shielded
def score(docs: DataFrame, model: Model, others: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score.

    base_score is the sum of log10((c + 1) / (N + V + 1)) over a text's tokens, of which the last is
    the end token; c is 0 for unknown tokens. Null is the empty text, whose only token is the end.
    Without training documents c, N and V are 0 and each byte has probability 1/256. Each row stands for
    itself, repeated rows too; own columns with these names are replaced.
    """
    context = docs.sparkSession.sparkContext
    joined = others.select(F.lit(WORD).alias("_kind"), F.col("key").alias("_key"), F.log10(F.col("n") + 1).alias("_value"))
    pairs = [others.count() > 0, False]
    if model.trie is None:
        model, strings = with_values(docs.select(F.col(text).alias("text")), model)
        joined = joined.unionAll(strings.select(F.lit(GRAM).alias("_kind"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        pairs[GRAM] = strings.count() > 0
    shared = context.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    fields = [F.lit(0).cast("long").alias("_row"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_key"), F.lit(0).cast("long").alias("_times")]
    numbers = [F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")]
    schema = docs.select(*rest, *fields, *numbers).schema
    for f in schema.fields:
        f.nullable = True

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = TaskContext.get().partitionId() << 33
        names = [*rest, "_row", "_kind", "_key", "_times", "n_tokens", "n_known", "base_score", "score"]
        shift, end = np.log10(m.total + m.distinct + 1), np.log10(m.end_count + 1)
        for batch in batches:
            for piece in pieces(batch, "_text", PART):
                words = Words(*as_bytes(piece.column("_text")), SOLID)
                hashes = words.hashes()
                found = m.words.find(hashes)
                known = found >= 0
                value = np.where(known, m.log_word[found], 0.0) if len(m.log_word) else np.zeros(len(found))
                n = words.counts + 1
                base = sums(value, words.first) + end - n * shift
                code, first = codes(*stream(words))
                log, has = m.log10(code)
                number = np.arange(row, row + len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[piece.column(c) for c in rest],
                        pa.array(number), pa.array(np.full(len(n), -1, np.int32)), pa.array(mixed(number.astype(np.uint64)).view(np.int64)),
                        pa.array(np.zeros(len(n), np.int64)),
                        pa.array(n), pa.array(sums(known.astype(np.int64), words.first) + (m.end_count > 0)), pa.array(base),
                        pa.array(sums(log, first)),
                    ],
                    names=names,
                )
                # the words and strings that are not held go on to the join with the others
                for kind, keys, starts, is_held in ((WORD, hashes, words.first, known), (GRAM, code, first, has)):
                    if not pairs[kind] or is_held.all():
                        continue
                    owner = np.repeat(np.arange(len(n)), np.diff(starts))[~is_held]
                    key = keys[~is_held]
                    order = np.lexsort((key, owner))
                    owner, key = owner[order], key[order]
                    at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]))
                    none = [pa.nulls(len(at), piece.column(c).type) for c in rest]
                    yield pa.RecordBatch.from_arrays(
                        [*none, pa.array(number[owner[at]]), pa.array(np.full(len(at), kind, np.int32)), pa.array(key[at].view(np.int64)),
                         pa.array(np.diff(np.append(at, len(key)))),
                         *[pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]],
                        names=names,
                    )

    scored = docs.select(*rest, F.col(text).alias("_text")).mapInArrow(tell, schema)
    out = ["n_tokens", "n_known", "base_score", "score"]
    if any(pairs):
        gain = F.col("_times") * F.coalesce("_value", F.lit(0.0))
        both = scored.join(joined.hint("shuffle_merge"), ["_kind", "_key"], "left")
        scored = (
            both.groupBy("_row")
            .agg(
                *[F.first(c, ignorenulls=True).alias(c) for c in [*rest, *out]],
                F.sum(F.when((F.col("_kind") == WORD) & F.col("_value").isNotNull(), F.col("_times")).otherwise(0)).alias("_more"),
                *[F.sum(F.when(F.col("_kind") == kind, gain).otherwise(0.0)).alias(name) for kind, name in ((WORD, "_gain"), (GRAM, "_log"))],
            )
            .withColumns({"n_known": F.col("n_known") + F.col("_more"), "base_score": F.col("base_score") + F.col("_gain"), "score": F.col("score") + F.col("_log")})
        )
    return scored.select(*rest, "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; learned from those with crc32(doc_id) % 7 <> 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 7, 2)
    model, others = learn(docs.filter(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, others)
