"""Toxic spans by a linear-chain conditional random field with two states."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.arrays import BYTE_CODES, LOWER, Table, Words, as_bytes, mixed, pieces, powers, sums
from loomwright.llm.common import cut, in_fold, labelled, read, shielded

#: Labelled documents to learn from, and half as many more of a rare label. The different chains of words
#: of them are learned from on the driver if they are at most CHAINS, else where they are, in PARTS tasks.
SAMPLE, CHAINS, PARTS = 20_000, 1 << 16, 64
#: A trait needs so many toxic documents, and so large a part of its documents (in equal classes) toxic.
SUPPORT, PURITY = 4, 0.97
#: Steps of learning; neighbours kept between known words while learning; length of a chain then.
STEPS, NEAR, CHAIN = 150, 3, 64
#: Features beside the traits: that the word before, or after, has a known trait too.
CONTEXT = 2
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4, 5)


def traits(words: Words, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of whole words, of their first and of their last bytes: (words that have one, hashes)."""
    out = [(np.arange(len(words)), words.hashes())]
    low, power = LOWER[data], powers(16)
    for k, sizes in ((1, PREFIXES), (2, SUFFIXES)):
        for n in sizes:
            have = np.flatnonzero(words.lengths > n)
            at = words.starts[have] if k == 1 else words.ends[have] - n
            h = np.full(len(have), np.uint64(k * 16 + n))
            for j in range(n):
                h = h + BYTE_CODES[low[at + j]] * power[j]
            out.append((have, mixed(h)))
    return out


def count_traits(sample: DataFrame) -> DataFrame:
    """trait, clean, toxic: documents of either label with the trait."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, at = as_bytes(piece.column("text"))
                words, toxic = Words(data, at), piece.column("label").to_numpy(zero_copy_only=False) == 1
                owner, found = words.texts(), traits(words, data)
                key = np.concatenate([h for _, h in found])
                whose = np.concatenate([owner[have] for have, _ in found])
                order = np.lexsort((whose, key))
                key, whose = key[order], whose[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])
                key, bad = key[new], toxic[whose[new]]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                n, n_bad = np.diff(np.append(first, len(key))), np.add.reduceat(bad.astype(np.int64), first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(n - n_bad), pa.array(n_bad)], names=["trait", "clean", "toxic"])

    found = sample.select("text", "label").mapInArrow(count, "trait long, clean long, toxic long")
    return found.groupBy("trait").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


@dataclass
class Field:
    """Weights of the toxic state, relative to the clean one, and of documents."""

    keys: np.ndarray  # hashes of the traits
    weights: np.ndarray  # of the traits, then of CONTEXT
    bias: float
    moves: np.ndarray  # 2 x 2, logarithms
    document: np.ndarray  # of 1, the largest marginal, log(1 + expected toxic words)

    def __post_init__(self) -> None:
        self.table = Table(self.keys)
        self.move = np.exp(self.moves)
        # powers of the matrix of unknown words, but for a factor: one + ratio ** n * two
        step = self.move * np.array([1.0, np.exp(self.bias)])
        middle, half = np.trace(step) / 2, (step[0, 0] - step[1, 1]) / 2
        root = np.sqrt(half**2 + step[0, 1] * step[1, 0])
        self.one, self.two = (step - (middle - root) * np.eye(2)) / (2 * root), ((middle + root) * np.eye(2) - step) / (2 * root)
        self.ratio = (middle - root) / (middle + root)

    def gaps(self, n: np.ndarray) -> np.ndarray:
        """The matrix of n unknown words in a row, for each n, but for a factor."""
        return self.one + (self.ratio ** n.astype(np.int64))[:, None, None] * self.two

    def known(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that have a known trait, in order, and the score of each for the toxic state."""
        score, any_known = np.full(len(words), self.bias), np.zeros(len(words), bool)
        for have, h in traits(words, data):
            at = self.table.find(h)
            hit = at >= 0
            score[have[hit]] += self.weights[at[hit]]
            any_known[have[hit]] = True
        at = np.flatnonzero(any_known)
        beside = np.zeros(max(len(at) - 1, 0), bool)
        if len(at) > 1:
            owner = words.texts()[at]
            beside = (at[1:] - at[:-1] == 1) & (owner[1:] == owner[:-1])
        score = score[at]
        score[1:] += self.weights[-2] * beside
        score[:-1] += self.weights[-1] * beside
        return at, score

    def marginals(self, words: Words, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each known word, by forward-backward over whole texts.

        All texts step at once from one known word to the next; the unknown words between are a
        power of one matrix.
        """
        first = np.searchsorted(at, words.first)
        n = np.diff(first)
        out = np.zeros(len(at))
        if not len(at):
            return out
        place = at - np.repeat(words.first[:-1], n)
        before = place.copy()
        before[1:] -= place[:-1] + 1
        starts = first[:-1][n > 0]
        before[starts] = place[starts]
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        begin, size = first[:-1][order], n[order]
        emit = np.exp(np.clip(score, -30, 30))
        forward = np.zeros((len(at), 2))
        state = np.tile([1.0, 0.0], (len(order), 1))
        for k in range(int(size.max())):
            live = int(np.searchsorted(-size, -k, "left"))  # texts with more than k known words
            x = begin[:live] + k
            v = np.einsum("ij,ijk->ik", state[:live], self.gaps(before[x])) @ self.move
            v[:, 1] *= emit[x]
            state[:live] = v / v.sum(axis=1, keepdims=True)
            forward[x] = state[:live]
        rest = words.counts[order] - place[begin + size - 1] - 1
        state = self.gaps(rest).sum(axis=2)
        for k in range(int(size.max()) - 1, -1, -1):
            live = int(np.searchsorted(-size, -k, "left"))
            x = begin[:live] + k
            p = forward[x] * state[:live]
            out[x] = p[:, 1] / p.sum(axis=1)
            v = state[:live].copy()
            v[:, 1] *= emit[x]
            v = np.einsum("ijk,ik->ij", self.gaps(before[x]), v @ self.move.T)
            state[:live] = v / v.sum(axis=1, keepdims=True)
        return out

    def summary(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row for each text: 1, the largest marginal, log(1 + expected toxic words)."""
        n = len(first) - 1
        top = np.zeros(n)
        has = np.flatnonzero(np.diff(first) > 0)
        if len(has):
            top[has] = np.maximum.reduceat(marginal, first[has])
        return np.column_stack([np.ones(n), top, np.log1p(sums(marginal, first))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def chains(keys: np.ndarray, texts: pa.Array, toxic: np.ndarray) -> list[tuple[list[list[int]], list[int]]]:
    """Features and states of the words around known ones. A word of a toxic text with a known trait is toxic."""
    table, out = Table(keys), []
    data, at = as_bytes(texts)
    words = Words(data, at)
    have: dict[int, list[int]] = {}
    for who, h in traits(words, data):
        found = table.find(h)
        for i in np.flatnonzero(found >= 0):
            have.setdefault(int(who[i]), []).append(int(found[i]))
    owner = words.texts()
    last, chain, state = -10, [], []
    for w in sorted(have):
        new = last < 0 or owner[w] != owner[last] or len(chain) > CHAIN
        gap = NEAR if new else min(NEAR, w - last - 1)
        if new:
            if chain:
                out.append((chain, state))
            chain, state = [], []
        if not new and not gap:
            chain[-1] = [*chain[-1], len(keys) + 1]
            chain.append([*have[w], len(keys)])
        else:
            chain += [[]] * gap + [have[w]]
        state += [0] * gap + [int(toxic[owner[w]])]
        last = w
    if chain:
        out.append((chain, state))
    return out


@dataclass
class Gold:
    """Labelled chains as arrays: of each its length, its states, and how often it occurs; cells and features in them."""

    size: np.ndarray
    state: np.ndarray
    times: np.ndarray
    cell: np.ndarray
    feature: np.ndarray
    n_features: int


def gold(sequences: list[tuple[list[list[int]], list[int], int]], n_features: int) -> Gold:
    size = np.array([len(s) for _, s, _ in sequences])
    top = int(size.max())
    state, cell, feature = np.zeros((len(sequences), top), np.int64), [], []
    for i, (chain, states, _) in enumerate(sequences):
        state[i, : len(states)] = states
        for t, found in enumerate(chain):
            cell += [i * top + t] * len(found)
            feature += found
    return Gold(size, state, np.array([k for _, _, k in sequences], float), np.array(cell, np.int64), np.array(feature, np.int64), n_features)


def likelihood(theta: np.ndarray, g: Gold) -> tuple[float, np.ndarray]:
    """Log-likelihood of the states, and its gradient, by forward-backward over all chains at once.

    theta: weights of the features, bias of the toxic state, and the moves from clean to toxic, toxic
    to clean and toxic to toxic. A chain starts in the clean state.
    """
    n, top = g.state.shape
    mask = np.arange(top) < g.size[:, None]
    w, bias, moves = theta[: g.n_features], theta[g.n_features], np.append(0.0, theta[g.n_features + 1 :]).reshape(2, 2)
    score = (np.bincount(g.cell, w[g.feature], n * top) + bias).reshape(n, top)
    emit, move = np.exp(np.clip(score, -30, 30)), np.exp(moves)
    alpha, beta = np.zeros((top, n, 2)), np.ones((top, n, 2))
    state, log_z = np.tile([1.0, 0.0], (n, 1)), np.zeros(n)
    for t in range(top):
        x = state @ move
        x[:, 1] *= emit[:, t]
        all_ = x.sum(axis=1, keepdims=True)
        log_z += np.log(all_[:, 0]) * mask[:, t]
        state = np.where(mask[:, t, None], x / all_, state)
        alpha[t] = state
    state = np.ones((n, 2))
    for t in range(top - 1, -1, -1):
        beta[t] = state
        x = state.copy()
        x[:, 1] *= emit[:, t]
        x = x @ move.T
        state = np.where(mask[:, t, None], x / x.sum(axis=1, keepdims=True), state)
    p = alpha * beta
    p = (p / p.sum(axis=2, keepdims=True))[:, :, 1].T * mask
    lack = (g.state - p) * mask * g.times[:, None]
    grad = np.zeros_like(theta)
    grad[: g.n_features] = np.bincount(g.feature, lack.ravel()[g.cell], g.n_features)
    grad[g.n_features] = lack.sum()
    e = beta.transpose(1, 0, 2).copy()
    e[:, :, 1] *= emit
    a = np.concatenate([np.tile([1.0, 0.0], (n, 1, 1)), alpha.transpose(1, 0, 2)[:, :-1]], axis=1)
    both = a[:, :, :, None] * move * e[:, :, None, :]
    both = both / both.sum(axis=(2, 3), keepdims=True) * (mask * g.times[:, None])[:, :, None, None]
    before = np.concatenate([np.zeros((n, 1), np.int64), g.state[:, :-1]], axis=1)
    pair = before * 2 + g.state
    seen = np.bincount(pair[mask], np.broadcast_to(g.times[:, None], mask.shape)[mask], minlength=4)
    grad[g.n_features + 1 :] = (seen - both.sum(axis=(0, 1)).ravel())[1:]
    value = (score * g.state * mask).sum(axis=1) + (moves.ravel()[pair] * mask).sum(axis=1) - log_z
    return float(value @ g.times), grad


Sequences = list[tuple[list[list[int]], list[int], int]]


def unknown(n: int) -> tuple[list[list[int]], list[int], int]:
    """The chain of unknown words, all clean, that is added to n others, and how often."""
    return [[]] * 8, [0] * 8, max(10, n // 4)


def fit(sequences: Sequences, n_features: int, transitions: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
    """The weights, bias and moves of chains that are here: features of each word, states, and how often the chain occurs."""
    n = sum(k for _, _, k in sequences)
    chains = gold([*sequences, unknown(n)], n_features)
    return climb(lambda theta: likelihood(theta, chains)[1], chains.times.sum(), n_features, transitions)


def fit_where_they_are(found: DataFrame, n: int, n_features: int) -> tuple[np.ndarray, float, np.ndarray]:
    """The same of chains in a frame (chain, state, n): tasks add up the gradients of theirs, one job a step."""
    spread = cut(found.repartition(PARTS, F.xxhash64("chain", "state")))
    own = gold([unknown(n)], n_features)

    def gradient(theta: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(theta)
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    rows = batch.slice(a, 4096).to_pylist()
                    total += likelihood(theta, gold([(r["chain"], r["state"], r["n"]) for r in rows], n_features))[1]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["gradient"])

        parts = spread.mapInArrow(add, "gradient array<double>").toArrow()["gradient"].to_pylist()
        return likelihood(theta, own)[1] + np.sum([np.zeros_like(theta), *map(np.array, parts)], axis=0)

    return climb(gradient, n + own.times.sum(), n_features)


def climb(gradient: Callable[[np.ndarray], np.ndarray], times: float, n_features: int, transitions: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximise the likelihood of the states, with a small prior, by full gradients (Adam).

    Without transitions the moves stay 0, so that words are judged one by one, to see what moves add.
    """
    theta = np.zeros(n_features + 4)
    theta[n_features] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = gradient(theta) / times - 1e-4 * theta
        if not transitions:
            grad[n_features + 1 :] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), np.append(0.0, theta[n_features + 1 :]).reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, with a small prior."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.05 * w), -4, 4)
    return w


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, transitions: bool = True) -> Field:
    """A field from docs (doc_id, text) and labels (doc_id, label 0 or 1), `bound` of them and half as many of a rare label.

    Words of toxic texts are labelled by their traits: one that is seen in at least SUPPORT toxic
    texts and hardly in clean ones marks its word. Without labels of both kinds the field knows no
    trait, and the score is the share of toxic labels. Every chain of the sample counts.
    """
    sample = cut(labelled(docs, labels, bound, every_label=True))  # read four times; the whole texts are scanned once
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_clean, n_toxic = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    rate = F.col("toxic") / n_toxic
    pure = rate / (rate + (F.col("clean") + 0.5) / n_clean)
    best = (
        count_traits(sample).filter(F.col("toxic") >= SUPPORT).withColumn("pure", pure).filter(F.col("pure") >= PURITY)
        .select("trait").orderBy("trait").toArrow().to_pandas()
    )
    keys = best["trait"].to_numpy(np.int64).view(np.uint64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                y = piece.column("label").to_numpy(zero_copy_only=False) == 1
                found = chains(keys, piece.column("text"), y)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([s for _, s in found], pa.list_(pa.int32()))], names=["chain", "state"]
                )

    found = sample.select("text", "label").mapInArrow(gather, "chain array<array<int>>, state array<int>")
    found = cut(found.groupBy("chain", "state").agg(F.count(F.lit(1)).alias("n")))
    size = found.agg(F.count(F.lit(1)).alias("chains"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if size["chains"] > CHAINS:
        w, bias, moves = fit_where_they_are(found, size["n"], len(keys) + CONTEXT)
    else:
        rows = found.withColumn("at", F.xxhash64("chain", "state")).toArrow().sort_by("at").to_pylist()
        w, bias, moves = fit([(r["chain"], r["state"], r["n"]) for r in rows], len(keys) + CONTEXT, transitions)
    field = Field(keys, w, bias, moves, np.zeros(3))

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, at = as_bytes(piece.column("text"))
                words = Words(data, at)
                known, score = field.known(words, data)
                x = field.summary(field.marginals(words, known, score), np.searchsorted(known, words.first))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), piece.column("label")], names=["top", "sum", "label"])

    x = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(sums_of, "top double, sum double, label int").toArrow().to_pandas()
    x = x.sort_values(["top", "sum", "label"])  # the same sums on every run
    field.document = logistic(np.column_stack([np.ones(len(x)), x["top"], x["sum"]]), (x["label"] == 1).to_numpy(float))
    return field


@shielded
def score_toxicity(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs without the text, with score, predicted and spans (start and end in code points, marginal).

    Null and empty texts have no words, and the score that a text without known words has. Each row
    stands for itself, repeated rows too; own columns score, predicted and spans are replaced.
    """
    rest = [c for c in docs.columns if c not in (text, "score", "predicted", "spans")]
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("marginal")))
    schema = docs.select(*rest, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), span.alias("spans")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                data, at = as_bytes(piece.column("_text"))
                words = Words(data, at)
                known, emission = field.known(words, data)
                marginal = field.marginals(words, known, emission)
                first = np.searchsorted(known, words.first)
                score = field.score(field.summary(marginal, first))
                hit = np.flatnonzero(marginal >= 0.5)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(hit) else np.zeros(1, np.int64)
                spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
                for i, k in zip(np.searchsorted(first, hit, "right") - 1, hit, strict=True):
                    a, b = words.starts[known[k]], words.ends[known[k]]
                    spans[i].append({"start": int(chars[a] - chars[at[i]]), "end": int(chars[b] - chars[at[i]]), "marginal": float(marginal[k])})
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in rest], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                    names=[*rest, "score", "predicted", "spans"],
                )

    return docs.select(*rest, F.col(text).alias("_text")).mapInArrow(tell, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document; learned from rows with crc32(doc_id) % 5 <> 0."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~in_fold(F.col("doc_id"), 5, 0))
    field = learn(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return score_toxicity(docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "text"), field)
