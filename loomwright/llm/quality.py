"""Quality by Bradley-Terry ranking: documents win over others in preference pairs.

Every labelled document counts, and every pair of a good and a bad one. No pair is made: the loss needs only how
many documents of a label have a feature in a bin and a score in a cell, so a step is one job that counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.arrays import SOLID, Words, as_bytes, mixed, pieces, sums, tallied
from loomwright.llm.common import cut, in_fold, read, shielded

#: Bins of a feature, less one; steps of learning; weight of the squared weights.
BINS, STEPS, DECAY = 8, 14, 1e-3
#: Rows that a task counts, about.
PART_ROWS = 1 << 16
#: Cells of scores that a step counts in, and those for the threshold.
CELLS, FINE = 256, 1 << 16
#: Bits of a feature's value that its cell leaves off: cells are within a part in 1,024 of each other.
CUT = 42

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0xF5)]] = True  # one for each letter's first byte
CAPITAL = np.zeros(256, bool)
CAPITAL[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:'-?\"()"]] = True
ODD = ~(LETTER | DIGIT | STOP)
ODD[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC2)]] = False
BREAK = np.zeros(256, bool)
BREAK[0x0A] = True
NAMES = "log_words mean_word letters capitals digits stops odd breaks distinct repeats repeated_pairs repeated_lines".split()


def features(texts: pa.Array) -> np.ndarray:
    """One row of len(NAMES) numbers for each whole text; all 0 for texts without words."""
    data, at = as_bytes(texts)
    words = Words(data, at, SOLID)
    n = np.maximum(words.counts, 1)
    size = np.maximum(np.diff(at), 1)
    hashes, owner = words.hashes(), words.texts()

    def share(kind: np.ndarray) -> np.ndarray:
        return sums(kind[data].astype(np.int64), at) / size

    def distinct(keys: np.ndarray, whose: np.ndarray) -> np.ndarray:
        """Different keys of each text."""
        both = np.sort((whose.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
        first = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return np.bincount((first >> np.uint64(40)).astype(np.int64), minlength=len(n))

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pair = mixed(hashes[1:] * np.uint64(3) + hashes[:-1]) if len(hashes) > 1 else hashes[:0]
    inner = owner[1:] == owner[:-1] if len(hashes) > 1 else np.zeros(0, bool)
    pairs = np.bincount(owner[1:][inner], minlength=len(n)) if len(hashes) > 1 else np.zeros(len(n))
    lines = Words(data, at, ~BREAK)
    n_lines = np.maximum(lines.counts, 1)
    out = np.column_stack(
        [
            np.log1p(words.counts),
            sums(words.lengths, words.first) / n,
            share(LETTER),
            share(CAPITAL),
            share(DIGIT),
            share(STOP),
            share(ODD),
            share(BREAK),
            distinct(hashes, owner) / n,
            np.bincount(owner[same], minlength=len(n)) / n,
            1 - distinct(pair[inner], owner[1:][inner]) / np.maximum(pairs, 1) * (pairs > 0) - (pairs == 0),
            1 - distinct(lines.hashes(), lines.texts()) / n_lines,
        ]
    )
    out[words.counts == 0] = 0
    return out.astype(np.float64)


@dataclass
class Ranking:
    """Weights of binned features, and the score at which a document is as good as not."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        """One column for each feature and bin, 1 where the feature is in it."""
        out = np.zeros((len(x), x.shape[1], BINS + 1))
        for j, e in enumerate(self.edges):
            out[np.arange(len(x)), j, np.searchsorted(e, x[:, j], "right")] = 1
        return out.reshape(len(x), -1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.binned(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)))


    def cells(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The cell of each score, of equal cells between the least and the greatest score that there can be."""
        low, width = self.extent(cells)
        return np.clip(((self.raw(x) - low) / width).astype(np.int64), 0, cells - 1)

    def extent(self, cells: int) -> tuple[float, float]:
        """The least score that there can be, and the width of a cell."""
        w = self.weights.reshape(len(NAMES), BINS + 1)
        low, high = w.min(axis=1).sum(), w.max(axis=1).sum()
        return float(low), max(float(high - low), 1e-9) / cells

    def centres(self, cells: int) -> np.ndarray:
        low, width = self.extent(cells)
        return low + (np.arange(cells) + 0.5) * width


def counted(rows: DataFrame, keys: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """How often each key below `size` is told of by keys(features, good) over all rows (features, label), added up by tasks."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            k, n = keys(x, batch.column("label").to_numpy() == 1)
            held = tallied(np.concatenate([held[0], k.astype(np.uint64)]), np.concatenate([held[1], n.astype(np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].astype(np.int64))], names=["key", "n"])

    found = rows.mapInArrow(tell, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out


def edges_of(rows: DataFrame) -> np.ndarray:
    """For each feature its quantiles over all rows, to a part in 1,024."""
    top = int(np.array([2.0**40]).view(np.int64)[0] >> CUT)
    bottom = int(np.array([2.0**-40]).view(np.int64)[0] >> CUT) - 1  # 0 and what is next to it
    span = top - bottom + 1

    def keys(x: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.clip((np.maximum(x, 0.0) + 0.0).view(np.int64) >> CUT, bottom, top) - bottom
        return tallied((cell + np.arange(len(NAMES)) * span).ravel().astype(np.uint64))

    upto = np.cumsum(counted(rows, keys, len(NAMES) * span).reshape(len(NAMES), span), axis=1)
    at = np.array([np.searchsorted(c, np.arange(1, BINS + 1) / (BINS + 1) * c[-1]) for c in upto])
    return np.where(at > 0, (at + bottom << CUT).view(np.float64), 0.0)


def rank(rows: DataFrame) -> Ranking:
    """Learn from all pairs of a good and a bad row of rows (features, label): logistic loss on the difference of their features.

    Each step goes to the least value of a parabola above the loss (its curvature is at most a quarter of the
    pairs' squared differences), so the loss never grows. Scores count by the centres of CELLS cells. The
    threshold is the quantile of the training scores above which there are as many documents as there are good
    ones. Without any pair every document scores 0.5 or more if any label is 1.
    """
    width, per = len(NAMES) * (BINS + 1), BINS + 1
    model = Ranking(np.zeros((len(NAMES), BINS)), np.zeros(width), 0.0, 1.0)
    bad, good = counted(rows, lambda x, up: tallied(up.astype(np.uint64)), 2)
    if not good or not bad:
        model.threshold = -1.0 if good or not bad else 1.0
        return model
    model.edges = edges_of(rows)

    def together(x: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = model.binned(x)
        both = np.stack([b[~up].T @ b[~up], b[up].T @ b[up]]).ravel()
        return np.flatnonzero(both), both[both > 0]

    def scored(x: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = np.nonzero(model.binned(x))[1].reshape(len(x), len(NAMES))
        return tallied((((up * width)[:, None] + columns) * CELLS + model.cells(x, CELLS)[:, None]).ravel().astype(np.uint64))

    squares = counted(rows, together, 2 * width * width).reshape(2, width, width)
    low, high = squares[0] / bad, squares[1] / good
    cross = np.outer(np.diag(high), np.diag(low))
    curve = (high + low - cross - cross.T) / 4 + DECAY * np.eye(width)
    for _ in range(STEPS):
        n = counted(rows, scored, 2 * width * CELLS).reshape(2, width, CELLS)
        n = n[0] / bad, n[1] / good
        c = model.centres(CELLS)
        wrong = 1 / (1 + np.exp(np.clip(c[:, None] - c[None, :], -30, 30)))  # of a good cell (row) and a bad one
        of_good, of_bad = wrong @ n[0][:per].sum(axis=0), n[1][:per].sum(axis=0) @ wrong
        model.weights = np.round(model.weights + np.linalg.solve(curve, n[1] @ of_good - n[0] @ of_bad - DECAY * model.weights), 9)
    n, c = counted(rows, lambda x, _: tallied(model.cells(x, FINE).astype(np.uint64)), FINE), model.centres(FINE)
    model.threshold = threshold(n, c, int(bad))
    middle = (n * c).sum() / n.sum()
    model.spread = max(float(np.sqrt((n * (c - middle) ** 2).sum() / n.sum())) / 2, 1e-6)
    return model


def threshold(n: np.ndarray, centres: np.ndarray, bad: int) -> float:
    """The middle of the gap between the scores of the rows number `bad` and the next, of n rows in each cell."""
    upto = np.cumsum(n)
    k = min(max(bad, 1), int(upto[-1]) - 1)
    return float((centres[np.searchsorted(upto, k)] + centres[np.searchsorted(upto, k + 1)]) / 2)


@shielded
def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with an array column `features`."""
    rest = [c for c in docs.columns if c not in (text, "features")]
    schema = docs.select(*rest, F.array(F.lit(0.0)).alias("features")).schema

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                x = features(piece.column("_text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in rest], flat], names=[*rest, "features"])

    return docs.select(*rest, F.col(text).alias("_text")).mapInArrow(tell, schema)


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """A ranking from all rows of docs (doc_id, text) with labels (doc_id, label 0 or 1).

    An id that repeats in docs counts once, with the row that has the greatest hash; of several labels of an id
    the greatest counts. Only features are shuffled.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    told = with_features(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"))
    rows = told.join(one, "doc_id").groupBy("doc_id").agg(F.max_by(F.struct("features", F.col("label").cast("int").alias("label")), "hash").alias("row"))
    # few tasks, as each tells its own counts: what they tell grows with the rows, not with the parts of the tables
    return rank(cut(rows.select("row.features", "row.label").coalesce(max(1, -(-one.count() // PART_ROWS)))))


@shielded
def score_quality(docs: DataFrame, model: Ranking, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score and predicted (score >= 0.5), without the text unless keep_text.

    Null and empty texts get the score of a text whose features are all 0. Each row stands for itself,
    repeated rows too; own columns score and predicted are replaced.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text)]
    schema = docs.select(*rest, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                score = model.score(features(piece.column("_text")))
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in rest], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*rest, "score", "predicted"]
                )

    return docs.select(*rest, F.col(text).alias("_text")).mapInArrow(tell, schema)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and label of the rows that may be learned from."""
    labels = read(spark, sf_dir, "labels")
    return labels.filter(~in_fold(F.col("doc_id"), 3, 1)).select("doc_id", F.col("quality").alias("label"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from rows with crc32(doc_id) % 3 <> 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, quality_labels(spark, sf_dir))
    return score_quality(docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "text"), model)
