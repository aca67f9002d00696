"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.arrays import pieces, sums
from loomwright.llm.common import in_fold, labelled, read, shielded

#: Entries of a hypervector, letters told apart, letters in a gram.
SIZE, LETTERS, GRAM = 512, 4096, 3
#: Labelled documents that the prototypes are bundled from, and half as many more of rare languages, at most.
SAMPLE = 8_000
SHARPNESS = 24.0
#: Parts that an entry of a unit document is counted in when documents are added up.
UNITS = 1 << 24
#: Rows of gram vectors that are in memory at once.
ROWS = 1 << 14

RANDOM = np.random.default_rng(5).integers(0, 2, (LETTERS, SIZE), dtype=np.int8) * 2 - 1
#: The letter vectors permuted by their place in the gram.
TURNED = [np.ascontiguousarray(np.roll(RANDOM, GRAM - 1 - i, axis=1)) for i in range(GRAM)]
IS_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter numbers of all texts (0: a run of anything else), where each text starts, its letters."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in low])
    code = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = IS_LETTER[np.minimum(code, 0xFFFF)]
    for c in np.unique(code[code > 0xFFFF]):
        letter[code == c] = chr(c).isalpha()
    number = np.where(letter, code % (LETTERS - 1) + 1, 0).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one break after each run of letters
    kept = np.concatenate([[0], np.cumsum(keep)])
    return number[keep], kept[at], sums(letter.astype(np.int64), at)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hypervector of each text, and how many letters it has.

    A gram is bound by multiplying its permuted letter vectors; a text is the sum of its grams, where
    the root of a gram's count is its weight, so that one repeated word doesn't drown the others.
    """
    number, at, letters = letters_of(texts)
    out = np.zeros((len(texts), SIZE), np.float32)
    if not len(number):
        return out, letters
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    place = np.arange(len(number)) - at[owner]
    padded = np.concatenate([[0] * (GRAM - 1), number])
    code = np.zeros(len(number), np.int64)
    for i in range(GRAM):  # before a text there are breaks, not the letters of the text before it
        code = code * LETTERS + np.where(place >= GRAM - 1 - i, padded[i : i + len(number)], 0)
    key = np.sort(owner * LETTERS**GRAM + code)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.sqrt(np.diff(np.append(first, len(key)))).astype(np.float32)
    owner, code = np.divmod(key[first], LETTERS**GRAM)
    grams, row = np.unique(code, return_inverse=True)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a in range(0, len(grams), ROWS):  # each gram is bound once, for all texts of the piece
        part = grams[a : a + ROWS]
        bound = TURNED[GRAM - 1][part % LETTERS]
        for i in range(GRAM - 1):
            bound = bound * TURNED[i][part // LETTERS ** (GRAM - 1 - i) % LETTERS]
        bound = bound.astype(np.float32)
        mine = np.flatnonzero((row >= a) & (row < a + len(part))) if len(grams) > ROWS else None
        if mine is None:
            for k in range(len(texts)):
                x = slice(cut[k], cut[k + 1])
                out[k] = weight[x] @ bound[row[x]]
        else:
            at_text = np.searchsorted(owner[mine], np.arange(len(texts) + 1))
            for k in range(len(texts)):
                x = mine[at_text[k] : at_text[k + 1]]
                out[k] += weight[x] @ bound[row[x] - a]
    return out, letters


def bundled(texts: list[str | None], place: np.ndarray, n: int) -> np.ndarray:
    """For each of n languages the sum of its unit documents, in units of 1 / UNITS; place says which each text has.

    Whole numbers add up to the same sum in any order, so a rerun learns the same prototypes.
    """
    vectors, letters = bundles(texts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    total = np.zeros((n, SIZE), np.int64)
    np.add.at(total, place, np.rint(vectors.astype(np.float64) * (letters > 0)[:, None] * UNITS).astype(np.int64))
    return total


def unit(total: np.ndarray) -> np.ndarray:
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def prototypes(texts: list[str | None], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Learned language names, sorted, and a unit vector for each: the sum of its unit documents."""
    names, place = np.unique(np.array(langs, object), return_inverse=True) if langs else ([], np.zeros(0, int))
    total = np.zeros((len(names), SIZE), np.int64)
    for a in range(0, len(texts), 256):
        total += bundled(texts[a : a + 256], place[a : a + 256], len(names))
    return list(names), unit(total)


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """`prototypes` of docs (doc_id, text) with labels (doc_id, label), of about `bound` rows, rare languages included.

    Texts are bundled where they are; the driver gets one vector of SIZE numbers for each language. A
    row of docs has the id that its label has in labels.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                names, place = np.unique(np.array(piece.column("label").to_pylist(), object), return_inverse=True)
                for name, row in zip(names, bundled(piece.column("text").to_pylist(), place, len(names)), strict=True):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([row.tolist()], pa.list_(pa.int64()))], names=["label", "row"])

    sample = labelled(docs, labels, bound, every_label=True).select("text", F.col("label").cast("string").alias("label"))
    parts = sample.mapInArrow(tell, "label string, row array<long>").select("label", F.posexplode("row").alias("at", "x"))
    found = parts.groupBy("label", "at").agg(F.sum("x").alias("x")).toArrow()
    names = sorted(set(found["label"].to_pylist()))
    total = np.zeros((len(names), SIZE))
    total[[names.index(x) for x in found["label"].to_pylist()], found["at"].to_numpy()] = found["x"].to_numpy()
    return names, unit(total)


@shielded
def identify(docs: DataFrame, names: list[str], vectors: np.ndarray, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score.

    lang_pred is the language whose prototype has the greatest cosine with the text (of equals the
    first name); score is its share of the softmax of the cosines. A text that is null or has no
    letter is `und` with score 0, as is every text if no language was learned. Each row stands for
    itself, repeated rows too; own columns lang_pred and score are replaced.
    """
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = docs.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*names, "und"], object)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                found, letters = bundles(piece.column("_text").to_pylist())
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
                known = (letters > 0) & bool(names)
                best, score = np.full(len(found), len(names)), np.zeros(len(found))
                if names:
                    cosine = (found @ vectors.T).astype(np.float64)
                    share = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                    best = np.where(known, cosine.argmax(axis=1), len(names))
                    score = np.where(known, 1 / share.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in rest], pa.array(labels[best], pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"]
                )

    return docs.select(*rest, F.col(text).alias("_text")).mapInArrow(tell, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from rows with crc32(doc_id) % 5 <> 0.

    Text and lang are of one row: rows are known by id and lang together, so where an id repeats each
    text keeps its own.
    """
    docs = read(spark, sf_dir, "documents")
    row = F.xxhash64("doc_id", "lang")
    training = docs.filter(~in_fold(F.col("doc_id"), 5, 0) & F.col("lang").isNotNull()).select(row.alias("doc_id"), F.col("lang").alias("label"))
    names, vectors = learn(docs.select(row.alias("doc_id"), "text"), training)
    held = docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return identify(held, names, vectors)
