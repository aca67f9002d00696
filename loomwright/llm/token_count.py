"""Token counts by rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.arrays import Table, Words, as_bytes, mixed, pieces, sums
from loomwright.llm.common import read, shielded

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens of more symbols are merged one at a time from a heap.
LONG = 2048
#: Counts of pre-tokens that a worker remembers; beyond that it starts afresh.
REMEMBERED = 1 << 20
#: No rank, and the bits of a place beside a rank in one number.
NONE, PLACE = np.int64(1) << 24, np.int64(36)


class Merger:
    """A byte-fallback BPE vocabulary whose pieces have the white space mark only in front.

    A merge joins two neighbours whose concatenation is a piece; the piece with the best score goes
    first, of equal scores the leftmost. So no merge crosses from a word into the white space after
    it, and each run of spaces with the word after it is a pre-token of its own.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        words = [model.id_to_piece(i) for i in ids]
        if any("▁" in w.lstrip("▁") for w in words):
            raise ValueError("pieces with a white space mark inside aren't supported")
        score = {w: model.get_score(i) for i, w in zip(ids, words, strict=True)}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        number = {w: k for k, w in enumerate(words)}
        self.chars = {w: k for w, k in number.items() if len(w) == 1}
        pairs, ranks, made = [], [], []
        for w, k in number.items():
            for i in range(1, len(w)):
                a, b = number.get(w[:i]), number.get(w[i:])
                if a is not None and b is not None:
                    pairs.append((a << 20) | b)
                    ranks.append(order[score[w]])
                    made.append(k)
        self.pairs = Table(mixed(np.array(pairs, np.uint64)))
        self.ranks, self.made = np.array(ranks, np.int64), np.array(made, np.int64)
        self.known: dict[bytes, int] = {}

    def symbols(self, word: str) -> tuple[list[int], int]:
        """Numbers of the characters, -1 for one that is no piece, and the bytes of those."""
        out = [self.chars.get(c, -1) for c in word]
        return out, sum(len(c.encode()) for c, k in zip(word, out, strict=True) if k < 0)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each pair; NONE where it is no merge."""
        at = self.pairs.find(mixed(((a << 20) | b).astype(np.uint64)))
        at[(a < 0) | (b < 0)] = -1
        return np.where(at >= 0, self.ranks[at], NONE), self.made[at]

    def merge_all(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token: all take their best pair in the same step, until none has one."""
        out = np.zeros(len(words), np.int64)
        parts, sizes, whose = [], [], []
        for i, w in enumerate(words):
            ids, extra = self.symbols(w)
            out[i] = extra - sum(k < 0 for k in ids)
            if len(ids) > LONG:
                out[i] += self.merge_long(ids)
            elif ids:
                parts.append(ids)
                sizes.append(len(ids))
                whose.append(i)
        if not parts:
            return out
        symbol = np.fromiter((k for p in parts for k in p), np.int64, sum(sizes))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        alive = np.array(sizes)
        while len(symbol) > 1:
            rank, made = self.look(symbol[:-1], symbol[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            # the best pair of each owner, the leftmost of equals
            key = np.append((rank << PLACE) + np.arange(len(rank)), NONE << PLACE)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(key, first)
            has = best < (NONE << PLACE)
            if not has.any():
                break
            at = best[has] & ((np.int64(1) << PLACE) - 1)
            symbol[at] = made[at]
            alive[owner[at]] -= 1
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            stay &= np.repeat(has, np.diff(np.append(first, len(owner))))  # the others are done
            symbol, owner = symbol[stay], owner[stay]
        out[whose] += alive
        return out

    def merge_long(self, ids: list[int]) -> int:
        """The same for one long pre-token in n log n."""
        n = len(ids)
        symbol, right, left, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), n
        rank, made = self.look(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r < NONE]
        heapq.heapify(heap)
        gone = [False] * n
        lookup: dict[tuple[int, int], tuple[int, int]] = {}

        def add(i: int) -> None:
            j = right[i] if i >= 0 else n
            if i < 0 or j >= n or symbol[i] < 0 or symbol[j] < 0:
                return
            pair = (symbol[i], symbol[j])
            if pair not in lookup:
                r, m = self.look(np.array([pair[0]]), np.array([pair[1]]))
                lookup[pair] = (int(r[0]), int(m[0]))
            if lookup[pair][0] < NONE:
                heapq.heappush(heap, (lookup[pair][0], i, *pair, lookup[pair][1]))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j], right[i], alive = m, True, right[j], alive - 1
            if right[j] < n:
                left[right[j]] = i
            add(left[i])
            add(i)
        return alive

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        data, offsets = as_bytes(texts)
        # a mark in a text is the same as a space
        if (data == 0xE2).any() and any("▁" in (t or "") for t in texts.to_pylist()):
            data, offsets = as_bytes(pa.array([(t or "").replace("▁", " ") for t in texts.to_pylist()], pa.string()))
        words = Words(data, offsets, NOT_SPACE)
        # a pre-token: a word and the spaces before it, and at the start of a text one more
        texts_of = words.texts()
        since = np.maximum(np.concatenate([[0], words.ends[:-1]]) if len(words) else words.ends, offsets[:-1][texts_of])
        head = (since == offsets[:-1][texts_of]).tolist()
        raw = data.tobytes()
        keys = [b" " + raw[a:b] if h else raw[a:b] for a, b, h in zip(since.tolist(), words.ends.tolist(), head, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = list({k for k in keys if k not in self.known})
        if fresh:
            self.known.update(zip(fresh, self.merge_all([k.decode().replace(" ", "▁") for k in fresh]).tolist(), strict=True))
        known = self.known
        out = sums(np.fromiter((known[k] for k in keys), np.int64, len(keys)), words.first)
        # spaces after the last word, or a text of spaces alone
        last = np.where(words.counts > 0, words.ends[np.maximum(words.first[1:], 1) - 1] if len(words) else 0, offsets[:-1])
        trail = offsets[1:] - last + ((words.counts == 0) & (np.diff(offsets) > 0))
        for s in np.unique(trail[trail > 0]).tolist():
            out[trail == s] += int(self.merge_all(["▁" * s])[0])
        return out


@cache
def of_path(path: str) -> Merger:
    """One for each worker, which its tasks share."""
    return Merger(path)


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = False


@shielded
def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no tokens. Each row stands for itself, repeated rows too; own columns
    n_bytes, n_tokens and over_limit are replaced. The model is read by each worker from its path, as the
    library's own files are installed on all of them.
    """
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = of_path(model)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                n = merger.counts(piece.column("_text"))
                size = np.diff(as_bytes(piece.column("_text"))[1])
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in rest], pa.array(size), pa.array(n)], names=[*rest, "n_bytes", "n_tokens"])

    found = docs.select(*rest, F.col(text).alias("_text")).mapInArrow(count, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(MODEL))
