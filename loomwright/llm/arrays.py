"""Texts as byte arrays: pieces of Arrow batches, word spans, word hashes and hash tables in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

#: Words are runs of letters and digits, or of anything that is not white space.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each text starts and the last ends."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, in order and without loss."""
    if not batch.num_rows:
        return
    _, at = as_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of the texts of a piece: byte spans, words per text and hashes of the lower-cased words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM):
        inside = kind[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = offsets[1:-1]
            before[edges[edges < len(inside)]] = False
            after[edges[edges > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.lengths = self.ends - self.starts
        self.first = np.searchsorted(self.starts, offsets)  # of each text's words
        self.counts = np.diff(self.first)
        self.bytes = LOWER[data[inside]]

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self) -> np.ndarray:
        """For each word the number of its text in the piece."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        at = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(self.bytes)) - np.repeat(at, self.lengths)
        values = BYTE_CODES[self.bytes]
        values *= powers(int(self.lengths.max()))[place]
        return mixed(np.add.reduceat(values, at) + self.lengths.astype(np.uint64))


POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant, at least n of them."""
    global POWERS
    if len(POWERS) < n:
        steps = np.full(max(n, 256), np.uint64(0xD6E8FEB86659FD93))
        steps[0] = 1
        POWERS = np.multiply.accumulate(steps)
    return POWERS


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


class Table:
    """Open addressing: the place of each 64-bit key in the array of keys, or -1."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        self.size = len(keys)
        self.bits = max(4, int(len(keys) * 1.4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot, the last is in
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & ((1 << self.bits) - 1)
        self.at_slot = np.where(self.slots >= 0, keys[self.slots] if len(keys) else np.uint64(0), np.uint64(0))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.at_slot[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.slots[at[left]]
            left = left[(found[left] >= 0) & (self.at_slot[at[left]] != keys[left])]
        return found


def tallied(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs, or the sums of its counts."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first)
