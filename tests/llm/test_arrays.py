"""Texts as arrays, against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import arrays

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é中.\n\t_\x00", max_size=15)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_words_of_pieces(texts, most):
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    seen, hashes = [], {}
    for piece in arrays.pieces(batch, most=most):
        for kind, pattern in ((arrays.ALNUM, r"[0-9a-zA-Z\x80-\U0010ffff]+"), (arrays.SOLID, r"[^\x20\x09-\x0d]+")):
            data, at = arrays.as_bytes(piece.column("text"))
            words = arrays.Words(data, at, kind)
            raw = data.tobytes()
            got = [raw[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)]
            want = [re.findall(pattern, t or "") for t in piece.column("text").to_pylist()]
            assert got == [w for ws in want for w in ws] and list(words.counts) == [len(ws) for ws in want]
            for w, h in zip(got, words.hashes().tolist(), strict=True):
                low = re.sub("[A-Z]", lambda m: m[0].lower(), w)
                assert hashes.setdefault(low, h) == h
        seen += piece.column("text").to_pylist()
    assert seen == texts and len(set(hashes.values())) == len(hashes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=50), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_table(keys, others):
    table = arrays.Table(np.array(keys, np.uint64))
    asked = np.array([*keys, *others], np.uint64)
    place = {k: i for i, k in enumerate(keys)}
    assert table.find(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), max_size=30))
def test_tallied(pairs):
    keys, counts = np.array([k for k, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)
    assert dict(zip(*map(list, arrays.tallied(keys)), strict=True)) == Counter(keys.tolist())
    want = Counter()
    for k, n in pairs:
        want[k] += n
    assert dict(zip(*map(list, arrays.tallied(keys, counts)), strict=True)) == want


def test_slices_of_columns():
    whole = pa.array(["aa", None, "b c", "", "d"])
    data, at = arrays.as_bytes(whole[2:])
    assert data.tobytes() == b"b cd" and at.tolist() == [0, 3, 3, 4]
