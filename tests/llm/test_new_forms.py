"""Fill-in-the-middle, filter audit and I-Match against brute force; nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from loomwright.llm import fill_in_middle as fim
from loomwright.llm import filter_audit, imatch
from loomwright.llm.registry import QUERIES, SQL

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXT = st.text(alphabet="ab \n\té.É0<PSM>日🙂", max_size=40)
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", "char": r"(?s)."}
ODD = [(1, None), (2, ""), (3, "\n"), (4, "x"), (4, "x"), (4, "y\n"), (None, "a\nb\n"), (7, "a <P> b"), (8, "<"), (9, "é\n日本\n🙂\r\n" * 3), (10, "word\n" * 40_000 + "end")]


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 500), st.sampled_from(sorted(UNITS)))
def test_fim_is_the_units_by_regular_expression(text, id, unit):
    n, form, before, inside, output = fim.transformed(text, id, unit)
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text and n == len(units)
    h = hashlib.sha256(f"7:{id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in fim.MARKS):
        assert (form, before, inside, output) == ("plain", None, None, text)
        return
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    assert (before, inside) == (len(p), len(m))
    assert output == (f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}")


@given(st.sets(st.integers(0, 300), min_size=1))
def test_ranked_selects_every_set_bit(places):
    bits = sum(1 << p for p in places)
    assert [fim.ranked(bits, bits.bit_length(), k) for k in range(len(places))] == sorted(places)


def test_fim_of_odd_texts_goes_back(docs):
    """Null, empty, one line, marks, half a mark, code points of all lengths, a long text; repeats; names of own columns."""
    df = docs(ODD, ["n", "form", "_own"])
    out = fim.fill_in_middle(df)
    assert out.columns[-5:] == fim.ADDED and "_own" in out.columns
    found = out.select("doc_id", "form", "n", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter((r.doc_id, r.back) for r in found) == Counter((i, t or "") for i, t in ODD)
    assert {r.form for r in found if r.doc_id in (1, 2, 7)} == {"plain"}
    assert all((r.n, r.form, r.output) == (lambda x: (x[0], x[1], x[4]))(fim.transformed(r.back, r.doc_id)) for r in found)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_fim_rate_and_marks(docs):
    rows = [(i, f"a{i}\nb\nc\n") for i in range(300)]
    forms = Counter(r.form for r in fim.fill_in_middle(docs(rows), rate=50, spm_rate=0, marks=("<pre>", "<suf>", "<mid>")).collect())
    assert 100 < forms["plain"] < 200 and "spm" not in forms
    with pytest.raises(ValueError, match="three different"):
        fim.fill_in_middle(docs(rows), marks=("<P>", "<P>", "<M>"))


def folder(spark, path, rows, labels):
    """Tables of documents and labels as the queries read them."""
    path.mkdir()
    for name, df in (
        ("documents", spark.createDataFrame(rows, "doc_id long, text string, source string")),
        ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
    ):
        pq.write_table(df.toArrow(), path / f"{name}.parquet")
    return str(path)


def test_fim_and_audit_of_odd_tables_are_their_sql(spark, tmp_path):
    rows = [(i, t, s) for (i, t), s in zip(ODD, itertools.cycle(["a", "b", None, ""]))]
    rows += [(20, "LOUD " * 300, "a"), (21, " ".join(f"w{i}" for i in range(300)), "a"), (22, "w " * 250 + "$", None), (23, "LOUD " * 300, "b")]
    path = folder(spark, tmp_path / "t", rows, [(1, 1, 0), (4, None, 1), (4, 1, 0), (20, 0, 1), (23, 1, None), (None, 1, 1), (99, 1, 1)])
    for name in ("op12_fill_in_middle", "op13_filter_audit"):
        same(QUERIES[name](spark, path), SQL[name], path)
    assert QUERIES["op13_filter_audit"](spark, path).select("part").distinct().count() == 3


def audit_by_hand(rows, letters):
    out = {}
    for part in {r[0] or "" for r in rows}:
        mine = [r for r in rows if (r[0] or "") == part]
        total = Counter()
        for order in itertools.permutations(letters):
            left = mine
            for step, f in enumerate(order, 1):
                fails = lambda r, f=f: bool(r[1 + letters.index(f)])
                gone, left = [r for r in left if fails(r)], [r for r in left if not fails(r)]
                total[f] += len(gone)
                only = sum(fails(r) and sum(map(bool, r[1 : 1 + len(letters)])) == 1 for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), sum(map(fails, mine)) - len(gone), only, sum(bool(r[-1]) for r in gone), f]
        for key, x in out.items():
            if key[0] == part:
                x[5] = total[x[5]] if isinstance(x[5], str) else x[5]
    return out


@SLOW
@given(st.lists(st.tuples(st.sampled_from([None, "", "p", "q"]), *[st.sampled_from([True, False, None])] * 4), max_size=40))
def test_audit_is_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "source string, X boolean, Y boolean, Z boolean, mark boolean").repartition(3)
    found = filter_audit.audit(df, ["X", "Y", "Z"], ["mark"]).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.mark_lost, r.shapley] for r in found}
    assert got == audit_by_hand(rows, ["X", "Y", "Z"]) and len(found) == len(got)


def test_bitmaps_of_many_parts_count_like_loops():
    random = np.random.default_rng(1)
    codes, fails, marks = random.integers(0, 40, 999), [random.random(999) < 0.4 for _ in range(3)], [random.random(999) < 0.2]
    got = filter_audit.packed(fails, marks, codes, 40)
    for part, s in itertools.product(range(40), range(8)):
        ok = (codes == part) & ~np.any([f for i, f in enumerate(fails) if s >> i & 1] or [np.zeros(999, bool)], axis=0)
        assert list(got[part, s]) == [ok.sum(), (ok & marks[0]).sum()]


def test_parts_are_handed_on_before_a_task_holds_too_many(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    df = spark.range(500).select((F.col("id") % 50).cast("string").alias("source"), (F.col("id") % 3 == 0).alias("A"), (F.col("id") % 2 == 0).alias("B"))
    with_small_batches = filter_audit.audit(df, ["A", "B"], [])
    assert with_small_batches.filter("step = 2").agg(F.sum("kept")).first()[0] == 2 * sum(i % 3 > 0 and i % 2 > 0 for i in range(500))


def test_audit_flags_with_clashing_names_hot_copies_and_no_broadcast(spark, docs):
    """A third of the rows are one text; copies are found beyond what is broadcast too; own columns don't matter."""
    rows = [(i, "copy of this") for i in range(0, 60, 2)] + [(None, "copy of this"), (70, "other"), (70, "other")]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for broadcast_rows in (0, 1000):
        found = filter_audit.flagged(docs(rows, ["_text", "E", "good"]), labels, broadcast_rows=broadcast_rows).collect()
        assert len(found) == len(rows) and sum(r.E for r in found) == 29 and sum(r.good for r in found) == 1
    with pytest.raises(ValueError, match="one letter"):
        filter_audit.audit(docs(rows), ["text"], [])


def word_hash(w):
    x = xxhash.xxh64_intdigest(w.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def chained(numbers):
    """What xxhash64 gives for an array of longs: each hash seeds the next."""
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64_intdigest((n & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed


def fingerprint_by_hand(text, cells):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    every = {word_hash(w) for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)}
    terms = sorted({h for h in every if h & (1 << 20) - 1 in cells} or every or {word_hash(text)})
    level = len(terms).bit_length() - 1
    out = [f"{chained(terms):016x}", f"{level:02d}"]
    for k in range(level, level + 3):
        sets = [[g for h in terms if (g := (h & (1 << 64) - 1) >> 20) & (1 << k) - 1 == j] for j in range(min(1 << k, 32))]
        out.append("".join(f"{chained(s) & 0xFFFF:04x}" if s else "...." for s in sets))
    return ":".join(out)


def likeness_by_hand(a, b):
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    p, q = int(x[1]), int(y[1])
    s = "".join(x[2 + k - p] for k in range(max(p, q), min(p, q) + 3))
    t = "".join(y[2 + k - q] for k in range(max(p, q), min(p, q) + 3))
    pairs = [(s[i : i + 4], t[i : i + 4]) for i in range(0, len(s), 4)]
    some = [x for x in pairs if x != ("....", "....")]
    return sum(u == v for u, v in some) / len(some) if some else 0.0


def cells_by_hand(texts):
    df = Counter()
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        df.update({word_hash(w) & (1 << 20) - 1 for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)})
    n = len(texts)
    return {c for c, k in df.items() if k * 10 <= n <= k * 1000}


def test_imatch_of_odd_tables_is_brute_force(spark, tmp_path, monkeypatch):
    """Ids out of order, negative and null, ids and rows that repeat, texts without words; buckets of two documents."""
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 2)
    random = np.random.default_rng(2)
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(int(i), " ".join(f"w{j}" for j in random.integers(0, 400, 1 + k))) for k, i in enumerate(random.permutation(40) * 7 - 50)]
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "日本 É"), (1004, long), (None, "no id"), (None, "no id"), (1002, "same id"), (1004, long), (1004, long)]
    path = folder(spark, tmp_path / "t", [(i, t, "s") for i, t in rows], [(1, 1, 1)])
    texts = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), t or "") for i, t in rows})
    cells = cells_by_hand([t for _, t in rows])
    want = Counter()
    for k, (none, i, _, t) in enumerate(texts):
        follower = texts[(k + 1) % len(texts)][3]
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        f, e, g = (fingerprint_by_hand(x, cells) for x in (t, edited, follower))
        copies = sum((j is None, j or 0, u or "") == (none, i, t) for j, u in rows)
        want[(None if none else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, likeness_by_hand(f, e), likeness_by_hand(f, g))] += copies
    found = QUERIES["op11_imatch"](spark, path)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(map(tuple, found.collect())) == want


def test_imatch_of_one_document_and_of_none(spark, docs):
    one = docs([(5, "alone here")], ["_bits", "fingerprint"])
    lex = imatch.lexicon(one)
    marked = imatch.fingerprinted(one, lex)
    assert marked.first()["_bits"] == "mine _bits" and marked.columns[-1] == "fingerprint"
    assert imatch.with_next(marked, carry=("fingerprint",)).select("next_text").first()[0] == "alone here"
    none = one.limit(0)
    assert imatch.with_next(imatch.fingerprinted(none, imatch.lexicon(none)), carry=("fingerprint",)).count() == 0


def test_imatch_tells_edited_texts_from_others(spark):
    found = QUERIES["op11_imatch"](spark, "/root/testdata/sf0.01").select("near_edited", "near_next").toPandas()
    assert (found.near_edited > found.near_next).mean() > 0.93 and found.near_next.mean() < 0.02


def test_vocabulary_files_stay_out_of_the_repository():
    assert not [p for p in Path(__file__).parents[2].rglob("*.model")]
