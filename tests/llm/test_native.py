"""Exact dedup, decontamination and mixing against brute force; nulls, ties, repeats, empty tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import same

from loomwright.llm import decontaminate, exact_dedup, mixing
from loomwright.llm.registry import QUERIES, SQL

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXT = st.one_of(st.none(), st.text(alphabet="ab \n\té.É0", max_size=12))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    same(QUERIES[name](spark, small), SQL[name], small)


def kept_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


@SLOW
@given(st.lists(TEXT, max_size=12), st.sampled_from([0, 100]))
def test_exact_dedup(docs, texts, broadcast_rows):
    rows = list(enumerate(texts))
    found = exact_dedup.exact_dedup(docs(rows, ["_len", "_n", "kept"]), broadcast_rows=broadcast_rows).collect()
    want = kept_by_hand(rows)
    assert len(found) == len(rows)
    for r in found:
        keep, size = want[re.sub(r"[\x20\x09-\x0d]", "", r.text or "")]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)
        assert r["_len"] == "mine _len"


def test_exact_dedup_repeated_rows_and_null_ids(docs):
    df = docs([(3, "a a"), (3, "a a"), (None, "aa"), (None, "b"), (5, None), (6, "")])
    found = exact_dedup.exact_dedup(df)
    assert sorted(r.group_size for r in found.collect()) == [1, 2, 2, 3, 3, 3]
    first = exact_dedup.first_of_repeats(found.filter("kept"), df.columns).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in first) == ["3", "5", "None"]


def by_hand(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(len(v), 10)
        for a in range(len(v) - n + 1 if n and i is not None else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


WORDS = st.lists(st.sampled_from(["a", "B", "c"]), max_size=26).map(" ".join)


@SLOW
@given(st.lists(WORDS, min_size=1, max_size=6), st.lists(WORDS, max_size=4), st.sampled_from([0, 100]))
def test_decontaminate(spark, docs, texts, items, broadcast_rows):
    rows, bench = list(enumerate([*texts, None, ""])), list(enumerate([*items, None]))
    found = decontaminate.decontaminate(
        docs(rows, ["_text", "items"]), spark.createDataFrame(bench, "item_id long, text string"), broadcast_rows=broadcast_rows
    )
    for r in found.collect():
        assert (r.n_words, r.n_hit, list(r["items"])) == by_hand(rows[r.doc_id][1], bench)
        assert r.contaminated == (r.n_hit > 0) and r["_text"] == "mine _text"


def test_decontaminate_shared_passage_and_clean_rows(spark, docs):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"start {i} {passage} end {i}") for i in range(40)] + [(100, "one two three four five six seven eight nine"), (101, passage.upper())]
    bench = spark.createDataFrame([(7, f"so {passage}"), (8, passage), (None, passage), (9, "")], "item_id long, text string")
    clean = decontaminate.clean_of(docs(rows), bench).select("doc_id").collect()
    assert [r.doc_id for r in clean] == [100]
    row = decontaminate.decontaminate(docs(rows), bench).filter("doc_id = 0").first()
    assert (row.n_words, row.n_hit, row["items"]) == (16, 12, ["7", "8"])


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0}, {"a": 0.9, "b": 0.07, "c": 0.03}, {f"s{i}": 1 / (i + 1) for i in range(30)}])
def test_pattern_is_less_than_a_block_from_its_target(weights):
    share = mixing.shares(weights, 200)
    n = sum(share.values())
    slots = mixing.pattern(share)
    assert sorted(x for v in slots.values() for x in v) == list(range(n))
    for s, v in slots.items():
        assert len(v) == share[s]
        for t in range(n + 1):
            assert abs(sum(x < t for x in v) - t * share[s] / n) < 1


def test_mix_keeps_every_row_and_the_weights(spark, docs):
    rows = [(i, "x", "hot" if i % 3 else ("rare" if i % 15 else None)) for i in range(3000)]
    found = mixing.mix(docs(rows, ["_rank", "_source"]), {"hot": 0.5, "rare": 0.3, "": 0.2}, block=10, period=20).collect()
    assert sorted(r.doc_id for r in found) == list(range(3000))
    assert len({r.mix_position for r in found}) == 3000
    slots = defaultdict(set)
    for r in found:
        slots[r.mix_slot].add((r.source, r.mix_block))
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    first = min(max(k for k, v in slots.items() if next(iter(v))[0] == s) for s in ("hot", "rare", None))
    for s, w in (("hot", 0.5), ("rare", 0.3), (None, 0.2)):
        for t in range(1, first + 2):
            assert abs(sum(next(iter(slots[k]))[0] == s for k in range(t)) - w * t) < 1


def test_a_long_phase_stays_less_than_a_block_from_weights_that_no_period_holds():
    blocks = {"hot": 6000, **{f"s{k:02}": 2000 for k in range(19)}, "tiny": 50}
    weights = {"hot": (1 / 3) ** 0.5, **{f"s{k:02}": (2 / 57) ** 0.5 for k in range(19)}, "tiny": 0.0005}
    plan, total = mixing.phases(blocks, weights), sum(weights.values())
    assert sorted(x for v in plan.values() for x in v) == list(range(sum(blocks.values())))
    end = min(v[-1] for v in plan.values()) + 1  # of the first phase
    assert end > 30_000
    for s, v in plan.items():
        assert len(v) == blocks[s]
        t = np.arange(end + 1)
        assert np.abs(np.searchsorted(v, t) - t * (weights[s] / total)).max() < 1 + 1e-9


def test_mix_follows_its_schedule_over_many_rows_of_it(docs, monkeypatch):
    rows = [(i, "x", "a" if i % 5 else "b") for i in range(2000)]
    plan = mixing.phases({"a": 400, "b": 100}, {"a": 1600**0.5, "b": 400**0.5})
    for bound in (mixing.BROADCAST_ROWS, 0):  # the schedule is broadcast, or shuffled
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", bound)
        found = mixing.mix(docs(rows), block=4, period=7).collect()
        assert len(found) == len({r.mix_position for r in found}) == 2000
        assert all(r.mix_slot == plan[r.source][r.mix_block] for r in found)


def test_empty_tables(spark, docs):
    none, bench = docs([]), spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert mixing.mix(none).count() == 0
    assert not decontaminate.decontaminate(docs([(1, "a b")]), bench).first().contaminated


def test_digest_is_of_the_normalised_text(spark, small):
    r = QUERIES["op8_exact_dedup"](spark, small).first()
    assert re.fullmatch("[0-9a-f]{64}", r.text_sha256) and r.text_sha256 != hashlib.sha256(b"").hexdigest()
