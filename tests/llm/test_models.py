"""Token counts, language, quality, toxicity, PPM scores, html text and the n-gram join."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import html_text, language_id, ngram_join, ppm, quality, token_count, toxicity
from loomwright.llm.registry import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path(token_count.MODEL)
ODD = ["", None, " ", "   a  b ", "\n\n", "x" * 5000, "ab" * 2000, "▁▁a ▁", "<s> </s>", "\x00\x01", "日本語 テスト 🙂🙂", "É ﬁ Ａ", "a\tb\nc", "=" * 700 + " " * 300]


def test_tokens_are_the_library_s(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = token_count.token_counts(docs(list(enumerate(ODD)), ["_text", "n_tokens"]), MODEL, limit=100).collect()
    assert len(found) == len(ODD)
    for r in found:
        t = ODD[r.doc_id] or ""
        n = len(library.encode(t))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 100)


def test_tokens_of_documents(spark, small):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op4_token_counts"](spark, small).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id]))


def test_language(spark, small, docs):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in QUERIES["op5_language_id"](spark, small).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    names, vectors = language_id.prototypes(["the cat and the dog", "der Hund und die Katze"] * 3, ["en", "de"] * 3)
    rows = {r.doc_id: r for r in language_id.identify(docs([(0, None), (1, "12 .!"), (2, "the dog"), (3, "die Katze"), (4, "")]), names, vectors).collect()}
    assert [rows[i].lang_pred for i in range(5)] == ["und", "und", "en", "de", "und"]
    assert language_id.identify(docs([(0, "a")]), [], np.zeros((0, language_id.SIZE), np.float32)).first().lang_pred == "und"


def test_prototypes_are_learned_in_the_workers_and_rare_languages_are_among_them(spark, docs):
    rows = [(i, f"the cat and the dog number {i}") for i in range(60)] + [(100, "der Hund und die Katze"), (101, "ein Hund")]
    labels = spark.createDataFrame([(i, "en" if i < 100 else "de") for i, _ in rows], "doc_id long, label string")
    names, vectors = language_id.learn(docs(rows), labels, 1000)
    want = language_id.prototypes([t for _, t in rows], ["en"] * 60 + ["de"] * 2)
    assert names == want[0] == ["de", "en"] and np.allclose(vectors, want[1], atol=1e-5)
    assert language_id.learn(docs(rows), labels, 8)[0] == ["de", "en"]
    assert language_id.learn(docs(rows), labels.limit(0), 8)[0] == []


def test_labelled_rows_are_bounded_and_of_every_label(spark, docs):
    from loomwright.llm.common import labelled

    rows = [(i, f"t{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 1 if i < 6 else 0) for i, _ in rows] + [(7, None), (None, 1)], "doc_id long, label int")
    found = [r.label for r in labelled(docs(rows), labels, 40, every_label=True).collect()]
    assert found.count(1) >= 6 and 40 <= len(found) <= 60
    assert len(labelled(docs(rows), labels, 40).collect()) == 40


def test_binding_is_order_dependent_and_long_texts_match():
    (v, n) = language_id.bundles(["abc", "cba", "abc abc", "", "x" * 100_000])
    unit = v[:3] / np.linalg.norm(v[:3], axis=1, keepdims=True)
    assert unit[0] @ unit[1] < 0.6 < unit[0] @ unit[2] and list(n) == [3, 3, 6, 0, 100_000]


def test_quality_ranks_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in QUERIES["op9_quality"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_quality_without_labels_and_odd_texts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.learn(docs(list(enumerate(ODD))), none)
    assert {r.predicted for r in quality.score_quality(docs(list(enumerate(ODD)), ["_text", "score"]), model).collect()} == {1}
    x = quality.features(pa.array(ODD, pa.string()))
    assert np.isfinite(x).all() and (x[0] == 0).all()
    a = quality.features(pa.array(["b a b a. A\nb a", "q"], pa.string()))[0]
    assert a[8] == pytest.approx(3 / 7) and a[11] == 0  # distinct words after lower-casing: b, a, "a."


def test_quality_learns_from_every_labelled_document(spark, docs):
    """All of 22,000 labelled documents are in each count, and the order of rows changes nothing."""
    rows = [(i, f"some plain words {'that are good' if i % 2 else '!! !! ##'} number {i % 97}") for i in range(22_000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, label int")
    seen, real = [], quality.counted
    quality.counted = lambda r, *a: seen.append((r.count(), r.rdd.getNumPartitions())) or real(r, *a)
    try:
        model = quality.learn(docs(rows), labels)
    finally:
        quality.counted = real
    assert set(seen) == {(22_000, 1)}
    got = quality.score_quality(docs(rows), model).filter("predicted = doc_id % 2").count()
    assert got >= 21_900
    assert quality.learn(docs(rows).repartition(7), labels).weights.tolist() == model.weights.tolist()


def test_quality_steps_are_those_of_all_pairs(spark):
    """The gradient by cells is the sum over all pairs; the threshold parts as many rows as are good."""
    random = np.random.default_rng(3)
    x, up = random.random((90, len(quality.NAMES))), random.random(90) < 0.3
    x[up, 0] += 0.4
    rows = spark.createDataFrame([(r.tolist(), int(u)) for r, u in zip(x, up, strict=True)], "features array<double>, label int")
    model = quality.rank(rows)
    b, w = model.binned(x), np.zeros(len(model.weights))
    pairs = (b[up][:, None] - b[~up][None]).reshape(-1, len(w))
    curve = pairs.T @ pairs / len(pairs) / 4 + quality.DECAY * np.eye(len(w))
    for _ in range(quality.STEPS):
        w = w + np.linalg.solve(curve, pairs.T @ (1 / (1 + np.exp(pairs @ w))) / len(pairs) - quality.DECAY * w)
    assert np.corrcoef(b @ w, model.raw(x))[0, 1] > 0.999 and abs((model.score(x) >= 0.5).sum() - up.sum()) <= 1
    assert np.allclose(model.edges, [np.quantile(c, np.arange(1, 9) / 9, method="inverted_cdf") for c in x.T], rtol=2 / 1024)


def test_toxicity_learns_words_and_stems(spark, docs):
    random = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        w = list(random.choice(words, 20))
        if i % 4 == 0:
            w.insert(int(random.integers(0, 20)), random.choice(["nasty", "grumbleth", "grumblers", "grumbly"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    frame = docs(rows)
    field = toxicity.learn(frame.filter("doc_id < 240"), spark.createDataFrame(labels, "doc_id long, label int").filter("doc_id < 240"))
    found = toxicity.score_toxicity(docs([*rows, (900, None), (901, ""), (902, "ü grumblest")], ["_text"]), field).collect()
    got = {r.doc_id: r for r in found}
    assert sum(got[i].predicted == y for i, y in labels[240:]) >= 58
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    assert [(s.start, s.end) for s in got[902].spans] == [(2, 11)]


def test_forward_backward_is_brute_force():
    import itertools

    from loomwright.llm.arrays import Words, as_bytes

    field = toxicity.Field(np.array([1], np.uint64), np.zeros(3), -1.0, np.array([[0.0, -1.5], [-0.3, 0.8]]), np.zeros(3))
    words = Words(*as_bytes(pa.array(["a b c d e", "x", "p q r"])))
    at, score = np.array([1, 4, 7, 8]), np.array([2.0, -0.5, 1.0, 0.3])
    got = field.marginals(words, at, score)
    emission = dict(zip(at, score, strict=True))
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        total, inside = 0.0, Counter()
        for states in itertools.product((0, 1), repeat=b - a):
            s, last = 0.0, 0
            for w, y in zip(range(a, b), states, strict=True):
                s += field.moves[last, y] + y * emission.get(w, field.bias)
                last = y
            total += math.exp(s)
            for w, y in zip(range(a, b), states, strict=True):
                inside[w] += y * math.exp(s)
        for k, w in enumerate(at):
            if a <= w < b:
                assert got[k] == pytest.approx(inside[w] / total)


def test_gradient_is_that_of_the_likelihood_and_both_are_brute_force():
    import itertools

    random = np.random.default_rng(1)
    chains = [([[0], [], [1, 2], [2]], [1, 0, 0, 1], 3), ([[], [1]], [0, 1], 1), ([[0, 1, 2]], [0], 2)]
    g, theta = toxicity.gold(chains, 3), random.normal(size=7)
    value, slope = toxicity.likelihood(theta, g)
    move, want = np.append(0.0, theta[4:]).reshape(2, 2), 0.0
    for chain, states, times in chains:
        score = lambda y, chain=chain: sum(move[a, b] + b * (theta[3] + sum(theta[f] for f in found)) for a, b, found in zip((0, *y), y, chain))  # noqa: E731, B905
        want += times * (score(states) - math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=len(chain)))))
    assert value == pytest.approx(want)
    for k in range(7):
        step = np.eye(7)[k] * 1e-5
        assert slope[k] == pytest.approx((toxicity.likelihood(theta + step, g)[0] - toxicity.likelihood(theta - step, g)[0]) / 2e-5, abs=1e-5)


def test_powers_of_the_matrix_of_unknown_words():
    field = toxicity.Field(np.array([1], np.uint64), np.zeros(3), -2.0, np.array([[0.0, -4.0], [-3.0, 1.5]]), np.zeros(3))
    step = field.move * np.array([1.0, np.exp(field.bias)])
    for n in (0, 1, 5, 96, 400):
        want, got = np.linalg.matrix_power(step, n), field.gaps(np.array([n]))[0]
        assert got / got.sum() == pytest.approx(want / want.sum())


def test_the_word_beside_a_known_one_counts():
    from loomwright.llm.arrays import Words, as_bytes

    data, at = as_bytes(pa.array(["bad bad x bad", "bad"]))
    words = Words(data, at)
    field = toxicity.Field(words.hashes()[:1], np.array([1.0, 0.25, 0.5]), -1.0, np.zeros((2, 2)), np.zeros(3))
    known, score = field.known(words, data)
    assert known.tolist() == [0, 1, 3, 4] and score.tolist() == [0.5, 0.25, 0.0, 0.0]
    found = toxicity.chains(words.hashes()[:1], pa.array(["bad bad x bad"]), np.array([True]))
    assert found == [([[], [], [], [0, 2], [0, 1], [], [0]], [0, 0, 0, 1, 1, 0, 1])]


def test_toxicity_without_labels(spark, docs):
    field = toxicity.learn(docs([(1, "a")]), spark.createDataFrame([], "doc_id long, label int"))
    assert {r.predicted for r in toxicity.score_toxicity(docs(list(enumerate(ODD))), field).collect()} <= {0, 1}


def ppm_by_hand(train, text, order=ppm.ORDER):
    """log10 probability of a text, counting contexts in dictionaries."""
    tokens = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()).split()
    flat = lambda t: b"".join(w + b" " for w in tokens(t)) + b"\0"
    seen: dict[bytes, Counter] = {}
    for t in train:
        x = b"\0" * order + flat(t)
        for i in range(order, len(x)):
            for k in range(order + 1):
                seen.setdefault(x[i - k : i], Counter())[x[i]] += 1
    x, out = b"\0" * order + flat(text), 0.0
    for i in range(order, len(x)):
        skip: set[int] = set()
        for k in range(order, -1, -1):
            context = seen.get(x[i - k : i])
            if context is None:
                continue
            left = {b: n for b, n in context.items() if b not in skip}
            total = sum(left.values()) + len(left)
            if x[i] in left:
                out += math.log10(left[x[i]] / total)
                break
            if left:
                out += math.log10(len(left) / total)
            skip |= set(context)
        else:
            out -= math.log10(256 - len(skip))
    return out


@pytest.mark.parametrize("held", [1 << 20, 2])
def test_ppm_is_brute_force(spark, docs, monkeypatch, held):
    monkeypatch.setattr(ppm, "HELD", held)
    train = ["The cat sat on the mat.", "the cat ate the rat", "", None, "a b a b a c", "x" * 300]
    test = ["the hat", "The\tCAT  sat", "", None, "zz é", "b a c a", "y" * 1000]
    model, others = ppm.learn(docs(list(enumerate(train))))
    assert (others.count() > 0) == (held == 2)
    rows = ppm.score(docs([*enumerate(test), (7, test[0])], ["_row", "_text", "score"]), model, others).collect()
    words = [w for t in train for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()]
    count, total = Counter([*words, *["END"] * len(train)]), len(words) + len(train)
    assert len(rows) == 8
    for r in rows:
        t = [*test, test[0]][r.doc_id] or ""
        tokens = [*re.sub("[A-Z]", lambda m: m[0].lower(), t).split(), "END"]
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(ppm_by_hand([t or "" for t in train], t), abs=1e-3)


@pytest.mark.parametrize(("nodes", "held"), [(0, 1 << 20), (7, 2), (40, 1 << 20)])
def test_ppm_of_a_trie_beyond_the_workers_is_brute_force(spark, docs, monkeypatch, nodes, held):
    monkeypatch.setattr(ppm, "NODES", nodes)
    monkeypatch.setattr(ppm, "HELD", held)
    train = ["The cat sat on the mat.", "the cat ate the rat", "", None, "a b a b a c", "x" * 300]
    test = ["the hat", "The\tCAT  sat", "", None, "zz é", "b a c a", "y" * 1000, train[0]]
    model, others = ppm.learn(docs(list(enumerate(train))))
    assert model.trie is None and model.grams.count() > nodes
    rows = ppm.score(docs(list(enumerate(test)), ["_row", "_kind", "score"]), model, others).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(test)))
    for r in rows:
        assert r.score == pytest.approx(ppm_by_hand([t or "" for t in train], test[r.doc_id] or ""), abs=1e-3)


def test_ppm_without_training_text(spark, docs):
    model, others = ppm.learn(docs([]))
    r = ppm.score(docs([(1, "ab c")]), model, others).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
    assert r.score == pytest.approx(-6 * math.log10(256), abs=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, do you accept all of them?</div><!-- <p>hidden</p> -->
<article><h1>A  headline &amp; more</h1><p><b>First &eacute;&#233;&nbsp;x<br>line two<p>Second paragraph with <a href=c>one link</a> in it.
<ul><li>An item</li></ul><aside>See also this other thing</aside><div class="comments"><p>What a great article, thank you so much for it!</p></div></article>
<div id="sidebar"><p>Popular posts that you may want to read next on our site today</p></div><form><p>Subscribe to our letter now please</p><button>Go</button></form>
<footer>&copy; 2020 us</footer>"""


def test_html(spark, small):
    assert html_text.main_text(PAGE) == "A headline & more\nFirst éé x line two\nSecond paragraph with one link in it.\nAn item"
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "<!-- ", "&amp")] == [""] * 6
    plain = "<div>" + "<p>" + "word " * 30 + "</p>" + "<p>" + "more " * 25 + "</p></div>"
    assert html_text.main_text(plain) == ("word " * 30).strip() + "\n" + ("more " * 25).strip()
    for r in QUERIES["op3_html_text"](spark, small).collect():
        assert r.n_chars == len(r.text) > 0


@pytest.mark.parametrize(
    "open_", ['<div style="overflow:hidden">', '<div class="overflow-hidden">', '<div title="a hidden gem" data-id="sidebar">', '<body class="single has-sidebar">',
              '<body class="right-sidebar">', '<div class="page right-sidebar">', '<div class="no-sidebar">', '<div class="nav-wrap menu"><main>',
              '<div class="menu"><div role="main">']
)
def test_a_wrapper_is_no_boilerplate(open_):
    page = f'{open_}<article><header class="entry-header"><h1>The headline</h1></header><p>Text of the article, some words.</p></article>'
    assert html_text.main_text(page) == "The headline\nText of the article, some words."


@pytest.mark.parametrize(
    "open_", ["<div hidden>", '<div style="color:red; display : none">', "<div style='visibility:hidden'>", "<div aria-hidden=true>", '<div class="box hidden">',
              '<div class="comments"><article>', '<div id="sidebar"><article>', '<div class="right-sidebar"><div class="widget"><article>', "<div hidden><main>",
              '<div class="footer"><div class="main">']
)
def test_what_is_hidden_or_beside_the_article_goes(open_):
    page = f"<article><p>Text of the article, some words.</p></article>{open_}<p>" + "More words that nobody asked for. " * 9
    assert html_text.main_text(page) == "Text of the article, some words."


def test_a_head_without_an_end_tag_keeps_the_page():
    page = "<html><head><meta charset=utf-8><title>T</title><style>p {}</style><body><article><p>Text of the article."
    assert html_text.main_text(page) == "Text of the article."
    assert html_text.main_text(page.replace("<body>", "</head><body>")) == "Text of the article."


def test_the_tree_learns_its_table():
    x, y = html_text.labelled_blocks()
    tree = html_text.trained()
    assert np.mean([tree.says(list(r)) == bool(k) for r, k in zip(x, y, strict=True)]) > 0.98


def links_by_hand(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
    n, label = len(sets), list(range(len(sets)))
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            links[i, j] = i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    while True:
        fresh = [min([label[i], *[label[j] for j in range(n) if links[i, j]]]) for i in range(n)]
        if fresh == label:
            return label, links.sum(axis=1)
        label = fresh


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_ngram_join_is_brute_force(docs, monkeypatch, broadcast_rows):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)  # canopies in several blocks
    random = np.random.default_rng(3)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(14 if g else 25):
            w = list(base)
            for _ in range(random.integers(0, 4)):
                w[random.integers(0, 60)] = f"x{random.integers(0, 8)}"
            texts.append(" ".join(w))
    texts += ["short", "Short.", "other text", "", None, "!?", texts[0].upper(), texts[0]]
    texts += [" ".join(f"u{k}v{i}" for i in range(30)) for k in range(5)]
    found = {r.doc_id: r for r in ngram_join.near_duplicates(docs(list(enumerate(texts))), broadcast_rows=broadcast_rows).collect()}
    label, degree = links_by_hand(texts)
    assert [found[i].class_id for i in range(len(texts))] == label
    assert [found[i].n_links for i in range(len(texts))] == list(degree)


def family(m, seed=5):
    """Texts whose similarity with one another is below the threshold, but for those changed at places near each other."""
    base, random, out = [f"w{i}" for i in range(80)], np.random.default_rng(seed), []
    for k in range(m):
        w = list(base)
        w[int(random.integers(5, 75))] = f"x{k}"
        out.append(" ".join(w))
    return out


def test_a_family_below_the_threshold_is_compared_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "CROWD", 16)
    seen, plain = [], ngram_join._compared
    monkeypatch.setattr(ngram_join, "_compared", lambda pairs, grams: seen.append(pairs.count()) or plain(pairs, grams))
    made = []
    for m in (60, 120):
        seen.clear()
        texts = family(m)
        found = {r.doc_id: r for r in ngram_join.near_duplicates(docs(list(enumerate(texts)))).collect()}
        label, degree = links_by_hand(texts)
        assert 0 < sum(degree) < m * m / 4
        assert [(found[i].class_id, found[i].n_links) for i in range(m)] == list(zip(label, degree, strict=True))
        made.append(sum(seen))
    assert made[1] < 3 * made[0] < 3 * 60 * 16, made  # far fewer than the pairs: 1,770 and 7,140


def test_one_of_each_class_stays(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text + " tail"), (3, text + " tail"), (9, "alone here"), (None, "alone too"), (None, text), (7, None), (8, "")]
    rows += [(-1, "a text of seven words in all"), (-1, "a text of seven words in all"), (None, "a text of seven words in all")]
    kept = ngram_join.one_of_each(docs(rows, ["_text", "_id", "class_id"])).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["-1", "3", "7", "8", "9", "None"]
    assert ngram_join.one_of_each(docs([])).count() == 0


def test_bands_reach_the_recall():
    b = ngram_join.band_count()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** b >= ngram_join.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges], "a binary, b binary")
    labels = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in ngram_join.components(df).collect()}
    assert labels == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_every_query_has_one_row_for_each_document(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op1_ngram_join", "op2_mix_sources", "op6_ppm_scores", "op7_toxicity"):
        assert QUERIES[name](spark, small).agg(F.count(F.lit(1))).first()[0] == n


def test_chains_that_stay_where_they_are_give_the_same_field(spark, docs, monkeypatch):
    rows = [(i, f"a b {'nasty stuff ' if i % 2 else 'nice '}c d{i % 7} {'vile' if i % 6 == 1 else 'fine'} e") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    monkeypatch.setattr(toxicity, "STEPS", 12)
    here = toxicity.learn(docs(rows).select("doc_id", "text"), labels)
    monkeypatch.setattr(toxicity, "CHAINS", 1)
    monkeypatch.setattr(toxicity, "PARTS", 3)
    there = toxicity.learn(docs(rows).select("doc_id", "text"), labels)
    assert len(here.keys) and np.array_equal(here.keys, there.keys)
    assert np.allclose(here.weights, there.weights) and np.allclose(here.moves, there.moves)


def test_ppm_counts_a_piece_of_text_in_little_memory():
    """The arrays of the largest piece that is worked on at once; two workers share an executor with the model."""
    import tracemalloc

    text = " ".join(f"{i * 7919 % 99991:x}" for i in range(200_000)).encode()[: ppm.PART]
    words = ppm.Words(*ppm.as_bytes(pa.array([text.decode()])), ppm.SOLID)
    tracemalloc.start()
    keys, _ = ppm.tallied(ppm.codes(*ppm.stream(words))[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) > 1000 and peak + ppm.GATHERED * 16 < 24_000_000, peak
