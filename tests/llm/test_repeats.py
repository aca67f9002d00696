"""Repeated ids, hot keys and small or odd inputs of operators and pipeline stages."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomwright.llm import common, decontaminate, exact_dedup, language_id, mixing, ppm, quality, token_count, toxicity


def op8_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i or 0))
    return {k: (min(v), len(v)) for k, v in groups.items()}


REPEATS = [(1, "a b c"), (1, "abc"), (1, "ab c"), (1, "a bc"), (1, "a bc"), (2, "abc"), (None, "x"), (None, "x"), (None, " x"), (5, None), (5, ""), (7, "alone")]


def test_exactly_one_row_of_a_group_is_kept(spark, docs, tmp_path, monkeypatch):
    """Equal texts under one id: the longest stays, and of equal ones a single row."""
    monkeypatch.setattr(exact_dedup, "read", lambda *_: docs(REPEATS).repartition(4))
    found = exact_dedup.op8_exact_dedup(spark, "")
    want = op8_by_hand(REPEATS)
    got = found.collect()
    assert len(got) == len(REPEATS) and sum(r.kept for r in got) == len(want)
    assert Counter((r.keep_id, r.group_size) for r in got if r.kept) == Counter((None if none else i, n) for (_, none, i), n in want.values())
    whole = exact_dedup.exact_dedup(docs(REPEATS).repartition(4))
    kept = exact_dedup.first_of_repeats(whole.filter("kept"), ["doc_id", "text"]).collect()
    assert len(kept) == len(want) and (1, "a b c") in [tuple(r) for r in kept] and (None, " x") in [tuple(r) for r in kept]


def test_a_text_is_learned_with_the_language_of_its_own_row(spark, monkeypatch):
    """Two languages under every id."""
    rows = [(i, "hello there the and of " * 3, "en") for i in range(40)] + [(i, "bonjour monde le et de la " * 3, "fr") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    monkeypatch.setattr(language_id, "read", lambda *_: df)
    found = language_id.op5_language_id(spark, "").join(df.select(F.col("doc_id").alias("d"), "lang").distinct(), F.col("doc_id") == F.col("d"))
    texts = {r.lang_pred for r in found.collect()}
    assert texts == {"en", "fr"}
    names, vectors = language_id.prototypes([rows[0][1], rows[50][1]], ["en", "fr"])
    again = language_id.learn(*[df.withColumn("doc_id", F.xxhash64("doc_id", "lang")).select("doc_id", c) for c in ("text", F.col("lang").alias("label"))])
    assert again[0] == names and abs(again[1] - vectors).max() < 1e-6


def test_the_same_rows_are_learned_from_on_every_run(spark, docs):
    rows = [(i % 30, f"text {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, label int")
    runs = [common.labelled(docs(rows).repartition(n).select("doc_id", "text"), labels, 20).orderBy("doc_id").collect() for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 20


def test_attach_deals_a_hot_key_and_joins_the_rest_by_a_shuffle(spark, monkeypatch):
    """AQE off, a third of the rows with one key, a tenth without: the largest part is a few times the mean."""
    monkeypatch.setattr(common, "HOT_PARTS", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 != 1, F.col("id") % 700)
        rows = spark.range(6000).select(key.alias("k"), "id")
        table = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        found = common.attach(rows, table, ["k"], "v", 6000, 500, F.col("id"), "t", broadcast_rows=0)
        got = {r.id: r.t.v if r.t else None for r in found.collect()}
        assert got == {i: None if k is None or k >= 500 else 2 * k for i in range(6000) for k in [0 if i % 3 == 0 else i % 700 if i % 10 != 1 else None]}
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 3 * 6000 / 16
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mix_cuts_buckets_of_rows_without_an_id_or_with_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 64)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.col("id").alias("row"))
    found = mixing.mix(rows)
    assert found.agg(F.count_distinct("mix_position")).first()[0] == 3000 and found.select("row").distinct().count() == 3000
    assert found.columns == ["doc_id", "source", "row", "mix_block", "mix_slot", "mix_position"]


def test_windows_and_fingerprints_that_most_texts_share(spark, docs, monkeypatch):
    """No broadcast, few keys count as hot: a passage in most texts and in many items."""
    monkeypatch.setattr(common, "HOT_PARTS", 6)
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(i, f"{passage} own{i}" if i % 3 else f"only{i} words here") for i in range(30)]
    bench = spark.createDataFrame([(j, f"{passage} tail{j}") for j in range(12)] + [(99, "only6 words here")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(docs(rows), bench, broadcast_rows=0).collect()}
    assert all(found[i].n_hit == (14 if i % 3 else 3 if i == 6 else 0) and len(found[i]["items"]) == (12 if i % 3 else int(i == 6)) for i in range(30))


ODD = [(1, None), (1, None), (2, ""), (None, "A text without an id."), (3, "x"), (4, "word " * 30_000), (5, "same text here"), (5, "same text here"), (6, "ßÉ日🙂 ﬁ")]


def ppm_input(df):
    model, grams = ppm.learn(df)
    model, others = ppm.with_values(df, model) if grams is None else (model, grams)
    return df, model, others


@pytest.mark.parametrize("empty", [False, True])
def test_learners_and_counters_of_odd_and_of_empty_tables(spark, docs, empty):
    df = docs(ODD, ["score", "_text"])
    df = df.limit(0) if empty else df
    labels = spark.createDataFrame([(4, 1), (6, 0), (3, None)], "doc_id long, label int")
    n = 0 if empty else len(ODD)
    names, vectors = language_id.learn(df.select("doc_id", "text"), labels.select("doc_id", F.col("label").cast("string").alias("label")))
    assert language_id.identify(df, names, vectors).count() == n
    assert quality.score_quality(df, quality.learn(df.select("doc_id", "text"), labels)).filter("score between 0 and 1").count() == n
    assert toxicity.score_toxicity(df, toxicity.learn(df.select("doc_id", "text"), labels)).filter("score between 0 and 1").count() == n
    import public_tokenizers

    counted = token_count.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(counted) == n and all(r.n_tokens == 0 for r in counted if r.doc_id in (1, 2))
    assert ppm.score(*ppm_input(df)).count() == n


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_and_of_empty_tables(spark, docs, name, tmp_path):
    """Null ids and texts, repeated rows and ids: whole rows, none added; an empty table stays empty."""
    stage = dict(corpus_pipeline.STAGES)[name]
    folder = "/root/testdata/sf0.001"
    df = docs(ODD)
    out = stage(spark, df, folder)
    rows = [tuple(r)[:5] for r in out.collect()]
    assert not Counter(rows) - Counter(map(tuple, df.collect()))
    if name == "exact_dedup":  # null and empty texts are one
        assert Counter(r[0] for r in rows) == Counter([1, None, 3, 4, 5, 6])
    if name == "near_dedup":
        assert Counter(r[0] for r in rows) == Counter([1, 1, 2, None, 3, 4, 5, 6])
    if name in ("decontaminate", "mix"):
        assert len(rows) == len(ODD)
    assert stage(spark, df.limit(0), folder).count() == 0


FIXED = {
    "op4_token_counts": ("doc_id, n_bytes", "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents"),
    "op5_language_id": ("doc_id, lang_pred = 'und' AS und", "SELECT doc_id, text IS NULL OR NOT regexp_matches(text, '\\p{L}') AS und FROM documents"),
    "op6_ppm_scores": (
        "doc_id, n_tokens",
        r"SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) + 1 AS BIGINT) AS n_tokens FROM documents",
    ),
}


@pytest.mark.parametrize("name", sorted(FIXED))
def test_columns_that_no_model_decides_are_their_sql(spark, small, name):
    from oracle import same

    from loomwright.llm.registry import QUERIES

    columns, sql = FIXED[name]
    same(QUERIES[name](spark, small).selectExpr(*[c.strip() for c in columns.split(",")]), sql, small)


def test_base_scores_are_the_formula(spark, small):
    """n_known, train_tokens and base_score from counts of words, in loops."""
    import math
    import re
    import zlib

    from loomwright.llm.registry import QUERIES

    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0d]+", low(t)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in QUERIES["op6_ppm_scores"](spark, small).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


@pytest.mark.parametrize(("name", "of", "rest"), [("op5_language_id", 5, 0), ("op7_toxicity", 5, 0), ("op9_quality", 3, 1)])
def test_folds_are_those_of_the_ids(spark, small, name, of, rest):
    import zlib

    from loomwright.llm.registry import QUERIES

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == rest) for r in QUERIES[name](spark, small).select("doc_id", "held_out").collect())
