"""The pipeline against cases planted in its input, stage by stage."""

import random
import re
import shutil

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomwright.llm import decontaminate, quality
from loomwright.llm.registry import QUERIES


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The small tables, with documents added whose fate is known."""
    folder = tmp_path_factory.mktemp("planted")
    source = "/root/testdata/sf0.01"
    for name in ("labels", "benchmark"):
        shutil.copy(f"{source}/{name}.parquet", folder / f"{name}.parquet")
    docs = spark.read.parquet(f"{source}/documents.parquet").cache()
    clean = docs.join(spark.read.parquet(f"{source}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id")
    text = clean.filter("n_chars between 1500 and 2500").orderBy("doc_id").first().text
    words = text.split(" ")
    passage = spark.read.parquet(f"{source}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    other = " ".join(random.Random(5).sample(words, len(words)))  # new, but like the other texts
    added = [
        (900_001, other, "clean"),
        (900_002, other.replace(" ", "\n", 1), "copy"),
        (900_003, " ".join([*other.split(" ")[:-1], "changed."]), "near copy"),
        (900_004, " ".join(words[:80]) + " " + passage, "leak"),
    ]
    more = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t, _ in added], docs.schema)
    docs.union(more).coalesce(2).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, planted):
    docs, out = spark.read.parquet(f"{planted}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, stage(spark, docs, planted).cache())
        docs = out[name][1]
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_whole_rows_and_add_none(stages):
    names = list(stages)
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    for name, (before, after) in stages.items():
        assert after.columns[: len(before.columns)] == before.columns
        if name != "mix":
            assert after.columns == before.columns
        assert after.select(before.columns).exceptAll(before).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark, stages, planted):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{planted}/labels.parquet").filter(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    judged = {r.doc_id: r.quality for r in labels.collect()}
    kept = ids(after)
    good = [i for i, q in judged.items() if q == 1]
    junk = [i for i, q in judged.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in junk) <= 0.2 * len(junk)
    model = quality.learn(before.select("doc_id", "text"), quality.quality_labels(spark, planted))
    again = quality.score_quality(before.select("doc_id", "text"), model).filter("predicted = 1")
    assert ids(again) == kept


def test_exact_dedup_leaves_one_of_each_text(stages):
    before, after = stages["exact_dedup"]
    norm = lambda r: re.sub(r"[\x20\x09-\x0d]", "", r.text)
    a, b = before.collect(), after.collect()
    assert len(b) == len({norm(r) for r in a}) == len({norm(r) for r in b})
    kept = ids(after)
    assert not {900_001, 900_002} <= kept and {900_001, 900_002} & kept


def test_near_dedup_leaves_one_of_each_class(stages):
    before, after = stages["near_dedup"]
    sets = {}
    for r in before.collect():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}
    kept, by = ids(after), {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, set()).add(i)
    near = lambda i: {j for g in sets[i] for j in by[g] if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for i in kept:
        assert not near(i) & kept
    for i in set(sets) - kept:
        assert near(i)
    assert len(kept & {900_001, 900_002, 900_003}) == 1


def test_decontamination_drops_leaks_alone(spark, stages, planted):
    before, after = stages["decontaminate"]
    flagged = decontaminate.decontaminate(before.select("doc_id", "text"), spark.read.parquet(f"{planted}/benchmark.parquet")).filter("contaminated")
    assert 900_004 in ids(flagged) and ids(after) == ids(before) - ids(flagged)


def test_mix_places_every_row_once(stages):
    before, after = stages["mix"]
    assert ids(after) == ids(before)
    assert after.select("mix_position").distinct().count() == after.count() == before.count()


def test_run_is_all_stages(spark, stages, planted):
    assert ids(corpus_pipeline.run(spark, planted)) == ids(stages["mix"][1])


def test_columns_with_the_stages_own_names(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").filter("doc_id < 60 or doc_id > 900000")
    for c in ("score", "kept", "_text", "_len", "full_hash"):
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns and out.filter("score <> 'mine score' or kept <> 'mine kept' or _len <> 'mine _len'").count() == 0


def test_pipeline_query_is_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and len([n for n in QUERIES if n.startswith("op")]) == 10
