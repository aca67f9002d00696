"""A corpus pipeline: each stage works on the whole rows that the stage before it kept.

Every stage returns an empty table for one, keeps columns of any name, and reads whole texts. A null text
is the empty text. Rows that repeat whole, or repeat an id, are told apart as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from loomwright.llm.common import aside, cut, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Each row stands for itself. Null and empty texts get the score of a text without words. Without
    labels of both kinds all rows stay or all go, as the labels that there are say; without labels they stay.
    """
    model = quality.learn(docs.select("doc_id", "text"), quality.quality_labels(spark, sf_dir))
    docs, back = aside(docs, ["score", "predicted"])
    return back(quality.score_quality(docs, model, keep_text=True).filter("predicted = 1").select(*docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the longest, then the one with the smallest id.

    Null and empty texts are equal. A null id loses every tie. Of rows that repeat an id the longest
    stays, and of rows that repeat whole one.
    """
    docs, back = aside(docs, ["keep_id", "group_size", "kept", "full_hash"])
    found = exact_dedup.exact_dedup(docs).filter("kept")
    return back(exact_dedup.first_of_repeats(found, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id.

    Texts without words, null ones too, are nobody's duplicates and stay. A null id counts as the
    greatest. Of rows of a group that repeat its smallest id one stays.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share a passage with the benchmark. Each row stands for itself; rows without words stay."""
    return decontaminate.clean_of(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its place in the mixture of sources. All rows stay, repeated ones too; a null source is the source ''."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]

#: The first stage learns a classifier and the third compares n-gram sets, which SQL can't follow;
#: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the checkpoint folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
