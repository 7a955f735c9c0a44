"""A corpus from raw documents: toxic and unreadable ones out, near copies merged,
benchmark passages out, sources mixed to weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convoscope.llm import corpus
from convoscope.llm.common import learnable, stage, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return corpus.drop_toxic(docs, table(spark, sf_dir, "labels"), learnable("doc_id", 3, 1))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return corpus.keep_languages(docs, learnable("doc_id", 3, 1))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return corpus.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return corpus.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return corpus.mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The two models learn by iteration, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
