"""Clean a corpus: quality classifier, quality rules, near-duplicate join, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them again, so that no stage is
computed twice and a lost executor costs one task.

In every stage: columns of any name pass through; repeated rows are judged alike; an empty table stays empty; texts are
read whole, however long. A null text counts as an empty one, and a null id as an id of its own.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import classifier, decontam, jaccard, mixing, repetition
from seqloom.llm.shared import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored below 0.3 by a network trained on the labelled ones among them.

    Texts without words get the score of no words; without labels, or with labels of one class, all have the prior's
    score. Null labels and ids teach nothing. The lower label counts where an id has several.
    """
    model = classifier.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.keep_quality(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that repeat themselves, are too short or hold too many symbols; so null and empty texts go."""
    return repetition.keep_by_rules(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates (five words, similarity 0.75 or more).

    Rows with a null id stay, as do texts without words; of rows that share a group's smallest id all stay.
    """
    return jaccard.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item's question and answer stand; null items and texts match nothing."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that tokens meet the source, language and topic targets.

    Null source and language are values of their own; a cell without tokens is dropped; rows with one id share a draw.
    """
    return mixing.sample_mix(docs)


STAGES = [(f.__name__, f) for f in (quality_classifier, quality_rules, ngram_jaccard_join, benchmark_decontamination, mixing_to_targets)]

#: A trained network and hashed n-grams are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; nulls, ties, repeated rows, empty tables and further columns are as in the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
