"""The training-corpus pipeline: five stages, each on all that the one before it kept.

All stages treat odd rows alike. A null text counts as an empty one and a null doc_id is carried
through. The first four return rows of their input with all columns as they are, extra ones included,
whatever their names; which of several equal rows stays makes no difference. Texts are read whole,
however long. An empty table gives an empty result. Stages do not swallow errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trovelens.llm import exact_dedup, ngram_join, packing, quality_net, toxicity
from trovelens.plans.lineage import cut


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones that are not held out, does not reject.

    Null and empty texts are scored as no bytes. Repeated rows and ties go or stay together. Without
    labels of both classes among ``docs`` nothing is rejected.
    """
    return quality_net.accepted(docs, quality_net.trained(docs, _labels(spark, sf_dir)))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not find toxic.

    Null and empty texts have no features and stay. Repeated rows and ties go or stay together. Without
    labels of both kinds among ``docs`` nothing is found toxic.
    """
    return toxicity.accepted(docs, toxicity.trained(docs, _labels(spark, sf_dir)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest doc_id; null ids count as the largest.

    Null, empty and blank texts: null equals empty; runs of white space equal one space. Rows with one
    id and different texts are judged each by its own; of equal rows one stays.
    """
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id.

    Texts without words (null, empty, blank) are linked with nothing and stay, as do null ids whose text
    no id has. Rows with one id and different texts are judged each by its own; of equal rows one stays.
    """
    return ngram_join.representatives(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, placed in training sequences.

    A null or empty text is the end id alone; repeated rows are packed each; other columns go.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: The classifiers' decisions can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
