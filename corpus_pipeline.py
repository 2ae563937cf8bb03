"""The corpus pipeline: five stages over `documents`, each of which works on all that the stage before kept.

Every stage takes and returns the columns of `documents`; the last adds what the mix takes of each. Between
stages the rows are written as Parquet into the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontamination, mixing, ngram_join, quality_classifier, secret_scans
from lamina.llm.common import cut, table


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage may have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality_classifier.score(docs, model, into=name).filter(F.col(name) >= quality_classifier.THRESHOLD).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return ngram_join.deduplicate(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts."""
    return _resized(decontamination.remove(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return _resized(secret_scans.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take of each source what its weight gives it."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_benchmark_passages),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]

#: The classifier's scores can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
