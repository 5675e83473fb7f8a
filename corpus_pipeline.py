"""Corpus pipeline over ``documents``: quality classifier, quality rules, near duplicates, packing.

Every stage works on all that the one before kept, and its decisions take effect. All but the
last return the columns of ``documents``; packing returns where each piece of each document goes.
Null keys pass the filters like other rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgeline.llm import ngram_join, packing, quality_ranking, quality_rules
from forgeline.llm.queries import importable
from forgeline.session import new_run_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the learned ranking rejects go."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_ranking.keep(docs, quality_ranking.fit(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the weighted rules reject go."""
    importable(spark)
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, five words and 0.8: one document of each group stays."""
    importable(spark)
    return ngram_join.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: sequences of at most 1024 tokens."""
    importable(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]
# Learned scores, estimation and the linear program are beyond SQL; tests hold them to brute force.
ORACLE_SQL: str | None = None




def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = new_run_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{root}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
