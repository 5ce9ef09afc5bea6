"""From raw documents to compressed token ids: the corpus operators in a row.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, works on all rows that the stage before
kept, and returns rows of the same columns; the last one returns what its token files hold. Stages defer how nulls, empty
texts, ties and repeated rows count to their operators, which state it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docframe.llm import decontaminate, mixing, quality, simhash, tokens
from docframe.llm.common import remove, remove_since, shared_dir, table, written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels of all documents, not only of docs."""
    return quality.keep_good(docs, quality.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them: not at all, once or twice."""
    return mixing.apply(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what each holds of which document."""
    return tokens.digest(tokens.written(docs))


STAGES = [
    ("quality classifier", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written and read again before the next.

    Once a stage's rows are written, the tables it was made of are deleted; the last stage's rows stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        begun, folder = len(written()), f"{shared_dir(spark)}/docframe-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage")
        remove_since(spark, begun)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(f"{folder}/stage"), folder
    return docs
