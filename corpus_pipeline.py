"""A training corpus from raw documents: resample by quality, drop near duplicates, redact, pack.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents. An empty table gives an
empty one in every stage; further columns pass the stages as they are and end
before the last. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import jaccard, packing, pii, quality
from meshwright.llm.common import shared_dir, table
from meshwright.operators.iterate import scratch


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go. Null and empty texts weigh as the corpus on average; rows of equal texts fare alike."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every class of near duplicates; of repeated rows one. Null texts are empty and copies of each other; a null doc_id comes last."""
    return jaccard.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows. Null texts stay null; no row goes."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their ids and their places in sequences of at most 1024 ids. Null and empty texts are one piece of the end id."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("quality", by_quality),
    ("near duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Neither the classifier nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the corpus is a table in the shared folder, and a stage's own tables go."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
