"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last
with the columns of ``documents``. ``run`` writes each stage's result as Parquet to the shared scratch folder and
reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import materialize, table
from quarrygrid.llm import neardup, packing, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject, with all columns.

    Each row is judged by its own text, so repeated rows go or stay together. Null and empty texts have the share of good labels as
    their score. Without labels all rows stay.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (5-word shingles, similarity 0.8 or more), decided by row: that with the smallest doc_id.

    One of repeated rows stays; rows of one id with different texts are documents of their own; texts that are null or hold no
    word are nobody's copies and stay.
    """
    return neardup.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets masked; null texts stay null, repeated rows stay, and a null doc_id makes no difference."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in windows of 2048 tokens; null and empty texts are the end token alone, repeated rows are packed each."""
    return packing.packed_digests(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: Neither the classifier nor the forest nor the packing can be said in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
