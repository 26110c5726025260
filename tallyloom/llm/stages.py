"""The operators as pipeline stages: (spark, docs, sf_dir) -> DataFrame.

All but pack return rows of docs with all their columns, whatever their names. Documents
need doc_id and text; null or repeated ids are judged row by row. Empty tables pass through. Very long
texts are judged whole; of rows that tie for a group's smallest id any one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import packing
from tallyloom.llm.common import keyed, table
from tallyloom.llm.decontaminate import contamination
from tallyloom.llm.exact_dedup import keep_first
from tallyloom.llm.minhash import near_duplicates
from tallyloom.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id stays."""
    return keep_first(spark, docs)


def _only(docs: DataFrame, key: str, stay: DataFrame) -> DataFrame:
    return docs.join(stay.select(F.col("doc_id").alias(key)), key, "left_semi").drop(key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    docs, key = keyed(spark, docs)
    return _only(docs, key, near_duplicates(spark, docs, id_col=key).where("doc_id = class_id"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs, key = keyed(spark, docs)
    return _only(docs, key, contamination(spark, docs, table(spark, sf_dir, "benchmark"), id_col=key).where("NOT contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)
