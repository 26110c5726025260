"""Documents to packed training sequences, in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import stages
from tallyloom.llm.common import forget, materialize, table

STAGES = [
    ("quality", stages.quality),
    ("exact_dedup", stages.exact),
    ("near_dedup", stages.near),
    ("decontaminate", stages.clean),
    ("pack", stages.pack),
]

#: SQL has no trained classifier and no signatures; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(spark, before)
    return docs
