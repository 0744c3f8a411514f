"""Corpus pipeline: quality, near-duplicates, privacy, mixing, pieces.

``STAGES`` are applied in order; each is written as Parquet to the shared
checkpoint folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm.common import Scratch
from runlens.llm.stages import STAGES

# SQL expresses neither the classifier nor the segment model, the cube method or the coder
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last one."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
