"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import stages
from skyloom.session import as_table, scratch_scope

STAGES = [
    ("language_id", stages.language_id),
    ("toxicity", stages.toxicity_filter),
    ("line_dedup", stages.line_dedup_stage),
    ("ngram_jaccard_join", stages.near_duplicates_out),
    ("best_fit_packing", stages.best_fit_packing),
]

#: The trained stages and the packing plan are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):  # what a stage wrote for itself goes once its result is written
            docs = as_table(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
