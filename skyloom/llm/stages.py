"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import jaccard_join, langid, line_dedup, packing, toxicity
from skyloom.llm.queries import CATEGORIES, tokenizer
from skyloom.llm.shared import boxed, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language that can be told."""
    found = langid.identify(docs, "text", declared="lang", host="source")
    return found.where("language_accepted").select(docs.columns)


def toxic_out(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    scored = toxicity.score(docs, labels, CATEGORIES)
    return scored.where(F.col("p_toxic") < threshold).select(docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the chain calls toxic. It learns from the labelled ones among those that are left."""
    return toxic_out(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; documents that this empties go. n_chars follows the text."""
    found = line_dedup.dedup(docs).where("not emptied")
    length = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep exactly one row, that of the least doc_id (nulls last) and text hash.

    Texts without words link with nothing: equal rows (doc_id and text) of them are one document, of which one
    row stays; those with a null doc_id stay.
    """
    other = jaccard_join.join(docs).where("not _kept").select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash")).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.select(boxed(docs), "doc_id", F.xxhash64("text").alias("_text_hash"), worded.alias("_worded"))
    left = marked.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_text_hash").orderBy(F.lit(0)))
    left = left.withColumn("_nth", F.when(F.col("doc_id").isNull() & ~F.col("_worded"), 1).otherwise(nth))
    return left.where("_nth = 1").select("_row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
