"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import alignment, chat, html_text, jaccard_join, langid, line_dedup, packing, quality, repair, sentencepieces, topk, toxicity, url_filter
from skyloom.llm.shared import table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op4_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_conversations(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.SCHEMAS)


#: Chain of op5 over the labels: junk first, for it hides words; toxic last.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    toxic = F.col("p_toxic") >= 0.5
    return scored.select("doc_id", "p_low_quality", "p_toxic", toxic.alias("toxic"), (~toxic).alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = langid.identify(docs, "text", declared="lang", host="source")
    return found.select("doc_id", "language", "posterior", F.col("language_accepted").alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_text_hash", "_kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk,
        op2_url_filters,
        op3_best_fit_packing,
        op4_chat_tool_links,
        op5_toxicity,
        op6_line_dedup,
        op7_language_id,
        op8_quality_rules,
        op9_ngram_jaccard_join,
        op10_sentencepiece,
        op11_html_extraction,
        op12_conversation_repair,
        op13_cross_tokenizer_alignment,
    )
}
