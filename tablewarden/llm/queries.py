"""The registered queries: each operator over its whole table, and DuckDB SQL where that can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import (
    conversation_repair,
    fingerprint,
    jaccard,
    language,
    lm_scoring,
    packing,
    quality,
    ranked_search,
    sentence_pieces,
    substring,
    toxicity,
    url_filter,
    vector_search,
)
from tablewarden.llm.common import file_bytes, fold, table
from tablewarden.llm.oracles import ORACLES  # noqa: F401
from tablewarden.llm.rules import URL_RULES


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES), "page_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = fold(F.col("doc_id"), 3) != 1
    model = language.fit(docs, learnable)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(~learnable, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score"
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines_removed chars_lost".split()
    return measured.select("doc_id", *[F.col("quality")[f].alias(f) for f in fields])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnable = fold(F.col("doc_id"), 3) != 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(~learnable, F.lit(False)).alias("held_out"), "toxicity.score", "toxicity.predicted"
    )


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.with_digests(docs, file_bytes(public_tokenizers.path("piece_bpe_32k.model"))).select("doc_id", "pieces.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = file_bytes(public_tokenizers.path("byte_bpe_50k.json")).decode()
    return packing.pack(packing.tokenised_pieces(table(spark, sf_dir, "documents"), tokenizer))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = conversation_repair.damaged(conversation_repair.rows_of(conversations))
    judged = conversation_repair.judge(rows, conversations.select(F.col("conv_id").alias("conv")).distinct())
    return conversation_repair.with_digests(rows, judged).withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_fingerprint": op10_fingerprint,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_search": op12_exact_search,
    "op13_conversation_repair": op13_conversation_repair,
}
