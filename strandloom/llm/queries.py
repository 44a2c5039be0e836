"""The queries of this subpackage, by name, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import oracles
from strandloom.llm.common import table
from strandloom.llm.conversations import damaged, repairs
from strandloom.llm.decontaminate import decontaminate
from strandloom.llm.html_text import extract_text
from strandloom.llm.licences import licence_scan
from strandloom.llm.packing import best_fit_packing
from strandloom.llm.pitman_yor import held_out, score_texts
from strandloom.llm.quality import quality_rules
from strandloom.llm.simhash import near_duplicates
from strandloom.llm.token_counts import context_limits, length_histogram
from strandloom.llm.toxicity import toxicity
from strandloom.llm.vector_codes import compress
from strandloom.llm.vector_search import nearest
from strandloom.llm.warc import archive_round_trip


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(table(spark, sf_dir, "documents")))


def op6_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_archive,
        op2_html_extraction,
        op3_toxicity,
        op4_benchmark_decontamination,
        op5_token_counts,
        op6_pitman_yor_scores,
        op7_simhash_near_dedup,
        op8_licence_scan,
        op9_quality_rules,
        op10_best_fit_packing,
        op11_conversation_repair,
        op12_nearest_vectors,
        op13_vector_codes,
    )
}
ORACLE_SQL = {
    "op1_warc_archive": oracles.OP1,
    "op4_benchmark_decontamination": oracles.OP4,
    "op8_licence_scan": oracles.OP8,
    "op9_quality_rules": oracles.OP9,
    "op12_nearest_vectors": oracles.OP12,
    "op13_vector_codes": oracles.OP13,
}
