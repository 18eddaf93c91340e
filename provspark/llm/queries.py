"""The operators as queries over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, fingerprint, html_text, language, line_dedup, lm_score, near_dedup, packing, suffix_dedup
from .shared import read_table


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_query(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public vocabulary that the packing query uses; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(read_table(spark, sf_dir, "documents"))


def op9_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preference_query(read_table(spark, sf_dir, "conversations"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_html_text": op2_html_text,
    "op3_language": op3_language,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_line_dedup": op8_line_dedup,
    "op9_preference_chat": op9_preference_chat,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL = {
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_preference_chat": chat_format.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
}
