"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanspark.llm import line_dedup as lines
from gleanspark.llm import chat, ngram_join, secrets, substring
from gleanspark.llm.ann import ann_search
from gleanspark.llm.common import pick, table
from gleanspark.llm.decontam import decontaminate
from gleanspark.llm.langid import language_id
from gleanspark.llm.packing import best_fit_packing
from gleanspark.llm.quality import quality_scores


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.line_dedup(pick(docs, "doc_id", "text"), dropped_col="lines_dropped")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents")).select("doc_id", "rule", "n_matches")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.span_texts(substring.repeated_passages(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_rows(table(spark, sf_dir, "conversations"))


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8`` over the same table with attachments in its messages."""
    return chat.chat_rows(chat.mixed_parts(table(spark, sf_dir, "conversations")))


def passages_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without what ``op7`` finds."""
    return substring.drop_passages(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_packing": op9_packing,
    "op10_ann": op10_ann,
    "chat_parts": chat_parts,
    "passages_dropped": passages_dropped,
}
ORACLES = {
    "op2_ngram_join": ngram_join.sql(),
    "op3_line_dedup": lines.sql(),
    "op4_secret_scan": secrets.sql(),
    "op7_substring_dedup": substring.sql(),
    "op8_chat_format": chat.sql(),
    "chat_parts": chat.mixed_sql(),
}
