"""The subpackage's queries, each over its whole table with production parameters, and the
SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, jaccard, line_dedup, mixing, packing, pii, quality_model, quality_rules, sharding, topk
from .common import read_table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), pii.key_of(spark)).select("doc_id", "text", "n_values", "kinds")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = quality_model.held_out(F.col("doc_id"))
    model = quality_model.fit(docs, read_table(spark, sf_dir, "labels"), ~out)
    return quality_model.classify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.apply_rules(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "n_lost_words", F.length("cleaned").cast("long").alias("cleaned_chars"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_quality_model": op3_quality_model,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_top_k": op8_top_k,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_source_mix": mixing.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op8_top_k": topk.ORACLE,
}
