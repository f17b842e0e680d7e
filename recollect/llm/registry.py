"""Queries of the training-data operators and, where SQL expresses them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, clusters, counts, lexical, licences, lm, neardup, packing, pii, quality, secretscan, sql, topk
from .common import documents


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(documents(spark, sf_dir))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files live on this machine; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_rows(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_rows(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_rows(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_rows(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.read_back(chat.expand(chat.with_probe(conversations)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_rows(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_secrets": op2_secrets,
        "op3_licenses": op3_licenses,
        "op4_packing": op4_packing,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_top_k": op6_top_k,
        "op7_lm_scores": op7_lm_scores,
        "op8_quality_rules": op8_quality_rules,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_pii": op10_pii,
        "op11_token_counts": op11_token_counts,
        "op12_clusters": op12_clusters,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_formatting": sql.chat_formatting(),
        "op6_top_k": sql.top_k(),
        "op8_quality_rules": sql.quality_rules(),
        "op9_near_duplicates": sql.near_duplicates(),
        "op12_clusters": sql.clustering(),
        "op13_lexical_search": sql.lexical(),
    }
