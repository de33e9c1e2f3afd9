"""The thin queries of the text operators, as registered in __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, decontam, html_extract, line_dedup, oracles, rlz_dedup, sharding, simhash, sp_tokens, suffix_dedup, toxicity


SP_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.uniform_shards(_table(spark, sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encode_texts(_table(spark, sf_dir, "documents"), SP_MODEL).select("doc_id", "n_tokens", "token_ids", "parity", "round_trip")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), min_docs=10)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), error_rate=0.05)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents")).report()
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=5, query_step=50)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz_dedup.repeated_words(_table(spark, sf_dir, "documents")).report()
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_sharding, op3_html_extraction, op4_sentencepiece, op5_line_dedup, op6_decontamination, op7_toxicity, op8_suffix_dedup, op9_nearest_neighbours, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
