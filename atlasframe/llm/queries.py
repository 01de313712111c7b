"""The queries of the training-data operators, as the driver runs them, and
their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm import byte_pieces, decontaminate, importance, language_id, pieces, quality_crf, quality_rules, simhash, substring_dedup, token_files, toxicity, url_filters, whitening
from atlasframe.llm.shared import documents, fold


def held_out(parts: int, rest: int) -> Column:
    """Whether a row's remainder is the one held out of fitting; false for a row without an id."""
    return F.coalesce(fold("doc_id", parts) == rest, F.lit(False)).alias("held_out")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("host").withColumn("host_rate", F.round("host_rate", 6))


def quality_model(docs: DataFrame, sf_dir: str) -> quality_crf.Model:
    """Fitted on the rows that op5's contract leaves for it."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.fit(docs.where(fold("doc_id", 3) != 1), labels)


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = quality_crf.predict(docs, quality_model(docs, sf_dir))
    return found.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs.where(fold("doc_id", 4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.predict(docs, model)
    return found.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "rule string, action string")
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).drop("component")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1, buckets=10_000, share=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pieces.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_simhash_near_dedup, op2_language_id, op3_substring_dedup, op4_quality_rules, op5_quality_crf, op6_toxicity, op7_url_filters, op8_decontamination, op9_token_files, op10_sentencepiece, op11_whitening, op12_importance, op13_byte_bpe]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.ORACLE, "op7_url_filters": url_filters.ORACLE, "op12_importance": importance.ORACLE}
