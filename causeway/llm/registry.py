"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontaminate, jaccard_join, language_id, mixing, quality_rules, substring_dedup, token_output, toxicity, url_lists, weak_labels
from causeway.llm.rows import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(documents(spark, sf_dir))


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read(*token_output.write(documents(spark, sf_dir), tokenizer_path()))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.judge(pages.withColumn("fetched", url_lists.capture_day(F.col("page_id"))), url_lists.derived_entries(pages))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_weak_labels, op4_language_id, op5_toxicity, op6_token_output, op7_jaccard_join, op8_mixing, op9_decontaminate, op10_url_lists)}


def oracle_sql() -> dict:
    return {"op8_mixing": mixing.oracle(), "op10_url_lists": url_lists.oracle()}
