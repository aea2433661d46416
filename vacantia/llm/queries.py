"""The queries of this folder and, where SQL can say them, the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.catalog import Catalog
from vacantia.llm import (
    check_sql,
    conversation_repair,
    decontamination,
    embedding_dedup,
    html_extraction,
    language_id,
    license_scan,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash_dedup,
    spelling,
    token_counts,
)
from vacantia.llm.tables import table

catalog = Catalog()


@catalog.add("op1_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


@catalog.add("op2_simhash_dedup")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(table(spark, sf_dir, "documents"))


@catalog.add("op3_secret_scan", check_sql.secrets())
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


@catalog.add("op4_best_fit_packing")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


@catalog.add("op5_decontamination")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@catalog.add("op6_token_counts")
def section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"))


@catalog.add("op7_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@catalog.add("op8_license_scan", check_sql.licenses())
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents"))


@catalog.add("op9_html_extraction")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.digest(table(spark, sf_dir, "pages"))


@catalog.add("op10_sharding")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


@catalog.add("op11_conversation_repair")
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


@catalog.add("op12_embedding_dedup")
def embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(table(spark, sf_dir, "embeddings"))


@catalog.add("op13_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))
