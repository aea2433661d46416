"""The fixed vocabularies as tables, so that other jobs and readers need not know this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia import dictionaries as D
from vacantia.plans import binding as B

VOCABULARIES = ("dict_phrases", "dict_countries", "role_categories", "technologies", "sources")


def vocabulary(spark: SparkSession, name: str) -> DataFrame:
    """A vocabulary from the package's own values."""
    if name == "dict_phrases":
        return spark.createDataFrame(D.dictionary_rows(), "dict string, priority int, phrase string, value string")
    if name == "dict_countries":
        rows = [
            (code, country, D.COUNTRY_ALIASES.get(code, []), *[region in regions for region in ("EUROPE", "EU", "EEA", "EMEA")])
            for code, country, regions in D.COUNTRIES
        ]
        flags = "is_europe boolean, is_eu boolean, is_eea boolean, is_emea boolean"
        return spark.createDataFrame(rows, f"code string, name string, aliases array<string>, {flags}")
    return {"role_categories": B.role_categories, "technologies": B.technologies, "sources": B.sources}[name](spark)


def seed(spark: SparkSession, root: str) -> None:
    """Write every vocabulary under ``root``. What is there already is replaced, as the package's values are fixed."""
    for name in VOCABULARIES:
        vocabulary(spark, name).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")


def seeded(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A written vocabulary."""
    return spark.read.schema(vocabulary(spark, name).schema).parquet(f"{root}/{name}")
