"""From landed payloads to the common posting shape.

Landed data is a DataFrame with one payload per row: ``board`` (which company's board it came
from, where that matters), ``page_url`` (for pages) and ``payload`` (the text as fetched).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.columns import blank_to_null, trimmed

RAW_COLUMNS = {
    "source_slug": "string", "external_id": "string", "source_url": "string", "apply_url": "string",
    "company_name": "string", "company_url": "string", "raw_title": "string", "raw_location": "string",
    "description": "string", "posted_at": "timestamp", "remote_type": "string", "employment_type": "string",
    "salary_min": "double", "salary_max": "double", "salary_currency": "string", "salary_period": "string",
    "raw_payload": "string",
}


def read_landed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Landed files, one payload each; the folder above a file names its board."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return files.select(
        F.element_at(F.split(where, "/"), -2).alias("board"), where.alias("page_url"), F.col("value").alias("payload")
    )


def jobs_in(landed: DataFrame, field: str | None, schema: str) -> DataFrame:
    """One row per job of a JSON payload: ``job`` parsed, ``raw_payload`` its untouched text.

    ``field`` names the array in the payload; without it the payload is the array.
    """
    if field is None:
        items = F.from_json("payload", "array<string>")
    else:
        items = F.from_json("payload", f"struct<`{field}`:array<string>>")[field]
    rows = landed.select("*", F.posexplode(items).alias("place", "raw_payload"))
    return rows.withColumn("job", F.from_json("raw_payload", schema)).drop("payload")


def with_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Bring in what is configured per board: ``company_name, company_url`` and more."""
    return rows.join(companies, "board")


def as_postings(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The common shape; columns a source does not give are null."""
    chosen = {"source_slug": F.lit(source), **columns}
    if "raw_payload" not in chosen and "raw_payload" in rows.columns:
        chosen["raw_payload"] = F.col("raw_payload")
    out = [
        chosen[name].cast(kind).alias(name) if name in chosen else F.lit(None).cast(kind).alias(name)
        for name, kind in RAW_COLUMNS.items()
    ]
    kept = [F.col(c) for c in ("board", "page_url", "place") if c in rows.columns]
    return rows.select(*kept, *out)


def labelled(label: str, value: Column) -> Column:
    """"label: value", null for missing or empty values."""
    return F.concat(F.lit(f"{label}: "), blank_to_null(value))


def paragraphs(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def listed(values: Column, sep: str = ", ") -> Column:
    """The array joined, null when it is empty or missing."""
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def trimmed_or_null(value: Column) -> Column:
    return blank_to_null(trimmed(value))


def one_line(value: Column) -> Column:
    return trimmed(F.regexp_replace(value, r"\s+", " "))
