"""What the operators share: reading the tables and row keys that survive a second pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(columns: list[str]) -> Column:
    """64 bits of all values of a row: rows with the same key are taken as repeated rows.

    It depends on the row alone, so passes that run at different times, or again after an executor was
    lost, agree about it.
    """
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


# Texts turned into Python values at a time, so a batch of long texts is never there twice as a whole.
SLICE = 256


def per_text(make: Callable[[], Callable[[list[bytes | None]], list[dict]]], returns: str) -> Callable:
    """A column function of a text that runs Python on Arrow batches.

    ``make`` runs once per task and gives the function that turns UTF-8 texts (None: null) into one dict each
    of the fields in ``returns``, a struct type.
    """
    schema = StructType.fromDDL(returns)
    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            texts = batch.cast(pa.large_binary())
            parts = [
                pa.array(work(texts.slice(at, SLICE).to_pylist()), type=kind) for at in range(0, len(texts), SLICE)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run
