"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash and writes them with their
bucket. Pass two reads the buckets, puts each into a random order with a seeded Fisher-Yates shuffle (that is
what Spark's ``shuffle`` function does to an array) and numbers the records through: bucket after bucket, place
after place. Record ``p`` of this order goes to shard ``p mod n`` at slot ``p div n``, so the numbers of rows of
any two shards differ by one at most (law ``rows``), whatever the sizes, copies or sources are.

No Python runs on the rows. The hash takes the row's number in the scan beside its values, so repeated rows
and null keys scatter like all others, and no bucket is hot. The scattered records are written once and both
reads of pass two use that table; a lost executor repeats a bucket, never the scattering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.plans.session import written

SEED = 20_240_607
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 100_000
# Buckets for each shuffle partition at least, so that partitions come out even.
SPREAD = 8


def record_bytes(df: DataFrame):
    """About how many bytes a record takes: its strings and binaries, and 16 for each other column."""
    parts = [
        F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(16)
        for c, kind in df.dtypes
    ]
    return sum(parts, F.lit(8)).cast("long")


def scattered(records: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pass one: ``record`` (all columns as a struct) and ``bucket``, as a written table."""
    spark = records.sparkSession
    total = records.agg(F.sum(record_bytes(records)).alias("b"), F.count("*").alias("n")).first()
    spread = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-(total["b"] or 0) // bucket_bytes), -(-total["n"] // BUCKET_ROWS), spread)
    packed = records.select(F.struct("*").alias("record"))
    key = F.xxhash64(F.lit(seed), F.xxhash64("record"), F.monotonically_increasing_id())
    return written(packed.withColumn("bucket", F.pmod(key, F.lit(buckets))))


def shuffled(records: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pass two: ``record`` and its ``place`` (from 0, gapless) in a random order of all records."""
    table = scattered(records, seed, bucket_bytes)
    # One row a bucket: as many as the bytes make, never as many as the records.
    ends = table.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.expr("sum(n) over (order by bucket rows between unbounded preceding and 1 preceding)")
    starts = ends.select("bucket", F.coalesce(before, F.lit(0)).alias("start"))
    lists = (
        table.groupBy("bucket")
        .agg(F.sort_array(F.collect_list("record")).alias("records"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    )
    placed = lists.join(starts, "bucket").select("start", F.posexplode("records").alias("at", "record"))
    return placed.select("record", (F.col("start") + F.col("at")).alias("place"))


def sharded(
    records: DataFrame, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All records in random order over ``shards``: ``record``, ``shard`` (from 0) and ``slot`` (from 0, gapless).

    Nulls in any column, empty and long texts and extra columns (they stay inside ``record``) are records like
    any other; repeated rows stay as many as they are; an empty table gives no rows. Columns must be of types
    Spark can order (no maps).
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    place = F.col("place")
    return shuffled(records, seed, bucket_bytes).select(
        "record",
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / shards).cast("long").alias("slot"),
    )


def write_shards(shards: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    """Write the records as Parquet, a folder for each shard, each file a stretch of slots in order."""
    stretch = F.floor(F.col("slot") / rows_per_file).alias("stretch")
    files = shards.select("shard", "slot", stretch, "record.*")
    (
        files.repartition("shard", "stretch")
        .sortWithinPartitions("shard", "stretch", "slot")
        .write.partitionBy("shard", "stretch")
        .parquet(path)
    )


def digest(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's columns for ``documents``, from whole records as they lie in their shards.

    A null text has no bytes, so size 1 and checksum 0; other rows and columns as in ``sharded``.
    """
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharded(documents, shards).select(
        "record.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
