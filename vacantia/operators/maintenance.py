"""Table upkeep: idempotent capture, status log, upserts, touch and sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.text import checksum

LISTING = ["source_slug", "external_id"]
CAPTURE = [*LISTING, "checksum"]

# --- capture ----------------------------------------------------------------------------


def with_checksum(postings: DataFrame) -> DataFrame:
    return postings.withColumn("checksum", checksum(F.col("raw_payload")))


def latest_status(log: DataFrame) -> DataFrame:
    """Current status of each capture from the append-only log."""
    newest = F.max_by(F.struct("status", "error"), F.struct("logged_at", "sequence")).alias("last")
    return log.groupBy(*CAPTURE).agg(newest).select(*CAPTURE, "last.status", "last.error")


def with_change(postings: DataFrame, captured: DataFrame) -> DataFrame:
    """Add ``change``: NEW, CHANGED, RETRY or UNCHANGED.

    ``captured`` has the status of earlier captures. Content already brought to an end is
    unchanged; content whose processing never ended is tried again.
    """
    triples = captured.select(*CAPTURE, F.col("status").alias("seen_status")).dropDuplicates(CAPTURE)
    ids = captured.select(*LISTING).distinct().withColumn("seen_before", F.lit(True))
    out = postings.join(triples, CAPTURE, "left").join(ids, LISTING, "left")
    change = (
        F.when(F.col("seen_status").isin(D.TERMINAL_STATUSES), "UNCHANGED")
        .when(F.col("seen_status").isNotNull(), "RETRY")
        .when(F.col("seen_before"), "CHANGED")
        .otherwise("NEW")
    )
    return out.withColumn("change", change).drop("seen_status", "seen_before")


def known_ids(captured: DataFrame, listings: DataFrame, parser_version: int | dict[str, int] | None = None) -> DataFrame:
    """External ids a detail-heavy source need not fetch again.

    Without a wanted parser version: all that came to an end. With one: listed ids and those
    parsed at that version. A dictionary has the wanted versions of the sources that have one.
    """
    ended = captured.filter(F.col("status").isin(D.TERMINAL_STATUSES))
    if parser_version is None or parser_version == {}:
        return ended.select(*LISTING).distinct()
    if isinstance(parser_version, dict):
        entries = [F.lit(x) for entry in parser_version.items() for x in entry]
        wanted = F.try_element_at(F.create_map(*entries), F.col("source_slug"))
    else:
        wanted = F.lit(parser_version)
    parsed = F.col("parser_version") if "parser_version" in captured.columns else parser_of(F.col("raw_payload"))
    known = ended.filter(wanted.isNull() | (parsed == wanted)).select(*LISTING)
    return listings.filter(wanted.isNotNull()).select(*LISTING).unionByName(known).distinct()


def parser_of(payload: Column) -> Column:
    """The parser version a payload names, or null."""
    return F.get_json_object(payload, "$.parserVersion").try_cast("int")


def split_known(discovered: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discovered ids as ``(seen and known, new)``."""
    return discovered.join(known, LISTING, "left_semi"), discovered.join(known, LISTING, "left_anti")


def status_rows(outcomes: DataFrame, now: Column) -> DataFrame:
    """Log rows of the statuses that outcomes lead to."""
    status = (
        F.when(F.col("error").isNotNull(), "FAILED")
        .when(F.col("outcome") == "MERGED", "MERGED_DUPLICATE")
        .when(F.col("outcome").isin("CREATED", "UPDATED_EXISTING_LISTING"), "PUBLISHED")
        .otherwise(F.col("outcome"))
    )
    return outcomes.filter("outcome IS NULL OR outcome <> 'UNCHANGED'").select(
        *CAPTURE, status.alias("status"), "error", now.alias("logged_at"), F.col("ordinal").alias("sequence")
    )


# --- upserts ----------------------------------------------------------------------------


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Full join of a table and its changes, one row per key on both sides.

    Rule per column: ``keep`` (first write stays), ``replace`` (the change wins where it has a
    row), ``given`` (the change wins where it has a value).
    """
    flagged = changes.withColumn("_changed", F.lit(True))
    columns = [F.col(k) for k in keys]
    stored = table.withColumn("_stored", F.lit(True))
    out = stored.alias("t").join(flagged.alias("c"), keys, "full")
    for name in table.columns:
        if name in keys:
            continue
        old, new = F.col(f"t.{name}"), F.col(f"c.{name}")
        rule = rules.get(name, "replace")
        if rule == "keep":
            value = F.when(F.col("_stored"), old).otherwise(new)
        elif rule == "given":
            value = F.coalesce(new, old)
        else:
            value = F.when(F.col("_changed"), new).otherwise(old)
        columns.append(value.alias(name))
    return out.select(*columns)


COMPANY_RULES = {"name": "keep", "website_url": "given"}
LISTING_RULES = {"job_id": "keep", "first_discovered_at": "keep"}


def upsert_companies(companies: DataFrame, created: DataFrame) -> DataFrame:
    """``created``: ``slug, name, website_url, ordinal`` of postings that founded jobs."""
    changes = created.groupBy("slug").agg(
        F.min_by("name", "ordinal").alias("name"),
        F.max_by("website_url", F.when(F.col("website_url").isNotNull(), F.col("ordinal"))).alias("website_url"),
    )
    return upsert(companies, changes, ["slug"], COMPANY_RULES)


def upsert_listings(listings: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(listings, changes, LISTING, LISTING_RULES)


# --- freshness --------------------------------------------------------------------------


def touch(listings: DataFrame, jobs: DataFrame, seen: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Listings seen again, and their jobs, become fresh and active.

    What was seen grows with the tables, however small its files are, so none of it is broadcast.
    """
    ids = seen.select(*LISTING).distinct().withColumn("_seen", F.lit(True))
    marked = listings.join(ids.hint("merge"), LISTING, "left")
    fresh = F.col("_seen").isNotNull()

    def refreshed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "last_seen_at": F.when(fresh, now).otherwise(F.col("last_seen_at")),
                "is_active": fresh | F.col("is_active"),
            }
        ).drop("_seen")

    job_ids = marked.filter(fresh).select("job_id").distinct().withColumn("_seen", F.lit(True))
    renewed = refreshed(jobs.join(job_ids.hint("merge"), "job_id", "left")).select(*jobs.columns)
    return refreshed(marked).select(*listings.columns), renewed


def swept_since(runs: DataFrame) -> DataFrame:
    """``source_slug, since``: when the last successful run of each source began."""
    return runs.filter("status = 'SUCCESS'").groupBy("source_slug").agg(F.max("started_at").alias("since"))


def stale_listings(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Active listings that the last successful run of their source did not see."""
    since = F.broadcast(swept_since(runs))
    return listings.filter("is_active").join(since, "source_slug").filter("last_seen_at < since").drop("since")


def sweep(listings: DataFrame, jobs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retire listings a successful run of their source did not see, and jobs left without any.

    A run that was partial or failed retires nothing. There is a row per source of when its run began, so listings are not
    sent to one task by source for it. There is one per job of what is left of it, which no join may broadcast.
    """
    started = F.broadcast(swept_since(runs).withColumnRenamed("since", "_since"))
    stale = F.col("_since").isNotNull() & (F.col("last_seen_at") < F.col("_since"))
    swept = (
        listings.join(started, "source_slug", "left").withColumn("is_active", F.col("is_active") & ~stale)
        .select(*listings.columns)
    )
    alive = swept.groupBy("job_id").agg(F.bool_or("is_active").alias("_alive"))
    kept = jobs.join(alive.hint("merge"), "job_id", "left").withColumn(
        "is_active", F.col("is_active") & F.coalesce("_alive", F.lit(True))
    )
    return swept, kept.select(*jobs.columns)
