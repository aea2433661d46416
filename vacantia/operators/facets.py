"""Facet counts, counters and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.columns import string_array
from vacantia.operators.search import Tables

# What the facets read of a job, and of one that holds its technologies in an array.
FACETED = ["is_active", "role_category", "seniority", "employment_type", "eligible_regions", "eligible_countries", "technologies"]


def element_counts(jobs: DataFrame, column: str) -> DataFrame:
    """How often each element of an array column occurs in active jobs."""
    return (
        jobs.filter("is_active").select(F.explode(column).alias("value")).groupBy("value")
        .agg(F.count("*").alias("count"))
    )


def source_counts(jobs: DataFrame, listings: DataFrame) -> DataFrame:
    """Distinct active jobs per source over active listings.

    Pairs are made distinct on both keys first, so a source with most of the jobs is spread
    over all partitions.
    """
    active = jobs.filter("is_active").select("job_id")
    pairs = listings.filter("is_active").select("job_id", "source_slug").distinct()
    return (
        pairs.join(active.hint("merge"), "job_id", "left_semi").groupBy(F.col("source_slug").alias("value"))
        .agg(F.count("*").alias("count"))
    )


def facet_counts(jobs: DataFrame, job_technologies: DataFrame, listings: DataFrame) -> DataFrame:
    """``facet, value, count`` of the seven facets over active jobs.

    Five of them come from one scan of the jobs, each row giving its ``(facet, value)`` pairs.
    """
    active = jobs.filter("is_active")

    def pair(facet: str, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"))

    countries = F.filter("eligible_countries", lambda c: c != "US")
    pairs = F.concat(
        F.array(
            pair("roleCategory", F.col("role_category")),
            pair("seniority", F.col("seniority")),
            pair("employmentType", F.col("employment_type")),
        ),
        F.transform("eligible_regions", lambda r: pair("region", r)),
        F.transform(countries, lambda c: pair("country", c)),
    )
    from_jobs = (
        active.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
        .filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("count"))
    )
    by_technology = (
        job_technologies.join(active.select("job_id").hint("merge"), "job_id", "left_semi")
        .groupBy(F.col("technology").alias("value")).agg(F.count("*").alias("count"))
        .withColumn("facet", F.lit("technology"))
    )
    by_source = source_counts(jobs, listings).withColumn("facet", F.lit("source"))
    return from_jobs.unionByName(by_technology).unionByName(by_source)


def labelled(counts: DataFrame, tables: Tables) -> DataFrame:
    """Facet counts with the labels of their values, by facet and count."""
    labels = (
        tables.role_categories.select(F.lit("roleCategory").alias("facet"), F.col("slug").alias("value"), "label")
        .unionByName(tables.technologies.select(
            F.lit("technology").alias("facet"), F.col("slug").alias("value"), F.col("display_name").alias("label")))
        .unionByName(tables.sources.select(
            F.lit("source").alias("facet"), F.col("slug").alias("value"), F.col("display_name").alias("label")))
    )
    return (
        counts.join(labels, ["facet", "value"], "left")
        .select("facet", "value", F.coalesce("label", "value").alias("label"), "count")
        .orderBy("facet", F.col("count").desc(), "value")
    )


def facets(tables: Tables) -> DataFrame:
    """The seven facets: ``facet, value, label, count``."""
    return labelled(facet_counts(tables.jobs, tables.job_technologies, tables.listings), tables)


def technologies_of(jobs: DataFrame) -> DataFrame:
    """``job_id, technology`` of jobs that hold theirs in an array."""
    return jobs.select("job_id", F.explode(F.array_distinct("technologies")).alias("technology"))


def facet_changes(
    jobs_before: DataFrame, listings_before: DataFrame, jobs_after: DataFrame, listings_after: DataFrame
) -> DataFrame:
    """``facet, value, count``: what a change adds to the counts (less than zero: takes from them).

    All frames are of the jobs that change or whose listings do, with all listings of those, before and after.
    """
    before = facet_counts(jobs_before, technologies_of(jobs_before), listings_before)
    after = facet_counts(jobs_after, technologies_of(jobs_after), listings_after)
    both = after.unionByName(before.withColumn("count", -F.col("count")))
    return both.groupBy("facet", "value").agg(F.sum("count").alias("count")).filter("count <> 0")


def tab_predicate(tab: str) -> Column:
    """Which jobs a tab of the feed counts; the region-only tab counts like the default one."""
    if tab == "usRemote":
        return F.col("is_active") & (F.col("remote_type") == "FULLY_REMOTE") & (
            F.array_contains("eligible_countries", "US") | F.array_contains("eligible_regions", "WORLDWIDE")
        )
    return F.col("is_active") & F.arrays_overlap("eligible_regions", string_array(D.DEFAULT_REGIONS))


def new_listings(tables: Tables, since: Column, now: Column, tab: str = "all") -> DataFrame:
    """Listings first seen in ``(since, now]`` per source, and in total (null source)."""
    shown = tables.jobs.filter(tab_predicate(tab)).select("job_id")
    recent = tables.listings.filter(
        F.col("is_active") & (F.col("first_discovered_at") > since) & (F.col("first_discovered_at") <= now)
    ).select("job_id", "source_slug")
    counts = recent.join(shown, "job_id", "left_semi").rollup("source_slug").agg(F.count("*").alias("count"))
    names = tables.sources.select(F.col("slug").alias("source_slug"), "display_name")
    return counts.join(names, "source_slug", "left").select(
        "source_slug", F.coalesce("display_name", "source_slug").alias("display_name"), "count"
    )


def active_companies(tables: Tables) -> DataFrame:
    """Companies with active jobs and how many, by name."""
    counts = (
        tables.jobs.filter("is_active").groupBy(F.col("company_slug").alias("slug"))
        .agg(F.count("*").alias("active_jobs"))
    )
    return tables.companies.join(counts, "slug").select("slug", "name", "website_url", "active_jobs").orderBy("name", "slug")


def totals(tables: Tables) -> DataFrame:
    """One row: active jobs and known companies."""
    companies = tables.companies.agg(F.count("*")).scalar()
    return tables.jobs.filter("is_active").agg(F.count("*").alias("active_jobs")).withColumn(
        "companies", companies
    )


# --- runs -------------------------------------------------------------------------------


def error_samples(outcomes: DataFrame) -> DataFrame:
    """The first ten errors of each run, in order.

    Ten are kept per run and hashed slice before ten are kept per run, so a run that holds most
    of all errors is never ordered by one task.
    """
    errors = outcomes.filter("error IS NOT NULL").select(
        "run_id", "ordinal", "external_id", "error", F.pmod(F.xxhash64("ordinal"), F.lit(64)).alias("slice")
    )

    def keep(rows: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy("ordinal")
        return rows.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= D.ERROR_SAMPLE).drop("rn")

    kept = keep(keep(errors, "run_id", "slice"), "run_id")
    sample = F.sort_array(F.collect_list(F.struct("ordinal", "error", "external_id")))
    return kept.groupBy("run_id").agg(
        F.transform(sample, lambda e: F.struct(e["error"].alias("message"), e["external_id"])).alias("error_sample")
    )


def run_stats(outcomes: DataFrame, seen_known: DataFrame | None = None) -> DataFrame:
    """Counters and status of each run; known ids that were only seen count as fetched."""

    def n(*kinds: str) -> Column:
        return F.count_if(F.col("outcome").isin(*kinds))

    stats = outcomes.groupBy("run_id", "source_slug").agg(
        F.min("occurred_at").alias("started_at"),
        F.max("occurred_at").alias("finished_at"),
        F.count("*").alias("fetched"),
        n("CREATED", "MERGED", "UPDATED_EXISTING_LISTING").alias("eligible"),
        n("REJECTED_GEOGRAPHY").alias("rejected_geography"),
        n("REJECTED_ROLE_CATEGORY").alias("rejected_role"),
        n("CREATED").alias("created"),
        n("UPDATED_EXISTING_LISTING").alias("updated"),
        n("MERGED").alias("duplicate"),
        F.count("error").alias("errors"),
    )
    if seen_known is not None:
        stats = _with_seen(stats, seen_known)
    return stats.withColumn("status", F.when(F.col("errors") > 0, "PARTIAL").otherwise("SUCCESS")).withColumn(
        "duration_ms", F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at"))
    )


def _with_seen(stats: DataFrame, seen_known: DataFrame) -> DataFrame:
    """Known ids that were only seen count as fetched by their run."""
    seen = seen_known.groupBy("run_id").agg(F.count("*").alias("seen"))
    return stats.join(seen, "run_id", "left").withColumn(
        "fetched", F.col("fetched") + F.coalesce("seen", F.lit(0))
    ).drop("seen")


def ingestion_runs(
    outcomes: DataFrame, seen_known: DataFrame | None = None, started: DataFrame | None = None,
    started_at: Column | None = None, failed: DataFrame | None = None,
) -> DataFrame:
    """Run statistics with their error samples.

    ``started`` (``run_id, source_slug``) has all runs that began at ``started_at``: one that brought nothing has a row
    too, and its success counts for the sweep. ``failed`` (``run_id, source_slug, error``) has runs that came to nothing:
    they are FAILED, with that one error, and retire no listing.
    """
    stats = run_stats(outcomes)
    blank = {c: F.lit(0).cast(t) for c, t in stats.dtypes if t == "bigint"}
    times = {"started_at": started_at, "finished_at": started_at}
    if started is not None:
        idle = started.select("run_id", "source_slug").distinct().join(stats.select("run_id"), "run_id", "left_anti")
        stats = stats.unionByName(idle.withColumns(blank | times | {"status": F.lit("SUCCESS")}).select(*stats.columns))
    if seen_known is not None:
        stats = _with_seen(stats, seen_known).select(*stats.columns)
    out = stats.join(error_samples(outcomes), "run_id", "left")
    if failed is None:
        return out
    sample = F.array(F.struct(F.col("error").alias("message"), F.lit(None).cast("string").alias("external_id")))
    told = failed.withColumns(blank | times | {"errors": F.lit(1).cast("bigint"), "status": F.lit("FAILED"), "error_sample": sample})
    return out.unionByName(told.select(*out.columns))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last started run of each source, whole."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("run")
    return runs.groupBy("source_slug").agg(newest).select("run.*")


def source_overview(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """All sources with their last run, by status and name."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(D.SOURCE_STATUS_ORDER) for x in (s, i)])
    last = latest_runs(runs).select(
        "source_slug", F.col("run_id"), F.col("status").alias("run_status"), "started_at", "fetched", "created",
        "errors",
    )
    return (
        sources.join(last, F.col("slug") == F.col("source_slug"), "left").drop("source_slug")
        .orderBy(F.try_element_at(place, F.col("status")), "display_name")
    )
