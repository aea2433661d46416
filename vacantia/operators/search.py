"""Job search: filters, joins, order, page and total."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators import filters, fulltext
from vacantia.operators.filters import SearchParams
from vacantia.plans.session import written

# Fixed value: the page size where none is asked for.
DEFAULT_PAGE_SIZE = 20


@dataclass(frozen=True)
class Tables:
    """The canonical tables a search reads."""

    jobs: DataFrame
    companies: DataFrame
    listings: DataFrame
    job_technologies: DataFrame
    sources: DataFrame
    technologies: DataFrame
    role_categories: DataFrame | None = None
    index: DataFrame | None = None
    # Where texts are stored apart from the jobs.
    job_texts: DataFrame | None = None


def matching_jobs(tables: Tables, params: SearchParams, now: Column) -> DataFrame:
    """All jobs that satisfy the parameters; with ``rank`` when there is a query."""
    jobs = tables.jobs.filter(filters.predicate(params, now))
    if params.technology:
        jobs = filters.with_any_technology(jobs, tables.job_technologies, params.technology)
    if params.source_slug:
        jobs = filters.from_sources(jobs, tables.listings, params.source_slug)
    if params.exclude_source_slug:
        jobs = filters.not_from_sources(jobs, tables.listings, params.exclude_source_slug)
    if params.q and params.q.strip():
        index = tables.index if tables.index is not None else fulltext.postings(
            jobs, only=fulltext.query_terms(fulltext.clauses(params.q))
        )
        hits = fulltext.match(index, params.q, jobs=jobs)
        jobs = jobs.join(fulltext.rank(hits, params.q).select("job_id", "rank"), "job_id")
    return jobs


def ordering(sort: str, has_query: bool = False) -> list[Column]:
    """Feed order; the job id decides between equals."""
    newest, tie = F.col("posted_at").desc_nulls_first(), F.col("job_id").asc()
    if sort == "oldest":
        return [F.col("posted_at").asc_nulls_last(), tie]
    if sort == "salary_desc":
        return [F.col("salary_max").desc_nulls_last(), newest, tie]
    if sort == "salary_asc":
        return [F.col("salary_min").asc_nulls_last(), newest, tie]
    if sort == "relevance" and has_query:
        return [F.col("rank").desc(), newest, tie]
    return [newest, tie]


def page_of(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of the size asked for: a top-k per partition, merged; never a full sort."""
    size = max(1, page_size)
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def first_sources(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each job was first discovered, active or not."""
    first = listings.groupBy("job_id").agg(
        F.min_by("source_slug", F.struct("first_discovered_at", "source_slug")).alias("source_slug")
    )
    named = sources.select(F.col("slug").alias("source_slug"), F.col("display_name").alias("source_name"))
    return first.join(named, "source_slug")


def technology_lists(job_technologies: DataFrame, technologies: DataFrame) -> DataFrame:
    """Technologies per job as a sorted array of ``(slug, name)``."""
    named = technologies.select(F.col("slug").alias("technology"), "display_name")
    return (
        job_technologies.join(named, "technology")
        .groupBy("job_id")
        .agg(F.sort_array(F.collect_list(F.struct("technology", "display_name"))).alias("technologies"))
    )


def with_details(page: DataFrame, tables: Tables) -> DataFrame:
    """Company, first source and technologies of the jobs of one page.

    A page's size is the caller's, so Spark chooses by measured size how its ids meet the large tables.
    """
    ids = page.select("job_id")
    listed = first_sources(tables.listings.join(ids, "job_id", "left_semi"), tables.sources)
    tech = technology_lists(tables.job_technologies.join(ids, "job_id", "left_semi"), tables.technologies)
    company = tables.companies.select(
        F.col("slug").alias("company_slug"), F.col("name").alias("company_name"), "website_url"
    ).join(page.select("company_slug").distinct(), "company_slug", "left_semi")
    none = F.expr("CAST(array() AS array<struct<technology:string,display_name:string>>)")
    return (
        page.join(company, "company_slug")
        .join(listed, "job_id", "left")
        .join(tech, "job_id", "left")
        .withColumn("technologies", F.coalesce("technologies", none))
    )


def search_total(tables: Tables, params: SearchParams, now: Column) -> DataFrame:
    """One row: the number of jobs that satisfy the parameters."""
    return matching_jobs(tables, params, now).agg(F.count("*").alias("total"))


def search(tables: Tables, params: SearchParams, now: Column) -> DataFrame:
    """One page of results, each row with the total of the whole result.

    The total is a scalar subquery over the same predicate: a window over all rows would put
    them into one partition. A page beyond the end has no rows, hence no total.
    """
    found = matching_jobs(tables, params, now)
    has_query = bool(params.q and params.q.strip())
    if has_query:
        # Words are matched and ranked once, for the page and for the total.
        hits = written(found.select("job_id", "rank"))
        found, total = tables.jobs.join(hits, "job_id"), hits.agg(F.count("*").alias("total")).scalar()
    else:
        total = search_total(tables, params, now).scalar()
    page = page_of(found, ordering(params.sort, has_query), params.page, params.page_size)
    return with_details(page, tables).withColumn("total_count", total)


def landing_pages(jobs: DataFrame, presets: list[str], now: Column, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The newest jobs of every preset with their ``place``, in one scan: a job goes to each preset it satisfies.

    Spark keeps the first ``size`` rows of a preset in each partition before it shuffles.
    """
    fits = [F.when(filters.predicate(filters.landing(slug), now), F.lit(slug)) for slug in presets]
    rows = jobs.select("*", F.explode(F.array_compact(F.array(*fits))).alias("preset"))
    place = F.row_number().over(Window.partitionBy("preset").orderBy(*ordering("newest")))
    return rows.withColumn("place", place).filter(F.col("place") <= size)


def company_page(tables: Tables, slug: str, params: SearchParams, now: Column) -> DataFrame:
    """A company's profile with each of its matching jobs, one row without a job where none matches."""
    profile = tables.companies.filter(F.col("slug") == slug).select(
        F.col("slug").alias("company_slug"), F.col("name").alias("company_name"), "website_url"
    )
    jobs = search(tables, replace(params, company_slug=slug), now).drop("company_name", "website_url")
    return profile.join(jobs, "company_slug", "left")


def job_detail(tables: Tables, ids: DataFrame) -> DataFrame:
    """Jobs in full, one row per active listing (or one, where a job has none).

    Listings stay rows: a job that most sources copied has no bound on them. Technologies are
    at most the vocabulary, so they come as an array.
    """
    # A row's date is its listing's; stored jobs have one of their own.
    jobs = tables.jobs.join(ids, "job_id", "left_semi").withColumnRenamed("first_discovered_at", "job_discovered_at")
    keys = jobs.select("job_id")
    if tables.job_texts is not None:
        jobs = jobs.join(tables.job_texts.join(ids, "job_id", "left_semi"), "job_id", "left")
    names = tables.sources.select(F.col("slug").alias("source_slug"), F.col("display_name").alias("source_name"))
    listed = (
        tables.listings.filter("is_active")
        .join(keys, "job_id", "left_semi")
        .join(names, "source_slug")
        .select("job_id", "source_slug", "source_name", "source_url", "first_discovered_at")
    )
    tech = technology_lists(tables.job_technologies.join(keys, "job_id", "left_semi"), tables.technologies)
    company = tables.companies.select(
        F.col("slug").alias("company_slug"), F.col("name").alias("company_name"), "website_url"
    )
    return (
        jobs.join(company, "company_slug").join(tech, "job_id", "left").join(listed, "job_id", "left")
        .orderBy("job_id", "first_discovered_at", "source_url")
    )
