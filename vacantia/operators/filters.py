"""Search parameters and the predicates they stand for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.columns import string_array


@dataclass(frozen=True)
class SearchParams:
    """What a search may ask for; an empty field asks for nothing."""

    q: str | None = None
    company_slug: str | None = None
    role_category: Sequence[str] = ()
    region: Sequence[str] = ()
    country: Sequence[str] = ()
    country_or_worldwide: Sequence[str] = ()
    region_only: bool = False
    seniority: Sequence[str] = ()
    technology: Sequence[str] = ()
    employment_type: Sequence[str] = ()
    remote_type: Sequence[str] = ()
    salary_min: int | None = None
    salary_max: int | None = None
    posted_within_hours: int | None = None
    source_slug: Sequence[str] = ()
    exclude_source_slug: Sequence[str] = ()
    sort: str = "newest"
    page: int = 1
    page_size: int = 20


def for_tab(params: SearchParams, tab: str) -> SearchParams:
    """What a tab of the feed adds to the parameters."""
    if tab == "usRemote":
        return replace(
            params, region=(), country=(), country_or_worldwide=["US"], remote_type=["FULLY_REMOTE"]
        )
    return replace(
        params,
        region=params.region or D.DEFAULT_REGIONS,
        country_or_worldwide=(),
        remote_type=(),
        region_only=tab == "regionOnly",
    )


def landing(slug: str) -> SearchParams:
    """A saved landing query: newest first, twenty to a page."""
    return SearchParams(**D.LANDING_PRESETS[slug])


def _overlaps(column: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(column), string_array(list(values)))


def predicate(params: SearchParams, now: Column) -> Column:
    """The row predicate of all filters that a job row alone can answer."""
    terms = [F.col("is_active")]
    if params.company_slug:
        terms.append(F.col("company_slug") == params.company_slug)
    for field in ("role_category", "seniority", "employment_type", "remote_type"):
        wanted = getattr(params, field)
        if wanted:
            terms.append(F.col(field).isin(list(wanted)))
    if params.region:
        terms.append(_overlaps("eligible_regions", params.region))
    if params.country:
        terms.append(_overlaps("eligible_countries", params.country))
    if params.country_or_worldwide:
        terms.append(
            _overlaps("eligible_countries", params.country_or_worldwide)
            | F.array_contains("eligible_regions", "WORLDWIDE")
        )
    if params.region_only:
        terms.append(F.size("eligible_countries") == 0)
    if params.salary_min is not None:
        terms.append(F.col("salary_max") >= params.salary_min)
    if params.salary_max is not None:
        terms.append(F.col("salary_min") <= params.salary_max)
    if params.posted_within_hours is not None:
        terms.append(F.col("posted_at") >= now - F.expr(f"INTERVAL {int(params.posted_within_hours)} HOURS"))
    out = terms[0]
    for term in terms[1:]:
        out = out & term
    return out


def with_any_technology(jobs: DataFrame, job_technologies: DataFrame, slugs: Sequence[str]) -> DataFrame:
    wanted = job_technologies.filter(F.col("technology").isin(list(slugs))).select("job_id")
    return jobs.join(wanted, "job_id", "left_semi")


def _listed_at(listings: DataFrame, slugs: Sequence[str]) -> DataFrame:
    return listings.filter(F.col("is_active") & F.col("source_slug").isin(list(slugs))).select("job_id")


def from_sources(jobs: DataFrame, listings: DataFrame, slugs: Sequence[str]) -> DataFrame:
    return jobs.join(_listed_at(listings, slugs), "job_id", "left_semi")


def not_from_sources(jobs: DataFrame, listings: DataFrame, slugs: Sequence[str]) -> DataFrame:
    return jobs.join(_listed_at(listings, slugs), "job_id", "left_anti")
