"""Upkeep and look-ups over stored tables of several versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.catalog import Catalog, resolution as RC, sql as S
from vacantia.operators import facets as A
from vacantia.operators import maintenance as M
from vacantia.operators import resolve as R
from vacantia.plans import binding as B
from vacantia.plans import ingest as I
from vacantia.plans.session import scratch_folder, written
from vacantia.plans.tables import SCHEMAS, Tables

catalog = Catalog()


def _full(name: str, rows: DataFrame) -> DataFrame:
    """Rows with all columns of a stored table; those not given are null."""
    wanted = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def _stored(spark: SparkSession, **tables: DataFrame) -> Tables:
    """Tables that hold some rows as their first version."""
    out = Tables(spark, scratch_folder(spark, "stored"))
    out.publish(0, {name: out.write(name, _full(name, rows), 0) for name, rows in tables.items()})
    return out


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


@catalog.add(
    "snk_listing_versions",
    S.with_(S.LISTINGS, RC._UNIQUE, f"""changes AS (SELECT source_slug, CASE WHEN job_id % 7 = 0 THEN external_id || 'n'
          ELSE external_id END AS external_id, job_id + 1 AS job_id, source_url || '?2' AS source_url
        FROM unique_listings WHERE job_id % 2 = 0),
      merged AS (SELECT coalesce(l.source_slug, c.source_slug) AS source_slug, coalesce(l.external_id, c.external_id) AS external_id,
        coalesce(l.job_id, c.job_id) AS job_id, coalesce(c.source_url, l.source_url) AS source_url,
        coalesce(l.first_discovered_at, TIMESTAMP '{RC._NOW}') AS first_discovered_at,
        CASE WHEN c.external_id IS NOT NULL THEN TIMESTAMP '{RC._NOW}' ELSE l.last_seen_at END AS last_seen_at,
        CASE WHEN c.external_id IS NOT NULL THEN true ELSE l.is_active END AS is_active
        FROM unique_listings l FULL JOIN changes c ON c.source_slug = l.source_slug AND c.external_id = l.external_id),
      seen AS (SELECT source_slug, external_id FROM unique_listings WHERE {RC._SEEN})""",
            select="""SELECT m.source_slug, m.external_id, m.job_id, m.source_url,
      strftime(m.first_discovered_at, '%Y-%m-%d') AS first_discovered_at,
      CASE WHEN s.external_id IS NOT NULL THEN '2002-02-01' ELSE strftime(m.last_seen_at, '%Y-%m-%d') END AS last_seen_at,
      CAST(m.is_active OR s.external_id IS NOT NULL AS INTEGER) AS is_active
      FROM merged m LEFT JOIN seen s ON s.source_slug = m.source_slug AND s.external_id = m.external_id"""),
)
def listing_versions(spark, sf):
    """Listings after three versions: what was there, an upsert of half of them, a touch. Each writes what it changes."""
    unique = written(RC._unique_listings(spark, sf))
    tables, job = _stored(spark, listings=unique), F.col("job_id")
    changes = unique.filter(job % 2 == 0).select(
        "source_slug",
        F.when(job % 7 == 0, F.concat("external_id", F.lit("n"))).otherwise(F.col("external_id")).alias("external_id"),
        (job + 1).alias("job_id"), F.concat("source_url", F.lit("?2")).alias("source_url"),
        RC._now().alias("first_discovered_at"), RC._now().alias("last_seen_at"), F.lit(True).alias("is_active"),
    )
    changes = _full("listings", changes)
    tables.publish(1, {"listings": tables.write("listings", M.upsert_listings(tables.lookup("listings", changes, 1), changes), 1)})
    seen = unique.filter(RC._SEEN)
    later = F.expr("TIMESTAMP'2002-02-01 00:00:00'")
    met = tables.lookup("listings", seen, 2)
    touched = M.touch(met, met.select("job_id", "last_seen_at", "is_active").limit(0), seen, later)[0]
    tables.publish(2, {"listings": tables.write("listings", touched, 2)})
    return tables.read("listings").select(
        "source_slug", "external_id", F.col("job_id").cast("long").alias("job_id"), "source_url", _day("first_discovered_at"),
        _day("last_seen_at"), F.col("is_active").cast("int").alias("is_active"),
    )


@catalog.add("snk_company_versions", RC.catalog.sql["snk_company_upsert"])
def company_versions(spark, sf):
    """Companies after a version that looks up those of its postings and writes them back."""
    job = F.col("job_id")
    created = B.jobs(spark, sf).select(
        F.when(job % 10 == 0, F.concat(F.lit("new-"), job.cast("string"))).otherwise(F.col("company_slug")).alias("slug"),
        F.col("title").alias("name"),
        F.when(job % 2 == 1, F.concat(F.lit("https://j"), job.cast("string"), F.lit(".example.com"))).alias("website_url"),
        job.alias("ordinal"),
    )
    tables = _stored(spark, companies=B.companies(spark, sf))
    changed = M.upsert_companies(tables.lookup("companies", created.select("slug"), 1), created)
    tables.publish(1, {"companies": tables.write("companies", changed, 1)})
    return tables.read("companies")


def _swept(spark: SparkSession, sf: str, jobs: DataFrame | None = None) -> Tables:
    """Stored listings and jobs after a sweep."""
    listings = written(RC._unique_listings(spark, sf))
    runs = written(RC._runs_of(listings))
    # As earlier sweeps left them: a job without an active listing is not active.
    jobs = written(_full("jobs", M.sweep(listings, RC._fresh_jobs(spark, sf) if jobs is None else jobs, runs.limit(0))[1]))
    tables = _stored(
        spark, listings=listings, jobs=jobs, job_listings=listings.select("job_id", *M.LISTING), runs=runs,
        facet_counts=A.facet_counts(jobs, A.technologies_of(jobs), _full("listings", listings)),
    )
    I.retire_unseen(tables, 1)
    return tables


@catalog.add("snk_stored_sweep_listings", RC.catalog.sql["snk_sweep_listings"])
def stored_sweep_listings(spark, sf):
    """The sweep over stored tables, which reads what the manifest says can be stale."""
    out = RC._listing_out(_swept(spark, sf).read("listings"))
    return out.withColumn("job_id", F.col("job_id").cast("long"))


@catalog.add("snk_stored_sweep_jobs", RC.catalog.sql["snk_sweep_jobs"])
def stored_sweep_jobs(spark, sf):
    out = RC._job_out(_swept(spark, sf).read("jobs"))
    return out.withColumn("job_id", F.col("job_id").cast("long"))


@catalog.add(
    "agg_facets_stored",
    S.with_(S.LISTINGS, S.JOBS, S.SOURCES, S.JOB_TECHNOLOGIES, S.TECHNOLOGIES, S.ROLES, RC._UNIQUE, RC._SWEPT,
            """active AS MATERIALIZED (SELECT * FROM jobs j WHERE is_active
          AND coalesce((SELECT bool_or(s.is_active) FROM swept s WHERE s.job_id = j.job_id), true))""", select="""
      SELECT 'roleCategory' AS facet, role_category AS value, label, count(*) AS count FROM active
        JOIN role_categories ON slug = role_category GROUP BY ALL
      UNION ALL SELECT 'region', v, v, count(*) FROM (SELECT unnest(eligible_regions) AS v FROM active) x GROUP BY ALL
      UNION ALL SELECT 'country', v, v, count(*) FROM (SELECT unnest(eligible_countries) AS v FROM active) x
        WHERE v <> 'US' GROUP BY ALL
      UNION ALL SELECT 'seniority', seniority, seniority, count(*) FROM active WHERE seniority IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'technology', technology, display_name, count(*) FROM job_technologies JOIN active USING (job_id)
        JOIN technologies ON slug = technology GROUP BY ALL
      UNION ALL SELECT 'employmentType', employment_type, employment_type, count(*) FROM active
        WHERE employment_type IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'source', source_slug, display_name, count(DISTINCT a.job_id) FROM swept l
        JOIN active a ON a.job_id = l.job_id JOIN sources ON slug = source_slug WHERE l.is_active GROUP BY ALL"""),
)
def facets_stored(spark, sf):
    """Facets after a sweep: the counts of the version before and what the sweep took from them."""
    used = B.job_technologies(spark, sf).groupBy("job_id").agg(F.collect_set("technology").alias("technologies"))
    jobs = B.jobs(spark, sf).drop("last_seen_at", "technologies").join(used, "job_id", "left")
    return I.stored_facets(_swept(spark, sf, jobs))


@catalog.add(
    "joi_known_ids_stored",
    S.with_(S.POSTINGS, RC._CAPTURED, f"""wanted AS (SELECT doc_id, source_slug, external_id,
        CASE WHEN doc_id % 2 = 0 THEN 'site' ELSE source_slug END AS source FROM postings),
      kept AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'site' ELSE source_slug END AS source, external_id, status, doc_id FROM captured),
      known AS (SELECT DISTINCT source, external_id FROM kept WHERE CASE WHEN source = 'site'
        THEN status = 'MERGED_DUPLICATE' OR (status IN ({RC._TERMINAL}) AND doc_id % 4 = 2) ELSE status IN ({RC._TERMINAL}) END)""",
            select="""SELECT w.doc_id, CASE WHEN k.external_id IS NOT NULL THEN 'known' ELSE 'new' END AS side
      FROM wanted w LEFT JOIN known k ON k.source = w.source AND k.external_id = w.external_id"""),
)
def known_ids_stored(spark, sf):
    """Discovered ids against stored captures and listings: one source wants its second parser version, others none."""
    doc = F.col("doc_id")
    source = F.when(doc % 2 == 0, "site").otherwise(F.col("source_slug"))
    captured = RC._captured(spark, sf).withColumns({"source_slug": source, "parser_version": doc % 4})
    tables = _stored(spark, captures=captured, listings=captured.filter("status = 'MERGED_DUPLICATE'"))
    found = B.raw_postings(spark, sf).select("doc_id", source.alias("source_slug"), "external_id")
    seen, new = M.split_known(found, I.known_ids(tables, found, {"site": 2}))
    return seen.select("doc_id", F.lit("known").alias("side")).unionByName(new.select("doc_id", F.lit("new").alias("side")))


@catalog.add(
    "joi_stored_blocks",
    S.with_(S.JOBS, select="""SELECT job_id, company_slug AS company_key, normalized_title AS title,
      CAST(is_active AS INTEGER) AS is_active FROM jobs
      WHERE CAST(substr(company_slug, 10) AS BIGINT) % 53 = 7 AND posted_at >= DATE '1995-01-01'"""),
)
def stored_blocks(spark, sf):
    """The jobs that postings of some companies can meet, from the stored profiles of those companies."""
    jobs = B.jobs(spark, sf)
    profiles = R.with_profile(jobs.withColumns({"company_name": F.col("company_slug"), "apply_url": F.lit(None).cast("string")}))
    profiles = profiles.withColumns({"company_key": F.col("company_slug"), "first_discovered_at": F.col("posted_at")})
    tables = _stored(spark, blocks=profiles, jobs=jobs)
    asked = B.companies(spark, sf).select(F.col("slug").alias("company_key")).filter("CAST(substr(company_key, 10) AS BIGINT) % 53 = 7")
    # The window's first day, for jobs as old as the orders are.
    now = F.expr(f"TIMESTAMP'1995-01-01 00:00:00' + INTERVAL {D.CANDIDATE_WINDOW_DAYS} DAYS")
    blocks = R.within_window(tables.lookup("blocks", asked), now)
    states = tables.lookup("jobs", blocks.select("job_id")).select("job_id", F.col("is_active").cast("int").alias("is_active"))
    return blocks.join(states, "job_id").select(F.col("job_id").cast("long").alias("job_id"), "company_key", "title", "is_active")
