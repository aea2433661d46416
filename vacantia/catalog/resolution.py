"""Deduplication, reconciliation and table upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.catalog import Catalog, classify as CC, sql as S
from vacantia.functions import classify as C
from vacantia.operators import maintenance as M
from vacantia.operators import resolve as R
from vacantia.plans import binding as B
from vacantia.plans import classify as P
from vacantia.plans import ingest as I
from vacantia.plans import seed as SD
from vacantia.plans.session import passing, shared_folder, written
from vacantia.plans.tables import no_rows

catalog = Catalog()


def _sides(spark, sf, *wide):
    """On-topic postings as both sides: each meets the ones that came before it. Profiles are written once."""
    rows = P.classify(B.raw_postings(spark, sf)).withColumns(
        {"company_key": F.lower("company_name"), "born": R.after_all(F.col("doc_id"))}
    )
    rows = written(R.with_profile(rows).select("doc_id", "company_key", "born", *wide, *R.PROFILE))
    return rows, rows.withColumnRenamed("doc_id", "job_id").withColumn("since", F.col("job_id"))


_PROFILES = f"""named AS MATERIALIZED (SELECT t.doc_id, lower(t.company_name) AS company_key,
    {S.company_norm('t.company_name')} AS company, {S.normalized_title('t.raw_title', 'role', 't.seniority')} AS title,
    {S.apply_url('t.apply_url')} AS url, x.description_text, v.codes, v.regions
  FROM titles t JOIN verdicts v USING (doc_id) JOIN texts x USING (doc_id) WHERE role <> 'OTHER'),
padded AS MATERIALIZED (SELECT *, {S.padded('title')} AS ptitle, {S.padded('description_text')} AS ptext FROM named),
profiles AS MATERIALIZED (SELECT *, {S.word_grams('title')} AS wgrams, {S.dice_grams('ptitle')} AS tgrams,
    {S.dice_grams('ptext')} AS dgrams FROM padded)"""
_CANDIDATES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, job_id) - 1 AS place
  FROM (SELECT p.doc_id, j.doc_id AS job_id, len(list_intersect(p.wgrams, j.wgrams)) /
      len(list_distinct(list_concat(p.wgrams, j.wgrams))) AS similarity
    FROM profiles p JOIN profiles j ON j.company_key = p.company_key AND j.doc_id < p.doc_id) x
  WHERE similarity > 0.4),
candidates AS MATERIALIZED (SELECT * FROM ranked WHERE place < 20)"""
_NARROW = "len({0}.codes) BETWEEN 1 AND 2"
_SCORES = f"""compared AS MATERIALIZED (SELECT c.doc_id, c.job_id, c.place,
    {_NARROW.format('p')} AND {_NARROW.format('j')} AND NOT list_has_any(p.codes, j.codes) AS vetoed,
    list_contains(p.regions, 'WORLDWIDE') OR list_contains(j.regions, 'WORLDWIDE') OR list_has_any(p.codes, j.codes)
      OR list_has_any(p.regions, j.regions) AS near,
    p.url = j.url AS same_url, p.company = j.company AS same_company, lower(p.title) = lower(j.title) AS same_title,
    {S.dice('p.tgrams', 'j.tgrams')} AS title_dice,
    CASE WHEN len(p.dgrams) = 4 AND trim(p.description_text) = '' THEN 0.0 ELSE {S.dice('p.dgrams', 'j.dgrams')} END AS text_dice
  FROM candidates c JOIN profiles p ON p.doc_id = c.doc_id JOIN profiles j ON j.doc_id = c.job_id),
scored AS MATERIALIZED (SELECT *, CASE WHEN NOT vetoed THEN CASE WHEN same_url THEN 100 ELSE 0 END
    + CASE WHEN same_company THEN 40 ELSE 0 END + CASE WHEN same_title OR title_dice >= 0.85 THEN 30 ELSE 0 END
    + CASE WHEN text_dice >= 0.6 THEN 25 ELSE 0 END + CASE WHEN near THEN 10 ELSE 0 END END AS score FROM compared)"""
_PAIR_CTES = (*CC._GEO_CTES, CC._VERDICT, CC._TITLES, _PROFILES, _CANDIDATES)


@catalog.add(
    "joi_dedup_candidates",
    S.with_(*_PAIR_CTES, select="SELECT doc_id, job_id, CAST(place AS INTEGER) AS place, round(similarity, 9) AS similarity FROM candidates"),
)
def dedup_candidates(spark, sf):
    postings, leaders = _sides(spark, sf)
    return R.candidate_pairs(postings, leaders).select(
        "doc_id", "job_id", "place", F.round("title_similarity", 9).alias("similarity")
    )


@catalog.add(
    "win_best_candidates",
    S.with_(*_PAIR_CTES, select="""SELECT doc_id, count(*) AS candidates, arg_min(job_id, place) AS first_job
      FROM candidates GROUP BY doc_id"""),
)
def best_candidates(spark, sf):
    postings, leaders = _sides(spark, sf)
    return R.candidate_pairs(postings, leaders).groupBy("doc_id").agg(
        F.count("*").alias("candidates"), F.min_by("job_id", "place").alias("first_job")
    )


def _scored(spark, sf):
    postings, leaders = _sides(spark, sf, "grams")
    return R.scored_pairs(postings, leaders, "doc_id")


@catalog.add(
    "ded_location_rules",
    S.with_(*_PAIR_CTES, _SCORES, select="""SELECT doc_id, job_id, CAST(vetoed AS INTEGER) AS vetoed,
      CAST(near AS INTEGER) AS compatible FROM compared"""),
)
def location_rules(spark, sf):
    postings, leaders = _sides(spark, sf)
    pairs = R.profile_pairs(postings, leaders, "doc_id")
    return pairs.select(
        "doc_id", "job_id", R.is_vetoed().cast("int").alias("vetoed"), R.is_compatible().cast("int").alias("compatible")
    )


@catalog.add(
    "ded_pair_scores",
    S.with_(*_PAIR_CTES, _SCORES, select="SELECT doc_id, job_id, CAST(vetoed AS INTEGER) AS vetoed, score FROM scored"),
)
def pair_scores(spark, sf):
    return _scored(spark, sf).select("doc_id", "job_id", F.col("vetoed").cast("int").alias("vetoed"), "score")


@catalog.add(
    "ded_best_match",
    S.with_(*_PAIR_CTES, _SCORES, """best AS (SELECT *, row_number() OVER (PARTITION BY doc_id
        ORDER BY score DESC NULLS LAST, place) AS rn, count(*) FILTER (vetoed) OVER (PARTITION BY doc_id) AS n FROM scored)""",
            select="""SELECT doc_id, CASE WHEN score >= 70 THEN 'MERGE' ELSE 'CREATE_NEW' END AS action,
      CASE WHEN score >= 70 THEN job_id END AS job_id, coalesce(score, 0) AS score, n AS vetoed FROM best WHERE rn = 1"""),
)
def best_match(spark, sf):
    postings, leaders = _sides(spark, sf, "grams")
    return R.match(postings, leaders, "doc_id").select(
        "doc_id", "action", "job_id", "score", F.size("vetoed").cast("bigint").alias("vetoed")
    )


def _resolved(spark, sf):
    # What classification and resolution read; the other derived fields are not computed.
    read = ["doc_id", *M.LISTING, "company_name", "apply_url", "raw_title", "raw_location", "description", "remote_type",
            "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period"]
    with passing(spark) as step:
        pending = step.kept(P.classify(P.spread(B.raw_postings(spark, sf).select(*read))).filter("status = 'PENDING'").select(
            "doc_id", F.col("doc_id").alias("ordinal"), *M.LISTING, "company_name", "company_slug", "normalized_title", "apply_url",
            "description_text", "eligible_countries", "eligible_regions",
        ))
    empty = no_rows(spark)
    now = F.timestamp_seconds(F.lit(B.NOW_EPOCH))
    return I.resolve(pending, empty["jobs"], empty["companies"], empty["listings"], now)


@catalog.add("ded_batch_resolution")
def batch_resolution(spark, sf):
    return _resolved(spark, sf).select("doc_id", "outcome", "job_id", "score", F.array_join("reasons", "; ").alias("reasons"))


@catalog.add("ded_batch_tables")
def batch_tables(spark, sf):
    """A whole batch applied to empty tables: the jobs after it."""
    raw = M.with_checksum(B.raw_postings(spark, sf)).withColumns(
        {"ordinal": F.col("doc_id"), "run_id": F.concat(F.lit("run-"), F.col("source_slug"))}
    )
    empty = no_rows(spark)
    captured = spark.createDataFrame([], "source_slug string, external_id string, checksum string, status string, error string")
    now = F.timestamp_seconds(F.lit(B.NOW_EPOCH))
    batch = I.apply_batch(raw, captured, empty["jobs"], empty["companies"], empty["listings"], now)
    return batch.jobs.select("job_id", "title", "company_slug", "posted_at_is_inferred", "salary_min", "salary_max")


# --- reconciliation ---------------------------------------------------------------------


_OFFERS = """offers AS MATERIALIZED (SELECT job_id, ordinal, posted_at, low AS salary_min,
    CASE WHEN ordinal % 2 = 0 THEN low + 500 END AS salary_max, CASE WHEN low IS NOT NULL THEN 'USD' END AS salary_currency,
    CASE WHEN ordinal % 5 = 0 THEN 'MONTHLY' END AS salary_period
  FROM (SELECT l_orderkey AS job_id, l_orderkey * 7 + l_linenumber AS ordinal,
      CASE WHEN l_returnflag <> 'A' THEN l_shipdate END AS posted_at,
      CASE WHEN (l_orderkey * 7 + l_linenumber) % 3 <> 0 THEN CAST(floor(l_extendedprice / 10) AS INTEGER) END AS low,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) x
  WHERE rn = 1)"""
_STORED = """stored AS (SELECT job_id, posted_at, posted_at_is_inferred, salary_min,
  CASE WHEN job_id % 4 <> 0 THEN salary_max END AS salary_max, salary_currency,
  CASE WHEN job_id % 9 <> 0 THEN salary_period END AS salary_period FROM jobs)"""


def _stored(spark, sf):
    return B.jobs(spark, sf).select(
        "job_id", "posted_at", "posted_at_is_inferred", "salary_min",
        F.when(F.col("job_id") % 4 != 0, F.col("salary_max")).alias("salary_max"), "salary_currency",
        F.when(F.col("job_id") % 9 != 0, F.col("salary_period")).alias("salary_period"),
    )


_FIELDS = ["posted_at_is_inferred", "salary_min", "salary_max", "salary_currency", "salary_period"]


def _reconciled(df, *keys):
    return df.select(
        *keys, F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"),
        F.col("posted_at_is_inferred").cast("int").alias("posted_at_is_inferred"), *_FIELDS[1:],
    )


_TAKE = "o.posted_at IS NOT NULL AND (s.posted_at_is_inferred OR o.posted_at < s.posted_at)"
_FULL = "s.salary_min IS NOT NULL AND s.salary_max IS NOT NULL"


@catalog.add(
    "ded_reconcile_pair",
    S.with_(S.JOBS, _OFFERS, _STORED, select=f"""SELECT s.job_id, o.ordinal,
      strftime(CASE WHEN {_TAKE} THEN o.posted_at ELSE s.posted_at END, '%Y-%m-%d %H:%M:%S') AS posted_at,
      CAST(CASE WHEN {_TAKE} THEN false ELSE s.posted_at_is_inferred END AS INTEGER) AS posted_at_is_inferred,
      {', '.join(f'CASE WHEN {_FULL} THEN s.{c} ELSE o.{c} END AS {c}' for c in _FIELDS[1:])}
      FROM stored s JOIN offers o USING (job_id)"""),
)
def reconcile_pair(spark, sf):
    names = ["posted_at", *R.SALARY]
    offers = _unique_offers(spark, sf).select("job_id", "ordinal", *[F.col(c).alias(f"new_{c}") for c in names])
    pairs = _stored(spark, sf).join(offers, "job_id")
    return _reconciled(R.reconcile(pairs, F.expr("TIMESTAMP_NTZ'2001-08-01 00:00:00'")), "job_id", "ordinal")


def _unique_offers(spark, sf):
    """One line item per order and line: the first by part and supplier."""
    window = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    items = B.read(spark, sf, "lineitem").withColumn("rn", F.row_number().over(window)).filter("rn = 1")
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    low = F.when(n % 3 != 0, F.floor(F.col("l_extendedprice") / 10).cast("int"))
    return items.select(
        F.col("l_orderkey").alias("job_id"), n.alias("ordinal"),
        F.when(F.col("l_returnflag") != "A", F.col("l_shipdate")).alias("posted_at"),
        low.alias("salary_min"), F.when(n % 2 == 0, low + 500).alias("salary_max"),
        F.when(low.isNotNull(), "USD").alias("salary_currency"),
        F.when(n % 5 == 0, "MONTHLY").alias("salary_period"),
    )


@catalog.add(
    "ded_reconcile_all",
    S.with_(S.JOBS, _OFFERS, _STORED, """folded AS (SELECT job_id, min(posted_at) AS low_date,
        coalesce(min(ordinal) FILTER (salary_min IS NOT NULL AND salary_max IS NOT NULL), max(ordinal)) AS upto
        FROM offers GROUP BY job_id)""",
            select="""SELECT s.job_id, strftime(CASE WHEN NOT s.posted_at_is_inferred THEN least(s.posted_at, f.low_date)
        ELSE coalesce(f.low_date, s.posted_at) END, '%Y-%m-%d %H:%M:%S') AS posted_at,
      CAST(s.posted_at_is_inferred AND f.low_date IS NULL AS INTEGER) AS posted_at_is_inferred,
      CASE WHEN keep THEN s.salary_min ELSE o.salary_min END AS salary_min,
      CASE WHEN keep THEN s.salary_max ELSE o.salary_max END AS salary_max,
      CASE WHEN keep THEN s.salary_currency ELSE o.salary_currency END AS salary_currency,
      CASE WHEN keep THEN s.salary_period ELSE coalesce((SELECT arg_max(salary_period, ordinal) FROM offers q
        WHERE q.job_id = s.job_id AND q.ordinal <= f.upto AND q.salary_period IS NOT NULL), s.salary_period) END AS salary_period
      FROM (SELECT *, salary_min IS NOT NULL AND salary_max IS NOT NULL
          OR job_id NOT IN (SELECT job_id FROM offers) AS keep FROM stored) s
      LEFT JOIN folded f USING (job_id) LEFT JOIN offers o ON o.job_id = s.job_id AND o.ordinal = f.upto"""),
)
def reconcile_all(spark, sf):
    out = R.reconcile_all(
        _stored(spark, sf), _unique_offers(spark, sf), F.expr("TIMESTAMP_NTZ'2001-08-01 00:00:00'")
    )
    return _reconciled(out, "job_id")


@catalog.add(
    "ded_running_dates",
    S.with_(S.JOBS, _OFFERS, _STORED, """run AS (SELECT o.job_id, o.ordinal, s.posted_at AS job_at,
        coalesce(s.posted_at_is_inferred, true) AS inferred,
        min(o.posted_at) OVER (PARTITION BY o.job_id ORDER BY o.ordinal ROWS UNBOUNDED PRECEDING) AS seen
        FROM offers o LEFT JOIN stored s USING (job_id))""",
            select="""SELECT job_id, ordinal, strftime(CASE WHEN NOT inferred THEN least(job_at, seen)
        ELSE coalesce(seen, job_at) END, '%Y-%m-%d %H:%M:%S') AS listed_at,
      CAST(inferred AND seen IS NULL AS INTEGER) AS inferred FROM run"""),
)
def running_dates(spark, sf):
    out = R.running_dates(
        _unique_offers(spark, sf), _stored(spark, sf), F.expr("TIMESTAMP_NTZ'2001-08-01 00:00:00'"), chunk=3
    )
    return out.select(
        "job_id", "ordinal", F.date_format("listed_at", "yyyy-MM-dd HH:mm:ss").alias("listed_at"),
        F.col("listed_at_is_inferred").cast("int").alias("inferred"),
    )


# --- capture ----------------------------------------------------------------------------

_STATUSES = ["PUBLISHED", "PENDING", "REJECTED_GEOGRAPHY", "FAILED", "MERGED_DUPLICATE", "REJECTED_ROLE_CATEGORY"]


def _captured(spark, sf):
    """Earlier captures: two of three documents, some with other content then."""
    doc = F.col("doc_id")
    rows = M.with_checksum(B.raw_postings(spark, sf)).filter(doc % 3 != 0)
    return rows.select(
        "doc_id", "source_slug", "external_id", "raw_payload",
        F.when(doc % 5 == 0, F.lit("old")).otherwise(F.col("checksum")).alias("checksum"),
        B.pick(_STATUSES, doc).alias("status"),
    )


_CAPTURED = f"""captured AS (SELECT doc_id, source_slug, external_id, raw_payload,
  CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(raw_payload) END AS checksum,
  {S.pick(_STATUSES, 'doc_id')} AS status FROM postings WHERE doc_id % 3 <> 0)"""
_TERMINAL = ", ".join(S.lit(s) for s in D.TERMINAL_STATUSES)


@catalog.add(
    "joi_capture_change",
    S.with_(S.POSTINGS, _CAPTURED, select=f"""SELECT p.doc_id, CASE WHEN c.status IN ({_TERMINAL}) THEN 'UNCHANGED'
      WHEN c.status IS NOT NULL THEN 'RETRY' WHEN EXISTS (SELECT 1 FROM captured k
        WHERE k.source_slug = p.source_slug AND k.external_id = p.external_id) THEN 'CHANGED' ELSE 'NEW' END AS change
      FROM postings p LEFT JOIN captured c ON c.source_slug = p.source_slug AND c.external_id = p.external_id
        AND c.checksum = sha256(p.raw_payload)"""),
)
def capture_change(spark, sf):
    rows = M.with_checksum(B.raw_postings(spark, sf))
    return M.with_change(rows, _captured(spark, sf)).select("doc_id", "change")


@catalog.add(
    "joi_known_ids",
    S.with_(S.POSTINGS, _CAPTURED, f"""known AS (SELECT DISTINCT source_slug, external_id FROM captured
        WHERE status IN ({_TERMINAL}))""",
            select="""SELECT p.doc_id, CASE WHEN k.external_id IS NOT NULL THEN 'known' ELSE 'new' END AS side
      FROM postings p LEFT JOIN known k ON k.source_slug = p.source_slug AND k.external_id = p.external_id"""),
)
def known_ids(spark, sf):
    found = B.raw_postings(spark, sf).select("doc_id", "source_slug", "external_id")
    known = M.known_ids(_captured(spark, sf), found)
    seen, new = M.split_known(found, known)
    return seen.select("doc_id", F.lit("known").alias("side")).unionByName(new.select("doc_id", F.lit("new").alias("side")))


@catalog.add(
    "joi_known_ids_version",
    S.with_(S.POSTINGS, _CAPTURED, f"""known AS (SELECT DISTINCT source_slug, external_id FROM captured
        WHERE status = 'MERGED_DUPLICATE' OR (status IN ({_TERMINAL}) AND doc_id % 4 = 2))""",
            select="""SELECT p.doc_id, CASE WHEN k.external_id IS NOT NULL THEN 'known' ELSE 'new' END AS side
      FROM postings p LEFT JOIN known k ON k.source_slug = p.source_slug AND k.external_id = p.external_id"""),
)
def known_ids_version(spark, sf):
    """Listed ids are known whatever their parser, others if the second version parsed them."""
    found = B.raw_postings(spark, sf).select("doc_id", "source_slug", "external_id")
    version = F.to_json(F.struct((F.col("doc_id") % 4).alias("parserVersion")))
    captured = _captured(spark, sf).withColumn("raw_payload", version)
    known = M.known_ids(captured, captured.filter("status = 'MERGED_DUPLICATE'"), 2)
    seen, new = M.split_known(found, known)
    return seen.select("doc_id", F.lit("known").alias("side")).unionByName(new.select("doc_id", F.lit("new").alias("side")))


@catalog.add(
    "snk_raw_capture",
    S.with_(S.POSTINGS, select="SELECT source_slug, external_id, sha256(raw_payload) AS checksum, 'PENDING' AS status FROM postings"),
)
def raw_capture(spark, sf):
    return M.with_checksum(B.raw_postings(spark, sf)).select(
        "source_slug", "external_id", "checksum", F.lit("PENDING").alias("status")
    )


def _log(spark, sf):
    return B.read(spark, sf, "events").select(
        B.pick(B.SOURCE_SLUGS, F.col("user_id")).alias("source_slug"),
        F.col("user_id").cast("string").alias("external_id"),
        F.col("event_type").alias("checksum"),
        B.pick(_STATUSES, F.col("event_id")).alias("status"),
        F.when(F.col("event_id") % 6 == 3, F.col("props")).alias("error"),
        F.col("ts").alias("logged_at"), F.col("event_id").alias("sequence"),
    )


@catalog.add(
    "snk_status_log",
    f"""SELECT source_slug, external_id, checksum, status, error FROM (SELECT
        {S.pick(B.SOURCE_SLUGS, 'user_id')} AS source_slug, CAST(user_id AS VARCHAR) AS external_id,
        event_type AS checksum, {S.pick(_STATUSES, 'event_id')} AS status,
        CASE WHEN event_id % 6 = 3 THEN props END AS error,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) x
      WHERE rn = 1""",
)
def status_log(spark, sf):
    return M.latest_status(_log(spark, sf))


# --- upserts and freshness --------------------------------------------------------------


@catalog.add(
    "snk_company_upsert",
    S.with_(S.COMPANIES, S.JOBS, """created AS (SELECT company_slug AS slug,
        arg_min(title, job_id) AS name, max(job_id) FILTER (job_id % 2 = 1) AS url_job FROM (SELECT
          CASE WHEN job_id % 10 = 0 THEN 'new-' || job_id ELSE company_slug END AS company_slug, title, job_id FROM jobs) j
        GROUP BY 1)""",
            select="""SELECT coalesce(c.slug, n.slug) AS slug, coalesce(c.name, n.name) AS name,
      coalesce('https://j' || n.url_job || '.example.com', c.website_url) AS website_url
      FROM companies c FULL JOIN created n ON n.slug = c.slug"""),
)
def company_upsert(spark, sf):
    job = F.col("job_id")
    created = B.jobs(spark, sf).select(
        F.when(job % 10 == 0, F.concat(F.lit("new-"), job.cast("string"))).otherwise(F.col("company_slug")).alias("slug"),
        F.col("title").alias("name"),
        F.when(job % 2 == 1, F.concat(F.lit("https://j"), job.cast("string"), F.lit(".example.com"))).alias("website_url"),
        job.alias("ordinal"),
    )
    return M.upsert_companies(B.companies(spark, sf), created)


def _unique_listings(spark, sf):
    """Listings by key; a line item that repeats a key gives way to the first."""
    key = F.struct("job_id", "first_discovered_at", "source_slug", "is_active")
    return B.listings(spark, sf).groupBy("source_slug", "external_id").agg(
        F.min_by(F.struct("job_id", "source_url", "first_discovered_at", "last_seen_at", "is_active"), key).alias("l")
    ).select("source_slug", "external_id", "l.*")


_UNIQUE = """unique_listings AS MATERIALIZED (SELECT source_slug, external_id, job_id, source_url, first_discovered_at,
    last_seen_at, is_active FROM (SELECT *, row_number() OVER (PARTITION BY source_slug, external_id
      ORDER BY job_id, first_discovered_at, is_active) AS rn FROM listings) x WHERE rn = 1)"""
_LISTING_OUT = """SELECT source_slug, external_id, job_id, source_url,
  strftime(first_discovered_at, '%Y-%m-%d') AS first_discovered_at, strftime(last_seen_at, '%Y-%m-%d') AS last_seen_at,
  CAST(is_active AS INTEGER) AS is_active"""


def _listing_out(df):
    return df.select(
        "source_slug", "external_id", "job_id", "source_url",
        *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_discovered_at", "last_seen_at")],
        F.col("is_active").cast("int").alias("is_active"),
    )


_NOW = "2002-01-01"


def _now():
    return F.expr(f"TIMESTAMP_NTZ'{_NOW} 00:00:00'")


@catalog.add(
    "snk_listing_upsert",
    S.with_(S.LISTINGS, _UNIQUE, f"""changes AS (SELECT source_slug, CASE WHEN job_id % 7 = 0 THEN external_id || 'n'
          ELSE external_id END AS external_id, job_id + 1 AS job_id, source_url || '?2' AS source_url
        FROM unique_listings WHERE job_id % 2 = 0),
      merged AS (SELECT coalesce(l.source_slug, c.source_slug) AS source_slug, coalesce(l.external_id, c.external_id) AS external_id,
        coalesce(l.job_id, c.job_id) AS job_id, coalesce(c.source_url, l.source_url) AS source_url,
        coalesce(l.first_discovered_at, TIMESTAMP '{_NOW}') AS first_discovered_at,
        CASE WHEN c.external_id IS NOT NULL THEN TIMESTAMP '{_NOW}' ELSE l.last_seen_at END AS last_seen_at,
        CASE WHEN c.external_id IS NOT NULL THEN true ELSE l.is_active END AS is_active
        FROM unique_listings l FULL JOIN changes c ON c.source_slug = l.source_slug AND c.external_id = l.external_id)""",
            select=f"{_LISTING_OUT} FROM merged"),
)
def listing_upsert(spark, sf):
    stored = _unique_listings(spark, sf)
    job = F.col("job_id")
    changes = stored.filter(job % 2 == 0).select(
        "source_slug",
        F.when(job % 7 == 0, F.concat("external_id", F.lit("n"))).otherwise(F.col("external_id")).alias("external_id"),
        (job + 1).alias("job_id"), F.concat("source_url", F.lit("?2")).alias("source_url"),
        _now().alias("first_discovered_at"), _now().alias("last_seen_at"), F.lit(True).alias("is_active"),
    )
    return _listing_out(M.upsert_listings(stored, changes))


_SEEN = "(job_id * 31) % 11 < 4"


@catalog.add(
    "snk_touch",
    S.with_(S.LISTINGS, _UNIQUE, select=f"""{_LISTING_OUT} FROM (SELECT source_slug, external_id, job_id, source_url,
      first_discovered_at, CASE WHEN {_SEEN} THEN TIMESTAMP '{_NOW}' ELSE last_seen_at END AS last_seen_at,
      is_active OR {_SEEN} AS is_active FROM unique_listings) x"""),
)
def touch(spark, sf):
    stored = _unique_listings(spark, sf)
    seen = stored.filter(_SEEN)
    return _listing_out(M.touch(stored, _fresh_jobs(spark, sf), seen, _now())[0])


def _fresh_jobs(spark, sf):
    return B.jobs(spark, sf).select("job_id", F.col("posted_at").alias("last_seen_at"), "is_active")


_JOB_OUT = "SELECT job_id, strftime(last_seen_at, '%Y-%m-%d') AS last_seen_at, CAST(is_active AS INTEGER) AS is_active"


def _job_out(df):
    return df.select(
        "job_id", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen_at"), F.col("is_active").cast("int").alias("is_active")
    )


@catalog.add(
    "snk_touch_jobs",
    S.with_(S.LISTINGS, S.JOBS, _UNIQUE, f"seen AS (SELECT DISTINCT job_id FROM unique_listings WHERE {_SEEN})",
            select=f"""{_JOB_OUT} FROM (SELECT j.job_id, CASE WHEN s.job_id IS NOT NULL THEN TIMESTAMP '{_NOW}'
        ELSE posted_at END AS last_seen_at, is_active OR s.job_id IS NOT NULL AS is_active
        FROM jobs j LEFT JOIN seen s USING (job_id)) x"""),
)
def touch_jobs(spark, sf):
    stored = _unique_listings(spark, sf)
    return _job_out(M.touch(stored, _fresh_jobs(spark, sf), stored.filter(_SEEN), _now())[1])


def _runs(spark, sf):
    """Per source one successful and one partial run, by its listings' dates."""
    return _runs_of(_unique_listings(spark, sf))


def _runs_of(listings):
    per = listings.groupBy("source_slug").agg(F.min("last_seen_at").alias("low"), F.max("last_seen_at").alias("high"))
    even = F.length("source_slug") % 2 == 0
    middle = F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'")
    return per.select("source_slug", middle.alias("started_at"), F.when(even, "SUCCESS").otherwise("PARTIAL").alias("status"))


_SWEPT = """swept AS MATERIALIZED (SELECT source_slug, external_id, job_id, source_url, first_discovered_at, last_seen_at,
    is_active AND NOT (length(source_slug) % 2 = 0 AND last_seen_at < TIMESTAMP '1998-06-01') AS is_active FROM unique_listings)"""


@catalog.add(
    "snk_sweep_listings",
    S.with_(S.LISTINGS, _UNIQUE, _SWEPT, select=f"{_LISTING_OUT} FROM swept"),
)
def sweep_listings(spark, sf):
    return _listing_out(M.sweep(_unique_listings(spark, sf), _fresh_jobs(spark, sf), _runs(spark, sf))[0])


@catalog.add(
    "snk_sweep_jobs",
    S.with_(S.LISTINGS, S.JOBS, _UNIQUE, _SWEPT, select=f"""{_JOB_OUT} FROM (SELECT job_id, posted_at AS last_seen_at,
      is_active AND coalesce((SELECT bool_or(s.is_active) FROM swept s WHERE s.job_id = j.job_id), true) AS is_active FROM jobs j) x"""),
)
def sweep_jobs(spark, sf):
    return _job_out(M.sweep(_unique_listings(spark, sf), _fresh_jobs(spark, sf), _runs(spark, sf))[1])


@catalog.add(
    "snk_vocabulary_use",
    S.with_(S.POSTINGS, CC._TITLES, S.values("vocabulary", ["slug", "label"], [
        *[(s, l) for s, l, _, _ in D.ROLE_CATEGORIES], ("OTHER", "Other")]),
            select="""SELECT slug, label, count(doc_id) AS postings FROM vocabulary LEFT JOIN titles ON role = slug
      GROUP BY slug, label"""),
)
def vocabulary_use(spark, sf):
    """The seeded role vocabulary with the number of postings that use each entry."""
    root = f"{shared_folder(spark)}/vocabularies-{uuid.uuid4().hex}"
    SD.seed(spark, root)
    used = C.with_role(B.raw_postings(spark, sf)).groupBy(F.col("role_category").alias("slug")).agg(F.count("*").alias("n"))
    return SD.seeded(spark, root, "role_categories").join(used, "slug", "left").select(
        "slug", "label", F.coalesce("n", F.lit(0)).alias("postings")
    )
