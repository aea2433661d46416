"""Filters, search pages, full text, facets and run statistics over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.catalog import Catalog, sql as S
from vacantia.operators import facets as A
from vacantia.operators import filters as FI
from vacantia.operators import fulltext as FT
from vacantia.operators import search as Q
from vacantia.operators.filters import SearchParams
from vacantia.plans import binding as B

catalog = Catalog()

NOW = "2001-08-01 00:00:00"


def now():
    return F.expr(f"TIMESTAMP_NTZ'{NOW}'")


def tables(spark, sf) -> Q.Tables:
    return Q.Tables(
        jobs=B.jobs(spark, sf),
        companies=B.companies(spark, sf),
        listings=B.listings(spark, sf),
        job_technologies=B.job_technologies(spark, sf),
        sources=B.sources(spark),
        technologies=B.technologies(spark),
        role_categories=B.role_categories(spark),
    )


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def sql_stamp(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {alias or column}"


# --- filters ----------------------------------------------------------------------------

_FILTERS = {
    "flt_active": (SearchParams(), "true"),
    "flt_equality_and_in": (
        SearchParams(role_category=["DATA_ENGINEER", "BACKEND_ENGINEER"], seniority=["SENIOR", "LEAD"],
                     employment_type=["PERMANENT", "CONTRACT"], remote_type=["FULLY_REMOTE"]),
        """role_category IN ('DATA_ENGINEER', 'BACKEND_ENGINEER') AND seniority IN ('SENIOR', 'LEAD')
           AND employment_type IN ('PERMANENT', 'CONTRACT') AND remote_type IN ('FULLY_REMOTE')""",
    ),
    "flt_company": (SearchParams(company_slug="customer-7"), "company_slug = 'customer-7'"),
    "flt_region_overlap": (
        SearchParams(region=["EU", "EMEA"]), "list_has_any(eligible_regions, ['EU', 'EMEA'])"
    ),
    "flt_country_overlap": (
        SearchParams(country=["DE", "FR"]), "list_has_any(eligible_countries, ['DE', 'FR'])"
    ),
    "flt_country_or_worldwide": (
        SearchParams(country_or_worldwide=["US"]),
        "(list_contains(eligible_countries, 'US') OR list_contains(eligible_regions, 'WORLDWIDE'))",
    ),
    "flt_region_only": (SearchParams(region_only=True), "len(eligible_countries) = 0"),
    "flt_salary_range": (
        SearchParams(salary_min=9000, salary_max=30000), "salary_max >= 9000 AND salary_min <= 30000"
    ),
    "flt_posted_within": (
        SearchParams(posted_within_hours=D.POSTED_WITHIN_HOURS["30d"]),
        f"posted_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOURS",
    ),
    "flt_conjunction": (
        SearchParams(region=["EUROPE"], seniority=["SENIOR", "STAFF", "MANAGER"], salary_min=5000,
                     employment_type=["CONTRACT", "INTERNSHIP"], region_only=True),
        """list_has_any(eligible_regions, ['EUROPE']) AND seniority IN ('SENIOR', 'STAFF', 'MANAGER')
           AND salary_max >= 5000 AND employment_type IN ('CONTRACT', 'INTERNSHIP')
           AND len(eligible_countries) = 0""",
    ),
}
_TABS = {
    "flt_tab_all": ("all", "list_has_any(eligible_regions, ['EU', 'EEA', 'EUROPE', 'EMEA'])"),
    "flt_tab_region_only": (
        "regionOnly",
        "list_has_any(eligible_regions, ['EU', 'EEA', 'EUROPE', 'EMEA']) AND len(eligible_countries) = 0",
    ),
    "flt_tab_us_remote": (
        "usRemote",
        "remote_type = 'FULLY_REMOTE' AND (list_contains(eligible_countries, 'US') "
        "OR list_contains(eligible_regions, 'WORLDWIDE'))",
    ),
}
for _name, (_params, _where) in {
    **_FILTERS, **{n: (FI.for_tab(SearchParams(), tab), w) for n, (tab, w) in _TABS.items()}
}.items():
    def _filtered(spark, sf, params=_params):
        return B.jobs(spark, sf).filter(FI.predicate(params, now())).select("job_id", "company_slug", "salary_max")

    catalog.add(_name, S.with_(S.JOBS, select=f"""SELECT job_id, company_slug, salary_max FROM jobs
      WHERE is_active AND {_where}"""))(_filtered)


# --- joins ------------------------------------------------------------------------------


@catalog.add(
    "joi_job_company",
    S.with_(S.JOBS, S.COMPANIES, select="""SELECT job_id, name AS company_name, website_url FROM jobs
      JOIN companies ON slug = company_slug"""),
)
def job_company(spark, sf):
    company = B.companies(spark, sf).select(F.col("slug").alias("company_slug"), F.col("name").alias("company_name"), "website_url")
    return B.jobs(spark, sf).join(company, "company_slug").select("job_id", "company_name", "website_url")


_FIRST = """first_sources AS (SELECT job_id, source_slug FROM (SELECT job_id, source_slug, row_number() OVER
    (PARTITION BY job_id ORDER BY first_discovered_at, source_slug) AS rn FROM listings) x WHERE rn = 1)"""


@catalog.add(
    "joi_first_source",
    S.with_(S.JOBS, S.LISTINGS, S.SOURCES, _FIRST, select="""SELECT j.job_id, s.slug AS source_slug,
      s.display_name AS source_name FROM jobs j LEFT JOIN first_sources f USING (job_id)
      LEFT JOIN sources s ON s.slug = f.source_slug"""),
)
def first_source(spark, sf):
    first = Q.first_sources(B.listings(spark, sf), B.sources(spark))
    return B.jobs(spark, sf).select("job_id").join(first, "job_id", "left").select("job_id", "source_slug", "source_name")


@catalog.add(
    "joi_technology_exists",
    S.with_(S.JOBS, S.JOB_TECHNOLOGIES, select="""SELECT job_id, title FROM jobs j WHERE EXISTS (SELECT 1
      FROM job_technologies t WHERE t.job_id = j.job_id AND technology IN ('PYTHON', 'SPARK'))"""),
)
def technology_exists(spark, sf):
    return FI.with_any_technology(
        B.jobs(spark, sf), B.job_technologies(spark, sf), ["PYTHON", "SPARK"]
    ).select("job_id", "title")


@catalog.add(
    "joi_source_exists",
    S.with_(S.JOBS, S.LISTINGS, select="""SELECT job_id, title FROM jobs j WHERE EXISTS (SELECT 1 FROM listings l
      WHERE l.job_id = j.job_id AND l.is_active AND source_slug IN ('lever', 'ashby'))"""),
)
def source_exists(spark, sf):
    return FI.from_sources(B.jobs(spark, sf), B.listings(spark, sf), ["lever", "ashby"]).select("job_id", "title")


@catalog.add(
    "joi_source_not_exists",
    S.with_(S.JOBS, S.LISTINGS, select="""SELECT job_id, title FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM listings l
      WHERE l.job_id = j.job_id AND l.is_active AND source_slug IN ('lever', 'ashby'))"""),
)
def source_not_exists(spark, sf):
    return FI.not_from_sources(B.jobs(spark, sf), B.listings(spark, sf), ["lever", "ashby"]).select("job_id", "title")


_TECH_LIST = """tech AS (SELECT job_id, string_agg(technology || ':' || display_name, ',' ORDER BY technology) AS technologies
  FROM job_technologies JOIN technologies ON slug = technology GROUP BY job_id)"""


def _tech_text():
    return F.array_join(
        F.transform("technologies", lambda t: F.concat_ws(":", t["technology"], t["display_name"])), ","
    ).alias("technologies")


@catalog.add(
    "joi_job_technologies",
    S.with_(S.JOBS, S.JOB_TECHNOLOGIES, S.TECHNOLOGIES, _TECH_LIST, select="""SELECT job_id,
      coalesce(technologies, '') AS technologies FROM jobs LEFT JOIN tech USING (job_id)"""),
)
def job_technologies(spark, sf):
    lists = Q.technology_lists(B.job_technologies(spark, sf), B.technologies(spark))
    none = F.expr("CAST(array() AS array<struct<technology:string,display_name:string>>)")
    out = B.jobs(spark, sf).select("job_id").join(lists, "job_id", "left")
    return out.withColumn("technologies", F.coalesce("technologies", none)).select("job_id", _tech_text())


@catalog.add(
    "joi_job_detail",
    S.with_(S.JOBS, S.COMPANIES, S.LISTINGS, S.SOURCES, S.JOB_TECHNOLOGIES, S.TECHNOLOGIES, _TECH_LIST,
            select=f"""SELECT j.job_id, c.name AS company_name, t.technologies, l.source_slug,
      s.display_name AS source_name, l.source_url, {sql_stamp('l.first_discovered_at', 'first_discovered_at')}
      FROM jobs j JOIN companies c ON c.slug = j.company_slug LEFT JOIN tech t USING (job_id)
      LEFT JOIN listings l ON l.job_id = j.job_id AND l.is_active LEFT JOIN sources s ON s.slug = l.source_slug"""),
)
def job_detail(spark, sf):
    every = B.jobs(spark, sf).select("job_id")
    return Q.job_detail(tables(spark, sf), every).select(
        "job_id", "company_name", _tech_text(), "source_slug", "source_name", "source_url", stamp("first_discovered_at")
    )


# --- pages ------------------------------------------------------------------------------

_SORTS = {
    "newest": "posted_at DESC, job_id",
    "oldest": "posted_at, job_id",
    "salary_desc": "salary_max DESC NULLS LAST, posted_at DESC, job_id",
    "salary_asc": "salary_min ASC NULLS LAST, posted_at DESC, job_id",
}
for _sort, _order in _SORTS.items():
    def _sorted(spark, sf, sort=_sort):
        rows = B.jobs(spark, sf).filter("is_active")
        return Q.page_of(rows, Q.ordering(sort), page=3, page_size=100).select(
            "job_id", "salary_min", "salary_max", stamp("posted_at")
        )

    catalog.add(f"srt_{_sort}", S.with_(S.JOBS, select=f"""SELECT job_id, salary_min, salary_max,
      {sql_stamp('posted_at')} FROM (SELECT * FROM jobs WHERE is_active ORDER BY {_order} LIMIT 100 OFFSET 200) p"""))(_sorted)


@catalog.add(
    "win_search_total",
    S.with_(S.JOBS, select="""SELECT job_id, count(*) OVER () AS total_count FROM jobs
      WHERE is_active AND list_contains(eligible_regions, 'EMEA')"""),
)
def search_total(spark, sf):
    params = SearchParams(region=["EMEA"])
    found = Q.matching_jobs(tables(spark, sf), params, now())
    total = Q.search_total(tables(spark, sf), params, now()).scalar()
    return found.select("job_id").withColumn("total_count", total)


_RESULT = """SELECT p.job_id, p.title, c.name AS company_name, s.display_name AS source_name,
  coalesce(t.technologies, '') AS technologies, (SELECT count(*) FROM found) AS total_count
  FROM page p JOIN companies c ON c.slug = p.company_slug LEFT JOIN first_sources f USING (job_id)
  LEFT JOIN sources s ON s.slug = f.source_slug LEFT JOIN tech t USING (job_id)"""


def _search_sql(where: str, order: str = _SORTS["newest"], limit: int = 20, offset: int = 0) -> str:
    return S.with_(
        S.JOBS, S.COMPANIES, S.LISTINGS, S.SOURCES, S.JOB_TECHNOLOGIES, S.TECHNOLOGIES, _TECH_LIST, _FIRST,
        f"found AS (SELECT * FROM jobs j WHERE is_active AND {where})",
        f"page AS (SELECT * FROM found ORDER BY {order} LIMIT {limit} OFFSET {offset})",
        select=_RESULT,
    )


def _result(rows):
    return rows.select("job_id", "title", "company_name", "source_name", _tech_text(), "total_count")


@catalog.add(
    "qry_search",
    _search_sql(
        """list_has_any(eligible_regions, ['EUROPE', 'EU']) AND salary_max >= 3000 AND EXISTS (SELECT 1
        FROM job_technologies t WHERE t.job_id = j.job_id AND technology IN ('REACT', 'JAVA', 'KAFKA', 'AWS'))
        AND EXISTS (SELECT 1 FROM listings l WHERE l.job_id = j.job_id AND l.is_active
          AND source_slug IN ('lever', 'ashby', 'remoteok', 'workable'))
        AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.job_id = j.job_id AND l.is_active
          AND source_slug IN ('greenhouse'))""", _SORTS["salary_desc"], 50, 50),
)
def search(spark, sf):
    params = SearchParams(
        region=["EUROPE", "EU"], salary_min=3000, technology=["REACT", "JAVA", "KAFKA", "AWS"],
        source_slug=["lever", "ashby", "remoteok", "workable"], exclude_source_slug=["greenhouse"],
        sort="salary_desc", page=2, page_size=50,
    )
    return _result(Q.search(tables(spark, sf), params, now()))


@catalog.add("qry_company_page", _search_sql("company_slug = 'customer-12'"))
def company_page(spark, sf):
    return _result(Q.company_page(tables(spark, sf), "customer-12", SearchParams(), now()))


_PRESETS = S.values(
    "presets", ["preset", "field", "value"],
    [(slug, field, v) for slug, fs in D.LANDING_PRESETS.items() for field, vs in fs.items() for v in vs],
)


@catalog.add(
    "qry_landing_pages",
    S.with_(S.JOBS, _PRESETS, """hits AS (SELECT DISTINCT preset, job_id, posted_at FROM jobs JOIN presets ON is_active AND
        CASE field WHEN 'role_category' THEN role_category = value
          WHEN 'region' THEN list_contains(eligible_regions, value)
          ELSE list_contains(eligible_countries, value) END)""",
            select="""SELECT preset, job_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY preset
      ORDER BY posted_at DESC, job_id) AS rn FROM hits) x WHERE rn <= 20"""),
)
def landing_pages(spark, sf):
    return Q.landing_pages(B.jobs(spark, sf), list(D.LANDING_PRESETS), now()).select("preset", "job_id", "place")


# --- full text --------------------------------------------------------------------------

_DOC_JOBS = "SELECT doc_id AS job_id, raw_title, company_name, description FROM postings"


def _doc_jobs(spark, sf):
    return B.raw_postings(spark, sf).select(
        F.col("doc_id").alias("job_id"), F.col("raw_title").alias("title"),
        F.col("company_name").alias("normalized_title"), F.col("description").alias("description_text"),
    )


def _toks(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')"


_FT_POSITIONS = f"""split AS MATERIALIZED (SELECT job_id, {_toks('raw_title')} AS a, {_toks('company_name')} AS b,
    {_toks('description')} AS c FROM ({_DOC_JOBS}) d),
places AS MATERIALIZED (
  SELECT job_id, unnest(a) AS term, generate_subscripts(a, 1) AS position, 1.0::DOUBLE AS weight, 'A' AS label FROM split
  UNION ALL SELECT job_id, unnest(b), generate_subscripts(b, 1) + len(a), 1.0, 'A' FROM split
  UNION ALL SELECT job_id, unnest(c), generate_subscripts(c, 1) + len(a) + len(b), 0.2, 'C' FROM split)"""


@catalog.add(
    "fts_index",
    S.with_(S.POSTINGS, _FT_POSITIONS, select="""SELECT job_id, term, count(*) AS occurrences,
      sha256(string_agg(position || label, ',' ORDER BY position)) AS places FROM places GROUP BY ALL"""),
)
def fts_index(spark, sf):
    text = F.array_join(
        F.transform("positions", lambda p: F.concat(p["position"].cast("string"), p["label"])), ","
    )
    return FT.postings(_doc_jobs(spark, sf), stemmed=False).select(
        "job_id", "term", F.size("positions").cast("bigint").alias("occurrences"), F.sha2(text, 256).alias("places")
    )


# All words of a job as one text with a blank around each, so words and phrases are found as they stand.
_FT_LINES = f"""lines AS MATERIALIZED (SELECT job_id, ' ' || array_to_string(list_concat({_toks('raw_title')}, {_toks('company_name')},
    {_toks('description')}), ' ') || ' ' AS words FROM ({_DOC_JOBS}) d)"""


def _holds(phrase: str) -> str:
    return f"contains(words, ' {phrase} ')"


_FT_QUERIES = {
    "fts_match_all_words": ("backend Python", f"{_holds('backend')} AND {_holds('python')}"),
    "fts_match_phrase_or": (
        '"remote worldwide" or freelance',
        f"{_holds('remote worldwide')} OR {_holds('freelance')}",
    ),
    "fts_match_exclusion": ("engineer -senior", f"{_holds('engineer')} AND NOT {_holds('senior')}"),
}
for _name, (_query, _where) in _FT_QUERIES.items():
    def _matched(spark, sf, query=_query):
        jobs = _doc_jobs(spark, sf)
        index = FT.postings(jobs, stemmed=False, only=FT.query_terms(FT.clauses(query, False)))
        return FT.match(index, query, stemmed=False).select("job_id")

    catalog.add(_name, S.with_(S.POSTINGS, _FT_LINES, select=f"SELECT job_id FROM lines WHERE {_where}"))(_matched)


@catalog.add(
    "fts_rank_all_words",
    S.with_(S.POSTINGS, _FT_POSITIONS, """numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id, term
        ORDER BY position) AS n FROM places WHERE term IN ('engineer', 'the')),
      pairs AS (SELECT a.job_id, abs(a.position - b.position) AS gap, a.weight * b.weight AS w FROM numbered a
        JOIN numbered b ON a.job_id = b.job_id AND a.term = 'engineer' AND b.term = 'the')""",
            select="""SELECT job_id, round(1 - exp(sum(ln(1 - sqrt(w * CASE WHEN gap > 100 THEN 1e-30
        ELSE 1.0 / (1.005 + 0.05 * exp(gap / 1.5 - 2)) END)))), 6) AS rank FROM pairs GROUP BY job_id"""),
)
def fts_rank_all_words(spark, sf):
    query = "engineer the"
    index = FT.postings(_doc_jobs(spark, sf), stemmed=False, only=["engineer", "the"])
    ranked = FT.rank(FT.match(index, query, stemmed=False), query, stemmed=False)
    return ranked.select("job_id", F.round("rank", 6).alias("rank"))


@catalog.add(
    "fts_rank_alternatives",
    S.with_(S.POSTINGS, _FT_POSITIONS, """numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id, term
        ORDER BY position) AS n FROM places WHERE term IN ('backend', 'the')),
      tops AS (SELECT job_id, term, max(weight) AS top, sum(weight / (n * n)) AS total,
        min(n) FILTER (weight = 1.0) AS first_a FROM numbered GROUP BY job_id, term)""",
            select="""SELECT job_id, round(sum((top + total - top / (coalesce(first_a, 1) * coalesce(first_a, 1)))
        / (pi() * pi() / 6)) / 2, 6) AS rank FROM tops GROUP BY job_id"""),
)
def fts_rank_alternatives(spark, sf):
    query = "backend or the"
    index = FT.postings(_doc_jobs(spark, sf), stemmed=False, only=["backend", "the"])
    ranked = FT.rank(FT.match(index, query, stemmed=False), query, stemmed=False)
    return ranked.select("job_id", F.round("rank", 6).alias("rank"))


# DuckDB has no stemmer here: the words of each stem of the query, as far as the tables can hold them.
_STEMS = {
    "engin": ("engine", "engines", "engineer", "engineers", "engineering"), "python": ("python", "pythons"),
    "softwar": ("software",), "architect": ("architect", "architects"),
}
_STEM_OF = " ".join(f"WHEN word IN ({', '.join(repr(w) for w in words)}) THEN '{stem}'" for stem, words in _STEMS.items())


@catalog.add(
    "fts_search_stemmed",
    S.with_(S.JOBS, f"""split AS MATERIALIZED (SELECT job_id, {_toks('title')} || {_toks('normalized_title')} AS a, {_toks('description_text')} AS c
        FROM jobs WHERE is_active)""", f"""words AS (SELECT job_id, unnest(a) AS word, generate_subscripts(a, 1) AS position, 1.0::DOUBLE AS weight FROM split
        UNION ALL SELECT job_id, unnest(c), generate_subscripts(c, 1) + len(a), 0.2 FROM split)""", f"""places AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY job_id, term ORDER BY position) AS n FROM (
          SELECT job_id, position, weight, CASE {_STEM_OF} END AS term FROM words) w WHERE term IS NOT NULL)""",
            """found AS (SELECT job_id FROM places GROUP BY job_id HAVING bool_or(term = 'engin') AND bool_or(term = 'python')
        UNION SELECT p.job_id FROM places p JOIN places q ON q.job_id = p.job_id AND q.position = p.position + 1
          WHERE p.term = 'softwar' AND q.term = 'architect')""", """tops AS (SELECT job_id, term, max(weight) AS top,
        sum(weight / (n * n)) AS total, arg_min(n, (-weight, n)) AS first FROM places GROUP BY job_id, term)""",
            select="""SELECT job_id, title, round(sum((top + total - top / (first * first)) / (pi() * pi() / 6)) / 4, 6) AS rank
      FROM found JOIN tops USING (job_id) JOIN jobs USING (job_id) GROUP BY job_id, title"""),
)
def fts_search_stemmed(spark, sf):
    params = SearchParams(q="engineers python or \"software architect\"", sort="relevance")
    return Q.matching_jobs(tables(spark, sf), params, now()).select("job_id", "title", F.round("rank", 6).alias("rank"))


# --- facets and counters ----------------------------------------------------------------


@catalog.add(
    "agg_facets",
    S.with_(S.JOBS, S.LISTINGS, S.SOURCES, S.JOB_TECHNOLOGIES, S.TECHNOLOGIES, S.ROLES,
            "active AS (SELECT * FROM jobs WHERE is_active)", select="""
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
      UNION ALL SELECT 'source', source_slug, display_name, count(DISTINCT a.job_id) FROM listings l
        JOIN active a ON a.job_id = l.job_id JOIN sources ON slug = source_slug WHERE l.is_active GROUP BY ALL"""),
)
def facets(spark, sf):
    return A.facets(tables(spark, sf))


@catalog.add(
    "agg_element_counts",
    S.with_(S.JOBS, select="""SELECT value, count(*) AS count FROM (SELECT unnest(eligible_regions) AS value
      FROM jobs WHERE is_active) x GROUP BY value"""),
)
def element_counts(spark, sf):
    return A.element_counts(B.jobs(spark, sf), "eligible_regions")


@catalog.add(
    "agg_distinct_jobs_per_source",
    S.with_(S.JOBS, S.LISTINGS, select="""SELECT source_slug AS value, count(DISTINCT l.job_id) AS count
      FROM listings l JOIN jobs j ON j.job_id = l.job_id AND j.is_active WHERE l.is_active GROUP BY 1"""),
)
def distinct_jobs_per_source(spark, sf):
    return A.source_counts(B.jobs(spark, sf), B.listings(spark, sf))


for _tab, _where in [
    ("all", "list_has_any(eligible_regions, ['EU', 'EEA', 'EUROPE', 'EMEA'])"),
    ("usRemote", "remote_type = 'FULLY_REMOTE' AND (list_contains(eligible_countries, 'US') "
                 "OR list_contains(eligible_regions, 'WORLDWIDE'))"),
]:
    def _new(spark, sf, tab=_tab):
        since = F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")
        return A.new_listings(tables(spark, sf), since, now(), tab)

    catalog.add(f"agg_new_listings_{_tab.lower()}", S.with_(
        S.JOBS, S.LISTINGS, S.SOURCES, f"""recent AS (SELECT source_slug FROM listings l JOIN jobs j
          ON j.job_id = l.job_id AND j.is_active AND {_where} WHERE l.is_active
          AND first_discovered_at > TIMESTAMP '1998-01-01' AND first_discovered_at <= TIMESTAMP '{NOW}')""",
        select="""SELECT r.source_slug, s.display_name, count(*) AS count FROM recent r
          JOIN sources s ON s.slug = r.source_slug GROUP BY ALL
          UNION ALL SELECT NULL, NULL, count(*) FROM recent"""))(_new)


@catalog.add(
    "agg_active_companies",
    S.with_(S.JOBS, S.COMPANIES, select="""SELECT slug, name, website_url, count(*) AS active_jobs FROM companies
      JOIN jobs ON company_slug = slug WHERE is_active GROUP BY ALL"""),
)
def active_companies(spark, sf):
    return A.active_companies(tables(spark, sf))


@catalog.add(
    "agg_totals",
    S.with_(S.JOBS, S.COMPANIES, select="""SELECT (SELECT count(*) FROM jobs WHERE is_active) AS active_jobs,
      (SELECT count(*) FROM companies) AS companies"""),
)
def totals(spark, sf):
    return A.totals(tables(spark, sf))


_STATS = """stats AS (SELECT run_id, source_slug, min(occurred_at) AS started_at, max(occurred_at) AS finished_at, count(*) AS fetched,
    count(*) FILTER (outcome IN ('CREATED', 'MERGED', 'UPDATED_EXISTING_LISTING')) AS eligible,
    count(*) FILTER (outcome = 'REJECTED_GEOGRAPHY') AS rejected_geography,
    count(*) FILTER (outcome = 'REJECTED_ROLE_CATEGORY') AS rejected_role,
    count(*) FILTER (outcome = 'CREATED') AS created,
    count(*) FILTER (outcome = 'UPDATED_EXISTING_LISTING') AS updated,
    count(*) FILTER (outcome = 'MERGED') AS duplicate, count(error) AS errors,
    CASE WHEN count(error) > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM outcomes GROUP BY run_id, source_slug)"""
_COUNTERS = ["run_id", "source_slug", "fetched", "eligible", "rejected_geography", "rejected_role", "created",
             "updated", "duplicate", "errors", "status"]


@catalog.add(
    "agg_run_stats",
    S.with_(S.OUTCOMES, _STATS, select=f"""SELECT {', '.join(_COUNTERS)}, {sql_stamp('started_at')},
      {sql_stamp('finished_at')} FROM stats"""),
)
def run_stats(spark, sf):
    return A.run_stats(B.outcomes(spark, sf)).select(*_COUNTERS, stamp("started_at"), stamp("finished_at"))


@catalog.add(
    "agg_error_sample",
    S.with_(S.OUTCOMES, select="""SELECT run_id, string_agg(external_id || '=' || error, ';' ORDER BY ordinal) AS sample
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS rn FROM outcomes
        WHERE error IS NOT NULL) x WHERE rn <= 10 GROUP BY run_id"""),
)
def error_sample(spark, sf):
    text = F.transform("error_sample", lambda e: F.concat_ws("=", e["external_id"], e["message"]))
    return A.error_samples(B.outcomes(spark, sf)).select("run_id", F.array_join(text, ";").alias("sample"))


@catalog.add(
    "win_latest_run",
    S.with_(S.OUTCOMES, _STATS, select="""SELECT source_slug, run_id, fetched, status FROM (SELECT *, row_number() OVER
      (PARTITION BY source_slug ORDER BY started_at DESC, run_id DESC) AS rn FROM stats) x WHERE rn = 1"""),
)
def latest_run(spark, sf):
    return A.latest_runs(A.run_stats(B.outcomes(spark, sf))).select("source_slug", "run_id", "fetched", "status")


@catalog.add(
    "joi_source_overview",
    S.with_(S.OUTCOMES, _STATS, S.SOURCES, """latest AS (SELECT * FROM (SELECT *, row_number() OVER
        (PARTITION BY source_slug ORDER BY started_at DESC, run_id DESC) AS rn FROM stats) x WHERE rn = 1)""",
            select="""SELECT s.slug, s.display_name, s.status, l.run_id, l.status AS run_status, l.fetched, l.created, l.errors
      FROM sources s LEFT JOIN latest l ON l.source_slug = s.slug"""),
)
def source_overview(spark, sf):
    return A.source_overview(B.sources(spark), A.run_stats(B.outcomes(spark, sf))).select(
        "slug", "display_name", "status", "run_id", "run_status", "fetched", "created", "errors"
    )
