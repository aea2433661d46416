"""Classification and geography over the posting view."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.catalog import Catalog, sql as S
from vacantia.functions import classify as C
from vacantia.functions import geo as G
from vacantia.functions.text import strip_html
from vacantia.plans import binding as B
from vacantia.plans import classify as P

catalog = Catalog()

_TITLES = f"""titles AS (SELECT *, {S.seniority('lower_title')} AS seniority, {S.role('lower_title')} AS role
  FROM (SELECT *, lower(raw_title) AS lower_title FROM postings) p)"""


def _titled(spark, sf):
    return C.with_title(B.raw_postings(spark, sf))


@catalog.add(
    "nrm_seniority", S.with_(S.POSTINGS, _TITLES, select="SELECT doc_id, seniority FROM titles")
)
def seniority(spark, sf):
    return _titled(spark, sf).select("doc_id", "seniority")


@catalog.add(
    "nrm_role_category",
    S.with_(S.POSTINGS, _TITLES, select="SELECT doc_id, role AS role_category FROM titles"),
)
def role_category(spark, sf):
    return _titled(spark, sf).select("doc_id", "role_category")


_BASE_TAGS = "CASE role " + " ".join(
    f"WHEN {S.lit(slug)} THEN {S.array(tags)}" for slug, _, tags, _ in D.ROLE_CATEGORIES
) + " ELSE CAST([] AS VARCHAR[]) END"
_TAG_RULES = ", ".join(
    f"CASE WHEN {S.has_any('lower_title', ks)} AND NOT list_contains({_BASE_TAGS}, {S.lit(tag)}) "
    f"THEN {S.lit(tag)} END" for tag, ks in D.DOMAIN_TAGS
)


@catalog.add(
    "nrm_domain_tags",
    S.with_(S.POSTINGS, _TITLES, select=f"""SELECT doc_id,
      concat_ws(',', nullif(array_to_string({_BASE_TAGS}, ','), ''), {_TAG_RULES}) AS tags FROM titles"""),
)
def domain_tags(spark, sf):
    return _titled(spark, sf).select("doc_id", F.array_join("tags", ",").alias("tags"))


@catalog.add(
    "nrm_normalized_title",
    S.with_(S.POSTINGS, _TITLES, select=f"""SELECT doc_id,
      {S.normalized_title('raw_title', 'role', 'seniority')} AS normalized_title FROM titles"""),
)
def normalized_title(spark, sf):
    return _titled(spark, sf).select("doc_id", "normalized_title")


_TEXTS = f"""texts AS MATERIALIZED (SELECT *, raw_title || chr(10) || description_text AS everything,
    lower(raw_title || chr(10) || description_text) AS lowered
  FROM (SELECT *, {S.strip_html('description')} AS description_text FROM postings) p)"""


def _texts(spark, sf):
    out = B.raw_postings(spark, sf).withColumn("description_text", strip_html(F.col("description")))
    return out.withColumn("everything", F.concat_ws("\n", "raw_title", "description_text"))


# Every alias that occurs, then per technology the longest one; "Go" only by itself, last.
_TECH_SQL = S.with_(
    S.POSTINGS, _TEXTS, S.phrase_rows(),
    """alias_hits AS (SELECT doc_id, value AS slug, phrase, ord,
        row_number() OVER (PARTITION BY doc_id, value ORDER BY length(phrase) DESC, ord) AS rn
      FROM texts JOIN phrases ON dict = 'technology'
        AND CASE WHEN contains(lowered, phrase) THEN regexp_matches(lowered, pattern) ELSE false END),
    hits AS (SELECT doc_id, slug, phrase, length(phrase) AS len, ord FROM alias_hits WHERE rn = 1
      UNION ALL SELECT doc_id, 'GOLANG', 'Go', 0, 999 FROM texts t
      WHERE regexp_matches(everything, '(^|[^A-Za-z0-9])Go($|[^A-Za-z0-9])')
        AND NOT EXISTS (SELECT 1 FROM alias_hits h WHERE h.doc_id = t.doc_id AND h.slug = 'GOLANG'))""",
    select="""SELECT doc_id, slug, phrase,
      row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, ord) - 1 AS place FROM hits""",
)


@catalog.add("nrm_technologies", _TECH_SQL)
def technologies(spark, sf):
    hits = C.technologies(F.col("everything"))
    return _texts(spark, sf).select("doc_id", F.posexplode(hits).alias("place", "hit")).select(
        "doc_id", F.col("place").cast("bigint").alias("place"), "hit.slug", "hit.phrase"
    )


@catalog.add(
    "nrm_employment_type",
    S.with_(S.POSTINGS, _TEXTS, select=f"""SELECT doc_id,
      {S.case([(S.has_any('lowered', ks), kind) for kind, ks in D.EMPLOYMENT_KEYWORDS])} AS employment_type
      FROM texts"""),
)
def employment_type(spark, sf):
    return _texts(spark, sf).select("doc_id", C.employment_type(F.col("everything")).alias("employment_type"))


_PAY = S.salary("description_text")


@catalog.add(
    "nrm_salary",
    S.with_(S.POSTINGS, _TEXTS, select=f"""SELECT doc_id, {_PAY['min']} AS salary_min, {_PAY['max']} AS salary_max,
      {_PAY['currency']} AS currency, {_PAY['period']} AS period FROM texts"""),
)
def salary(spark, sf):
    out = _texts(spark, sf).withColumn("pay", C.salary(F.col("description_text")))
    return out.select(
        "doc_id", F.col("pay.min").alias("salary_min"), F.col("pay.max").alias("salary_max"),
        F.col("pay.currency").alias("currency"), F.col("pay.period").alias("period"),
    )


@catalog.add(
    "nrm_salary_period",
    S.with_(S.POSTINGS, _TEXTS, select=f"""SELECT doc_id,
      {S.salary_period('description_text')} AS period FROM texts"""),
)
def salary_period(spark, sf):
    return _texts(spark, sf).select("doc_id", C.salary_period(F.col("description_text")).alias("period"))


_EXTRACTED_TYPE = S.case([(S.has_any("lowered", ks), kind) for kind, ks in D.EMPLOYMENT_KEYWORDS])
_PREFERRED = f"""preferred AS (SELECT doc_id, raw_title, raw_location, description_text, lowered,
    coalesce(employment_type, {_EXTRACTED_TYPE}) AS employment_type,
    coalesce(salary_min, {_PAY['min']}) AS salary_min, coalesce(salary_max, {_PAY['max']}) AS salary_max,
    coalesce(salary_currency, {_PAY['currency']}) AS salary_currency,
    coalesce(salary_period, {_PAY['period']}) AS salary_period FROM texts)"""


@catalog.add(
    "nrm_prefer_structured",
    S.with_(S.POSTINGS, _TEXTS, _PREFERRED, select="""SELECT doc_id, employment_type, salary_min, salary_max,
      salary_currency, salary_period FROM preferred"""),
)
def prefer_structured(spark, sf):
    out = _texts(spark, sf).withColumns(
        {
            "extracted_employment_type": C.employment_type(F.col("everything")),
            "extracted_salary": C.salary(F.col("description_text")),
        }
    )
    return C.prefer_structured(out).select(
        "doc_id", "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period"
    )


# --- geography --------------------------------------------------------------------------

_CODES = [c for c, _, _ in D.COUNTRIES] + ["zz", None, "de", "gb"]
_DIM = S.values(
    "countries", ["code", "name", "eu", "eea", "europe", "emea"],
    [(c, n, *[int(r in rs) for r in ("EU", "EEA", "EUROPE", "EMEA")]) for c, n, rs in D.COUNTRIES],
)
_CODED = f"coded AS (SELECT doc_id, {S.pick(_CODES, 'doc_id')} AS code FROM documents)"


def _coded(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", B.pick(_CODES, F.col("doc_id")).alias("code"))


@catalog.add(
    "geo_country_flags",
    S.with_(_DIM, _CODED, select="""SELECT doc_id, coalesce(europe, 0) AS is_europe, coalesce(eu, 0) AS is_eu,
      coalesce(eea, 0) AS is_eea, coalesce(emea, 0) AS is_emea
      FROM coded LEFT JOIN countries c ON c.code = upper(coded.code)"""),
)
def country_flags(spark, sf):
    dim = F.broadcast(G.countries(spark).withColumnRenamed("code", "known"))
    flags = [
        F.coalesce(F.col(f), F.lit(False)).cast("int").alias(f)
        for f in ("is_europe", "is_eu", "is_eea", "is_emea")
    ]
    coded = _coded(spark, sf)
    return coded.join(dim, F.upper("code") == F.col("known"), "left").select("doc_id", *flags)


@catalog.add(
    "geo_regions_of",
    S.with_(_DIM, _CODED, select="""SELECT doc_id, concat_ws(',', CASE WHEN eu = 1 THEN 'EU' END,
      CASE WHEN eea = 1 THEN 'EEA' END, CASE WHEN europe = 1 THEN 'EUROPE' END,
      CASE WHEN emea = 1 THEN 'EMEA' END) AS regions
      FROM coded LEFT JOIN countries c ON c.code = upper(coded.code)"""),
)
def regions_of(spark, sf):
    return _coded(spark, sf).select(
        "doc_id", F.array_join(G.regions_of(F.col("code")), ",").alias("regions")
    )


@catalog.add(
    "geo_country_name",
    S.with_(_DIM, _CODED, select="""SELECT doc_id, name FROM coded
      LEFT JOIN countries c ON c.code = upper(coded.code)"""),
)
def country_name(spark, sf):
    return _coded(spark, sf).select("doc_id", G.country_name(F.col("code")).alias("name"))


# One row per posting field, then every dictionary phrase in it. Short codes are isolated
# capitals after "U.S."-style dots are closed up.
_FIELDS = """fields AS MATERIALIZED (
  SELECT doc_id, 0 AS f, 'locationRaw' AS field, raw_location AS text, lower(raw_location) AS lowered
    FROM texts WHERE trim(raw_location) <> ''
  UNION ALL SELECT doc_id, 1, 'title', raw_title, lower(raw_title) FROM texts
  UNION ALL SELECT doc_id, 2, 'description', description_text, lower(description_text) FROM texts
    WHERE trim(description_text) <> '')"""
_KINDS = "CASE dict " + " ".join(
    f"WHEN '{k}' THEN {i}" for i, k in enumerate(
        ["region", "worldwide", "us-eligible", "exclusive-non-european", "country", "code", "timezone",
         "weak-company"]
    )
) + " END"
_SAFE = S.values("safe", ["token", "code"], list(D.SAFE_SHORT_CODES.items()))
_SIGNALS = f"""phrase_hits AS MATERIALIZED (
  SELECT doc_id, f, field, dict AS kind, {_KINDS} AS k, ord, phrase, value FROM fields
  JOIN phrases ON dict IN ('region','worldwide','us-eligible','exclusive-non-european','country','timezone',
      'weak-company') AND CASE WHEN contains(lowered, phrase) THEN regexp_matches(lowered, pattern) ELSE false END),
tokens AS (SELECT doc_id, f, field, unnest(toks) AS phrase, generate_subscripts(toks, 1) AS ord FROM (
  SELECT doc_id, f, field, regexp_extract_all(
    regexp_replace(text, '\\b([A-Z])\\.([A-Z])\\b', '\\1\\2', 'g'), '\\b[A-Z]{{2,4}}\\b') AS toks FROM fields) t),
code_hits AS (SELECT doc_id, f, field, min_by(phrase, ord) AS phrase, code AS value, min(ord) AS ord FROM (
    SELECT t.*, CASE WHEN field = 'locationRaw' THEN c.code ELSE s.code END AS code FROM tokens t
    LEFT JOIN countries c ON c.code = t.phrase LEFT JOIN safe s ON s.token = t.phrase) x
  WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM phrase_hits h WHERE h.doc_id = x.doc_id AND h.f = x.f
    AND h.kind IN ('us-eligible', 'country') AND h.value = x.code)
  GROUP BY doc_id, f, field, code),
signals AS MATERIALIZED (SELECT doc_id, f, field, kind, k, ord, phrase, value FROM phrase_hits
  UNION ALL SELECT doc_id, f, field, 'country', 5, ord, phrase, value FROM code_hits)"""
_GEO_CTES = (S.POSTINGS, _TEXTS, S.phrase_rows(), _DIM, _SAFE, _FIELDS, _SIGNALS)


def _field_signals(spark, sf):
    texts = _texts(spark, sf)
    signals = F.concat(
        G.location_signals(F.col("raw_location"), "locationRaw"),
        G.location_signals(F.col("raw_title"), "title"),
        G.location_signals(F.col("description_text"), "description"),
    )
    return texts.select("doc_id", F.posexplode(signals).alias("place", "s")).select(
        "doc_id", F.col("place").cast("bigint").alias("place"), "s.field", "s.kind", "s.phrase", "s.value"
    )


@catalog.add(
    "geo_location_signals",
    S.with_(*_GEO_CTES, select="""SELECT doc_id, field, kind, phrase, value,
      row_number() OVER (PARTITION BY doc_id ORDER BY f, k, ord) - 1 AS place FROM signals"""),
)
def location_signals(spark, sf):
    return _field_signals(spark, sf)


@catalog.add(
    "geo_country_names",
    S.with_(*_GEO_CTES, select="""SELECT doc_id, phrase, value AS code FROM signals
      WHERE field = 'locationRaw' AND kind = 'country' AND k = 4"""),
)
def country_names(spark, sf):
    location = F.col("raw_location")
    named = F.filter(
        G.location_signals(location, "locationRaw"),
        lambda s: (s["kind"] == "country") & (s["phrase"] == F.lower(s["phrase"])),
    )
    return B.raw_postings(spark, sf).select("doc_id", F.explode(named).alias("s")).select(
        "doc_id", "s.phrase", F.col("s.value").alias("code")
    )


@catalog.add(
    "geo_short_codes",
    S.with_(*_GEO_CTES, select="""SELECT doc_id, t.phrase, c.code, ord FROM tokens t
      JOIN countries c ON c.code = t.phrase WHERE field = 'locationRaw'
      UNION ALL SELECT doc_id, t.phrase, s.code, ord + 100 FROM tokens t JOIN safe s ON s.token = t.phrase
      WHERE field = 'title'"""),
)
def short_codes(spark, sf):
    base = B.raw_postings(spark, sf)
    parts = []
    for column, field, offset in [("raw_location", "locationRaw", 0), ("raw_title", "title", 100)]:
        text = F.col(column)
        tokens = F.regexp_extract_all(F.regexp_replace(text, G._DOTTED, "$1"), F.lit(G._SHORT), F.lit(0))
        pairs = base.select("doc_id", F.posexplode(tokens).alias("i", "token"), text.alias("text"))
        known = {c: c for c in D.COUNTRY_CODES} if offset == 0 else D.SAFE_SHORT_CODES
        found = pairs.select(
            "doc_id", F.col("token").alias("phrase"),
            G.value_map(known, F.col("token")).alias("code"),
            (F.col("i") + 1 + offset).cast("bigint").alias("ord"),
        ).filter("code IS NOT NULL")
        parts.append(found)
    return parts[0].unionByName(parts[1])


@catalog.add(
    "geo_exclusivity",
    S.with_(S.POSTINGS, _TEXTS, select="SELECT doc_id, " + ", ".join(
        f"CAST({' OR '.join(f'contains(lower({c}), {S.lit(m)})' for m in D.EXCLUSIVITY_MARKERS)} AS INTEGER) AS {a}"
        for c, a in [("raw_location", "location"), ("description_text", "description")]
    ) + " FROM texts"),
)
def exclusivity(spark, sf):
    return _texts(spark, sf).select(
        "doc_id",
        G.exclusivity(F.col("raw_location")).cast("int").alias("location"),
        G.exclusivity(F.col("description_text")).cast("int").alias("description"),
    )


_SUPPORTED = f"value IN ({', '.join(S.lit(c) for c in D.SUPPORTED_COUNTRIES)})"


def _first(kind: str, column: str = "phrase") -> str:
    return f"min_by({column}, f * 1000000 + k * 10000 + ord) FILTER (kind = '{kind}')"


def _distinct_list(where: str) -> str:
    """Distinct values in order of first appearance."""
    return f"list(value ORDER BY place) FILTER ({where})"


# Values of decisive countries and of all regions, each with its first place.
_VERDICT = f"""firsts AS (SELECT doc_id, kind = 'region' AS is_region, value, min(f * 1000000 + k * 10000 + ord) AS place
  FROM signals WHERE kind = 'region' OR (f < 2 AND kind IN ('us-eligible', 'country'))
  GROUP BY doc_id, kind = 'region', value),
lists AS (SELECT doc_id, {_distinct_list('is_region')} AS regions, {_distinct_list('NOT is_region')} AS named,
    {_distinct_list(f'NOT is_region AND {_SUPPORTED}')} AS ok FROM firsts GROUP BY doc_id),
phrases_first AS (SELECT doc_id, {_first('region')} AS region, {_first('region', 'value')} AS region_value,
    {_first('us-eligible')} AS us, {_first('exclusive-non-european')} AS excl, {_first('worldwide')} AS world,
    {_first('timezone')} AS tz, {_first('weak-company')} AS weak FROM signals GROUP BY doc_id),
ruled AS (SELECT t.doc_id, coalesce(l.regions, []) AS rs, coalesce(l.named, []) AS named, coalesce(l.ok, []) AS ok,
    p.*, CASE WHEN p.region IS NOT NULL THEN '1' WHEN p.us IS NOT NULL THEN '1b' WHEN len(l.ok) > 0 THEN '2a'
      WHEN len(l.named) > 0 THEN '2b' WHEN p.excl IS NOT NULL THEN '3' WHEN p.world IS NOT NULL THEN '4'
      WHEN p.tz IS NOT NULL THEN '5a' WHEN p.weak IS NOT NULL THEN '5b' ELSE '6' END AS rule
  FROM texts t LEFT JOIN lists l USING (doc_id) LEFT JOIN phrases_first p USING (doc_id)),
picked AS (SELECT *, CASE rule WHEN '1' THEN ok
      WHEN '1b' THEN CASE WHEN list_contains(ok, 'US') THEN ok ELSE list_append(ok, 'US') END
      WHEN '2a' THEN ok ELSE [] END AS codes,
    CASE WHEN rule IN ('1', '1b') THEN rs WHEN rule = '4' THEN ['WORLDWIDE'] ELSE [] END AS explicit FROM ruled),
implied AS (SELECT doc_id, list(region ORDER BY place) AS regions FROM (
    SELECT doc_id, region, min(place) AS place FROM (
      SELECT doc_id, unnest(explicit) AS region, generate_subscripts(explicit, 1) AS place FROM picked
      UNION ALL SELECT u.doc_id, r.region, 100 + u.place * 10 + r.o FROM
        (SELECT doc_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS place FROM picked) u
        JOIN (SELECT code, 'EU' AS region, 0 AS o FROM countries WHERE eu = 1
          UNION ALL SELECT code, 'EEA', 1 FROM countries WHERE eea = 1
          UNION ALL SELECT code, 'EUROPE', 2 FROM countries WHERE europe = 1
          UNION ALL SELECT code, 'EMEA', 3 FROM countries WHERE emea = 1) r ON r.code = u.code) x
    GROUP BY doc_id, region) y GROUP BY doc_id),
verdicts AS MATERIALIZED (SELECT p.doc_id, rule, rule IN ('1', '1b', '2a', '4', '5a') AS eligible,
    CASE WHEN rule = '5a' THEN 'MEDIUM' WHEN rule IN ('5b', '6') THEN 'LOW' ELSE 'HIGH' END AS confidence,
    codes, coalesce(i.regions, []) AS regions,
    CASE rule WHEN '1' THEN 'Explicit region keyword: "' || region || '" (' || region_value || ')'
      WHEN '1b' THEN 'Broad North America eligibility phrase: "' || us || '"'
      WHEN '2a' THEN 'Includes supported ' || CASE WHEN len(ok) > 1 THEN 'countries' ELSE 'country' END || ': ' ||
        array_to_string(ok, ', ')
      WHEN '2b' THEN 'Restricted to unsupported ' || CASE WHEN len(named) > 1 THEN 'countries' ELSE 'country' END ||
        ': ' || array_to_string(named, ', ')
      WHEN '3' THEN 'Restricted to non-European region: "' || excl || '"'
      WHEN '4' THEN 'Worldwide remote with no exclusion of Europe: "' || world || '"'
      WHEN '5a' THEN 'Timezone signal suggests Europe: "' || tz || '"'
      WHEN '5b' THEN 'Non-committal company/team language, not a candidate-location statement: "' || weak || '"'
      ELSE 'No parseable location signal' END AS reason
  FROM picked p LEFT JOIN implied i USING (doc_id))"""
_LABEL = """CASE WHEN list_contains(regions, 'WORLDWIDE') THEN 'Remote (Worldwide)'
  WHEN list_contains(regions, 'EU') THEN 'Remote (EU)' WHEN list_contains(regions, 'EEA') THEN 'Remote (EEA)'
  WHEN list_contains(regions, 'EMEA') THEN 'Remote (EMEA)' WHEN list_contains(regions, 'EUROPE') THEN 'Remote (EUROPE)'
  WHEN len(codes) > 0 THEN 'Remote (' || array_to_string(codes, ', ') || ')' ELSE 'Remote' END"""


def _verdicts(spark, sf):
    return G.with_eligibility(_texts(spark, sf))


@catalog.add(
    "geo_eligibility",
    S.with_(*_GEO_CTES, _VERDICT, select="""SELECT doc_id, CAST(eligible AS INTEGER) AS eligible, confidence,
      array_to_string(codes, ',') AS countries, array_to_string(regions, ',') AS regions, reason FROM verdicts"""),
)
def eligibility(spark, sf):
    return _verdicts(spark, sf).select(
        "doc_id",
        F.col("geo.eligible").cast("int").alias("eligible"),
        F.col("geo.confidence").alias("confidence"),
        F.array_join("geo.countries", ",").alias("countries"),
        F.array_join("geo.regions", ",").alias("regions"),
        F.col("geo.reason").alias("reason"),
    )


@catalog.add(
    "geo_implied_regions",
    S.with_(_DIM, f"""asked AS (SELECT doc_id, {S.pick(_CODES, 'doc_id')} AS a,
        {S.pick(_CODES, 'doc_id * 3 + 1')} AS b, {S.pick(['EUROPE', 'EMEA', 'WORLDWIDE'], 'doc_id')} AS e
        FROM documents)""",
            """regions AS (SELECT code, 'EU' AS region, 0 AS o FROM countries WHERE eu = 1
          UNION ALL SELECT code, 'EEA', 1 FROM countries WHERE eea = 1
          UNION ALL SELECT code, 'EUROPE', 2 FROM countries WHERE europe = 1
          UNION ALL SELECT code, 'EMEA', 3 FROM countries WHERE emea = 1)""",
            select="""SELECT doc_id, string_agg(region, ',' ORDER BY place) AS regions FROM (
      SELECT doc_id, region, min(place) AS place FROM (
        SELECT doc_id, e AS region, 0 AS place FROM asked
        UNION ALL SELECT doc_id, region, 10 + o FROM asked JOIN regions ON code = upper(a)
        UNION ALL SELECT doc_id, region, 20 + o FROM asked JOIN regions ON code = upper(b)) x
      GROUP BY doc_id, region) y GROUP BY doc_id"""),
)
def implied_regions(spark, sf):
    doc = F.col("doc_id")
    codes = F.array(B.pick(_CODES, doc), B.pick(_CODES, doc * 3 + 1))
    explicit = F.array(B.pick(["EUROPE", "EMEA", "WORLDWIDE"], doc))
    return B.read(spark, sf, "documents").select(
        "doc_id", F.array_join(G.implied_regions(codes, explicit), ",").alias("regions")
    )


@catalog.add(
    "geo_supported_country",
    S.with_(_DIM, _CODED, select="""SELECT doc_id, CASE WHEN c.europe = 1 OR c.code = 'US' THEN 1 ELSE 0 END AS supported
      FROM coded LEFT JOIN countries c ON c.code = coded.code"""),
)
def supported_country(spark, sf):
    return _coded(spark, sf).select("doc_id", G.supported(F.col("code")).cast("int").alias("supported"))


@catalog.add(
    "geo_location_label",
    S.with_(*_GEO_CTES, _VERDICT, select=f"SELECT doc_id, {_LABEL} AS label FROM verdicts"),
)
def location_label(spark, sf):
    return _verdicts(spark, sf).select(
        "doc_id", G.location_label(F.col("geo.regions"), F.col("geo.countries")).alias("label")
    )


# --- gates and the whole pass -----------------------------------------------------------

_STATUS = """CASE WHEN role = 'OTHER' THEN 'REJECTED_ROLE_CATEGORY'
  WHEN NOT eligible THEN 'REJECTED_GEOGRAPHY' ELSE 'PENDING' END"""


@catalog.add(
    "flt_gates",
    S.with_(*_GEO_CTES, _VERDICT, _TITLES, select=f"""SELECT doc_id, {_STATUS} AS status
      FROM titles JOIN verdicts USING (doc_id)"""),
)
def gates(spark, sf):
    raw = B.raw_postings(spark, sf)
    return P.classify(raw).select("doc_id", "status").unionByName(
        P.rejected_roles(raw).select("doc_id", "status")
    )


@catalog.add(
    "classification_funnel",
    S.with_(*_GEO_CTES, _VERDICT, _TITLES, select=f"""SELECT role AS role_category, {_STATUS} AS status,
      CASE WHEN role <> 'OTHER' THEN confidence END AS geo_confidence, count(*) AS postings
      FROM titles JOIN verdicts USING (doc_id) GROUP BY ALL"""),
)
def classification_funnel(spark, sf):
    return P.funnel(B.raw_postings(spark, sf))


@catalog.add(
    "classified_postings",
    S.with_(*_GEO_CTES, _VERDICT, _TITLES, _PREFERRED,
            select=f"""SELECT doc_id, role AS role_category, t.seniority,
      {S.normalized_title('t.raw_title', 'role', 't.seniority')} AS normalized_title, {_STATUS} AS status,
      p.employment_type, p.salary_min, p.salary_max, p.salary_currency, p.salary_period,
      coalesce(t.remote_type, 'FULLY_REMOTE') AS remote_type, {_LABEL} AS location_display,
      {S.company_slug('t.company_name')} AS company_slug,
      {S.fingerprint('t.company_name', S.normalized_title('t.raw_title', 'role', 't.seniority'), _LABEL)} AS fingerprint
      FROM titles t JOIN verdicts USING (doc_id) JOIN preferred p USING (doc_id) WHERE role <> 'OTHER'"""),
)
def classified_postings(spark, sf):
    return P.classify(B.raw_postings(spark, sf)).select(
        "doc_id", "role_category", "seniority", "normalized_title", "status", "employment_type", "salary_min",
        "salary_max", "salary_currency", "salary_period", "remote_type", "location_display", "company_slug",
        "fingerprint",
    )
