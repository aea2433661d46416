"""Text, field and label functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.catalog import Catalog, sql as S
from vacantia.functions import fields as FL
from vacantia.functions import labels as L
from vacantia.functions import text as T
from vacantia.plans import binding as B
from vacantia.plans.session import written

catalog = Catalog()

LOOKED_FOR = ["remote worldwide", "apac only", "c#", ".net", "react.js", "go", "the", "des"]


def _flag(column):
    return F.coalesce(column, F.lit(False)).cast("int")


@catalog.add("txt_strip_html", f"SELECT page_id, {S.strip_html('html')} AS plain FROM pages")
def strip_html(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@catalog.add(
    "txt_phrase_match",
    S.with_(S.POSTINGS, select="SELECT doc_id, " + ", ".join(
        f"CAST({S.has('lower(description)', p)} AS INTEGER) AS p{i}" for i, p in enumerate(LOOKED_FOR)
    ) + " FROM postings"),
)
def phrase_match(spark, sf):
    hits = [_flag(T.has_phrase(F.col("description"), p)).alias(f"p{i}") for i, p in enumerate(LOOKED_FOR)]
    return B.raw_postings(spark, sf).select("doc_id", *hits)


@catalog.add(
    "txt_first_match",
    S.with_(S.POSTINGS, select=f"""SELECT doc_id,
      {S.case([(S.has('lower(description)', p), p) for p in LOOKED_FOR])} AS first_phrase FROM postings"""),
)
def first_match(spark, sf):
    return B.raw_postings(spark, sf).select(
        "doc_id", T.first_match(F.col("description"), LOOKED_FOR).alias("first_phrase")
    )


@catalog.add(
    "txt_all_matches",
    S.with_(S.POSTINGS, select="SELECT doc_id, concat_ws(',', " + ", ".join(
        f"CASE WHEN {S.has('lower(description)', p)} THEN {S.lit(p)} END" for p in LOOKED_FOR
    ) + ") AS phrases FROM postings"),
)
def all_matches(spark, sf):
    return B.raw_postings(spark, sf).select(
        "doc_id", F.array_join(T.all_matches(F.col("description"), LOOKED_FOR), ",").alias("phrases")
    )


@catalog.add(
    "txt_exact_token",
    S.with_(S.POSTINGS, select="SELECT doc_id, " + ", ".join(
        f"CAST(regexp_matches(description, '(^|[^A-Za-z0-9]){t}($|[^A-Za-z0-9])') AS INTEGER) AS {a}"
        for t, a in [("Go", "go"), ("The", "the_word"), ("REMOTE", "remote_word")]
    ) + " FROM postings"),
)
def exact_token(spark, sf):
    text = F.col("description")
    return B.raw_postings(spark, sf).select(
        "doc_id",
        _flag(T.has_token(text, "Go")).alias("go"),
        _flag(T.has_token(text, "The")).alias("the_word"),
        _flag(T.has_token(text, "REMOTE")).alias("remote_word"),
    )


@catalog.add(
    "txt_checksum",
    S.with_(S.POSTINGS, select="SELECT doc_id, sha256(raw_payload) AS checksum FROM postings"),
)
def checksum(spark, sf):
    return B.raw_postings(spark, sf).select("doc_id", T.checksum(F.col("raw_payload")).alias("checksum"))


@catalog.add(
    "txt_fingerprint",
    S.with_(S.POSTINGS, select=f"""SELECT doc_id,
      {S.fingerprint('company_name', 'raw_title', 'description')} AS fingerprint FROM postings"""),
)
def fingerprint(spark, sf):
    return B.raw_postings(spark, sf).select(
        "doc_id",
        T.fingerprint(F.col("company_name"), F.col("raw_title"), F.col("description")).alias("fingerprint"),
    )


@catalog.add(
    "txt_company_slug",
    S.with_(S.POSTINGS, select=f"""SELECT doc_id, {S.company_slug('company_name')} AS slug,
      sha256({S.company_slug('description')}) AS text_slug FROM postings"""),
)
def company_slug(spark, sf):
    return B.raw_postings(spark, sf).select(
        "doc_id",
        T.company_slug(F.col("company_name")).alias("slug"),
        F.sha2(T.company_slug(F.col("description")), 256).alias("text_slug"),
    )


@catalog.add(
    "txt_company_name",
    S.with_(S.POSTINGS, select=f"""SELECT doc_id, {S.company_norm("company_name || ' scan'")} AS with_tail,
      {S.company_norm('company_name')} AS plain FROM postings"""),
)
def company_name(spark, sf):
    name = F.col("company_name")
    return B.raw_postings(spark, sf).select(
        "doc_id",
        T.normalize_company_name(F.concat(name, F.lit(" scan"))).alias("with_tail"),
        T.normalize_company_name(name).alias("plain"),
    )


@catalog.add(
    "txt_apply_url",
    f"SELECT page_id, {S.apply_url('url')} AS normal, {S.apply_url('html')} AS not_a_url FROM pages",
)
def apply_url(spark, sf):
    return B.read(spark, sf, "pages").select(
        "page_id",
        T.normalize_apply_url(F.col("url")).alias("normal"),
        T.normalize_apply_url(F.col("html")).alias("not_a_url"),
    )


def _neighbours(spark, sf):
    docs = B.raw_postings(spark, sf)
    left = docs.select("doc_id", "raw_title", F.col("description").alias("a"))
    right = docs.select(
        (F.col("doc_id") - 1).alias("doc_id"), F.col("raw_title").alias("next_title"),
        F.col("description").alias("b"),
    )
    return left.join(right, "doc_id")


_NEIGHBOURS = """pairs AS (
  SELECT l.doc_id, l.raw_title, r.raw_title AS next_title, l.description AS a, r.description AS b
  FROM postings l JOIN postings r ON r.doc_id = l.doc_id + 1)"""


@catalog.add(
    "txt_trigram_dice",
    S.with_(S.POSTINGS, _NEIGHBOURS,
            f"padded AS MATERIALIZED (SELECT doc_id, {S.padded('a')} AS a, {S.padded('b')} AS b FROM pairs)",
            f"grams AS MATERIALIZED (SELECT doc_id, {S.dice_grams('a')} AS a, {S.dice_grams('b')} AS b FROM padded)",
            select=f"SELECT doc_id, round({S.dice('a', 'b')}, 9) AS similarity FROM grams"),
)
def trigram_dice(spark, sf):
    return _neighbours(spark, sf).select(
        "doc_id", F.round(T.trigram_dice(F.col("a"), F.col("b")), 9).alias("similarity")
    )


@catalog.add(
    "txt_word_similarity",
    S.with_(S.POSTINGS, _NEIGHBOURS, f"""grams AS (SELECT doc_id, {S.word_grams('raw_title')} AS a,
      {S.word_grams('next_title')} AS b, {S.word_grams('a')} AS c, {S.word_grams('b')} AS d FROM pairs)""",
            select="""SELECT doc_id,
      round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS titles,
      round(len(list_intersect(c, d)) / len(list_distinct(list_concat(c, d))), 9) AS texts FROM grams"""),
)
def word_similarity(spark, sf):
    # A document is the left one of a pair and the right one of another: its sets are made once.
    docs = written(B.raw_postings(spark, sf).select(
        "doc_id", T.word_grams(F.col("raw_title")).alias("titles"), T.word_grams(F.col("description")).alias("texts")
    ))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("titles").alias("next_titles"), F.col("texts").alias("next_texts"))
    return docs.join(after, "doc_id").select(
        "doc_id", F.round(T.pg_similarity(F.col("titles"), F.col("next_titles"), made=True), 9).alias("titles"),
        F.round(T.pg_similarity(F.col("texts"), F.col("next_texts"), made=True), 9).alias("texts"),
    )


_CODES = ["EUR", "USD", "GBP", "PLN", None]
_PERIODS = ["YEARLY", "MONTHLY", "DAILY", "HOURLY", None]
_AMOUNT = (
    "CASE WHEN {0} >= 1000 THEN CAST(CAST(floor({0} / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'k' "
    "ELSE CAST(CAST({0} AS BIGINT) AS VARCHAR) END"
)


@catalog.add(
    "txt_salary_label",
    f"""WITH pay AS (SELECT o_orderkey AS job_id,
        CASE WHEN o_orderkey % 6 <> 0 THEN floor(o_totalprice / (o_orderkey % 900 + 1)) END AS low,
        CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice / (o_orderkey % 300 + 1)) END AS high,
        {S.pick(_CODES, 'o_orderkey')} AS code, {S.pick(_PERIODS, 'o_orderkey // 5')} AS period FROM orders),
      parts AS (SELECT *, coalesce(CASE code WHEN 'EUR' THEN '€' WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£'
          ELSE code || ' ' END, '') AS sign,
        coalesce(CASE period WHEN 'YEARLY' THEN '/yr' WHEN 'MONTHLY' THEN '/mo' WHEN 'DAILY' THEN '/day'
          WHEN 'HOURLY' THEN '/hr' END, '') AS tail FROM pay)
      SELECT job_id, CASE
        WHEN low IS NOT NULL AND high IS NOT NULL AND low <> high THEN sign || {_AMOUNT.format('low')} ||
          ' - ' || sign || {_AMOUNT.format('high')} || tail
        ELSE sign || {_AMOUNT.format('coalesce(high, low)')} || tail END AS label FROM parts""",
)
def salary_label(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    pay = B.read(spark, sf, "orders").select(
        key.alias("job_id"),
        F.when(key % 6 != 0, F.floor(price / (key % 900 + 1)).cast("double")).alias("low"),
        F.when(key % 7 != 0, F.floor(price / (key % 300 + 1)).cast("double")).alias("high"),
        B.pick(_CODES, key).alias("code"),
        B.pick(_PERIODS, F.floor(key / 5)).alias("period"),
    )
    label = L.salary_label(F.col("low"), F.col("high"), F.col("code"), F.col("period"))
    return pay.select("job_id", label.alias("label"))


_AGE = "(event_id * 977) % 9000000"
_PLURAL = "CAST({0} AS BIGINT) || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END || ' ago'"


@catalog.add(
    "txt_relative_label",
    f"""WITH ages AS (SELECT event_id, {_AGE} AS s FROM events),
      parts AS (SELECT event_id, s // 60 AS m, s // 3600 AS h, s // 86400 AS d FROM ages)
      SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN {_PLURAL.format('m', 'minute')}
        WHEN h < 24 THEN {_PLURAL.format('h', 'hour')} WHEN d < 30 THEN {_PLURAL.format('d', 'day')}
        ELSE {_PLURAL.format('(d // 30)', 'month')} END AS label FROM parts""",
)
def relative_label(spark, sf):
    age = (F.col("event_id") * 977) % 9000000
    return B.read(spark, sf, "events").select("event_id", L.relative_label(age).alias("label"))


# --- fields -----------------------------------------------------------------------------

_REMOTE = ["Hybrid (remote 2 days)", "Fully Remote", "true", "On-site", None, "REMOTE_FIRST", "TRUE "]
_EMPLOYMENT = ["Full_Time", "part-time", "ParttTime", "CONTRACTOR", "Internship (full time)", "Freelance",
               "temporary", None, "Permanent", "other", "PartTime"]
_PERIOD = ["per-hour-wage", "1 DAY", "monthly", "Annual", "YEAR", None, "week", "per-month-salary"]


def _low(expr: str) -> str:
    return f"lower(coalesce({expr}, ''))"


def _field_query(name, values, rule, function):
    sql = f"SELECT doc_id, {rule} AS value FROM (SELECT doc_id, {_low(S.pick(values, 'doc_id'))} AS v FROM documents)"

    def query(spark, sf):
        return B.read(spark, sf, "documents").select(
            "doc_id", function(B.pick(values, F.col("doc_id"))).alias("value")
        )

    catalog.add(name, sql)(query)


_field_query(
    "fld_remote_type", _REMOTE,
    "CASE WHEN contains(v, 'hybrid') THEN 'HYBRID' WHEN contains(v, 'remote') OR v = 'true' "
    "THEN 'FULLY_REMOTE' ELSE 'UNKNOWN' END",
    FL.remote_type,
)
_V = "replace(replace(v, '_', ' '), '-', ' ')"
_field_query(
    "fld_employment_type", _EMPLOYMENT,
    f"CASE WHEN contains({_V}, 'intern') THEN 'INTERNSHIP' "
    f"WHEN contains({_V}, 'part time') OR contains({_V}, 'parttime') THEN 'PART_TIME' "
    f"WHEN contains({_V}, 'freelance') THEN 'FREELANCE' "
    f"WHEN contains({_V}, 'contract') OR contains({_V}, 'temporary') THEN 'CONTRACT' "
    f"WHEN contains({_V}, 'full time') OR contains({_V}, 'permanent') THEN 'PERMANENT' END",
    FL.structured_employment_type,
)
_field_query(
    "fld_salary_period", _PERIOD,
    "CASE WHEN contains(v, 'hour') THEN 'HOURLY' WHEN contains(v, 'day') THEN 'DAILY' "
    "WHEN contains(v, 'month') THEN 'MONTHLY' WHEN contains(v, 'year') OR contains(v, 'annual') "
    "THEN 'YEARLY' END",
    FL.structured_salary_period,
)

_DIRTY = "'€ ' || CAST(doc_id AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN ',500' WHEN 1 THEN '.5' WHEN 2 THEN '.1.2' WHEN 3 THEN ' k-' ELSE '' END"


@catalog.add(
    "fld_lenient_number",
    f"""SELECT doc_id, floor(TRY_CAST(nullif(regexp_replace({_DIRTY}, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE)
      + 0.5) AS value FROM documents""",
)
def lenient_number(spark, sf):
    doc = F.col("doc_id")
    tail = (
        F.when(doc % 5 == 0, ",500").when(doc % 5 == 1, ".5").when(doc % 5 == 2, ".1.2")
        .when(doc % 5 == 3, " k-").otherwise("")
    )
    return B.read(spark, sf, "documents").select(
        "doc_id", FL.lenient_number(F.concat(F.lit("€ "), doc.cast("string"), tail)).alias("value")
    )


_SECONDS = f"({B.BASE_EPOCH} + (doc_id * 7919) % 2592000)"


def _date_texts():
    """The same instant in the notations sources use, by document."""
    doc = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(B.BASE_EPOCH) + (doc * 7919) % 2592000)
    utc = F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), "UTC")
    return (
        F.when(doc % 6 == 0, F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(doc % 6 == 1, F.concat(F.date_format(utc, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(doc % 6 == 2, F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
        .when(doc % 6 == 3, F.concat(F.date_format(utc, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(doc % 6 == 4, F.lit("not a date"))
    )


@catalog.add(
    "fld_lenient_date",
    f"SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN {_SECONDS} END AS epoch FROM documents",
)
def lenient_date(spark, sf):
    return B.read(spark, sf, "documents").select(
        "doc_id", F.unix_seconds(FL.lenient_date(_date_texts())).alias("epoch")
    )


_AGO = [("minute", 60), ("hours", 3600), ("days", 86400), ("weeks", 604800), ("month", 2592000)]


@catalog.add(
    "fld_relative_date",
    f"""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN {B.BASE_EPOCH} ELSE {B.NOW_EPOCH} - doc_id *
      CASE doc_id % 6 {' '.join(f'WHEN {i} THEN {s}' for i, (_, s) in enumerate(_AGO))} END END AS epoch
      FROM documents""",
)
def relative_date(spark, sf):
    doc = F.col("doc_id")
    units = [u for u, _ in _AGO] + [None]
    text = F.when(doc % 6 == 5, "2024-01-01T00:00:00Z").otherwise(
        F.concat(F.lit("Posted "), doc.cast("string"), F.lit(" "), B.pick(units, doc), F.lit(" ago"))
    )
    now = F.timestamp_seconds(F.lit(B.NOW_EPOCH))
    return B.read(spark, sf, "documents").select(
        "doc_id", F.unix_seconds(FL.relative_date(text, now)).alias("epoch")
    )


_PLACES = ["Hybrid work", "TELECOMMUTE", "remotely done", "Remote", "on site", "On-Site", "office-based",
           None, "remote or hybrid", "the onsite team"]


@catalog.add(
    "fld_workplace",
    f"""SELECT doc_id, CASE
      WHEN regexp_matches(v, '(^|[^a-z0-9_])hybrid($|[^a-z0-9_])') THEN 'hybrid'
      WHEN regexp_matches(v, '(^|[^a-z0-9_])remote($|[^a-z0-9_])|telecommute') THEN 'remote'
      WHEN regexp_matches(v, '(^|[^a-z0-9_])(on[ -]?site|office-based)($|[^a-z0-9_])') THEN 'on-site' END AS kind
      FROM (SELECT doc_id, lower(concat_ws(' ', {S.pick(_PLACES, 'doc_id')}, text)) AS v FROM documents)""",
)
def workplace(spark, sf):
    return B.read(spark, sf, "documents").select(
        "doc_id", FL.workplace(B.pick(_PLACES, F.col("doc_id")), F.col("text")).alias("kind")
    )


_ID_FORMS = ["urn:li:jobPosting:", "https://x.example.com/jobs/view/senior-dev-at-a-",
             "https://x.example.com/search?a=1&amp;currentJobId=", "https://x.example.com/jobs/",
             "nothing-"]


@catalog.add(
    "fld_job_id",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN CAST(doc_id AS VARCHAR) END AS job_id,
      CASE WHEN doc_id % 5 = 3 THEN CAST(doc_id AS VARCHAR) END AS numbered FROM documents""",
)
def job_id(spark, sf):
    doc = F.col("doc_id")
    url = F.concat(B.pick(_ID_FORMS, doc), doc.cast("string"), F.when(doc % 5 == 3, "-dev").otherwise(""))
    return B.read(spark, sf, "documents").select(
        "doc_id", FL.job_id_from_url(url).alias("job_id"), FL.numbered_job_id(url).alias("numbered")
    )


_HOSTS = ["https://boards.greenhouse.io/acme/", "https://eu.jobs.lever.co/x", "http://acme.myworkdayjobs.com/",
          "https://jobs.personio.de/a", "https://notlever.co/", "not a url", "https://apply.workable.com:443/z",
          "https://JOBS.ashbyhq.com/b", "https://acme.recruitee.com/o", None]
_ATS = ["greenhouse", "lever", "workday", "personio", "unknown", "unknown", "workable", "ashby", "recruitee",
        "unknown"]


@catalog.add(
    "fld_detect_ats",
    f"SELECT page_id, {S.pick(_ATS, 'page_id')} AS ats, 'unknown' AS own FROM pages",
)
def detect_ats(spark, sf):
    link = F.concat(B.pick(_HOSTS, F.col("page_id")), F.col("page_id").cast("string"))
    return B.read(spark, sf, "pages").select(
        "page_id", FL.detect_ats(link).alias("ats"), FL.detect_ats(F.col("url")).alias("own")
    )


@catalog.add(
    "fld_access_wall",
    """SELECT page_id, CASE
      WHEN regexp_matches(v, 'captcha-internal|g-recaptcha|captcha challenge') THEN 'captcha'
      WHEN regexp_matches(v, '/checkpoint/challenge|security verification|challenge-page') THEN 'challenge'
      WHEN regexp_matches(v, 'authwall|<title>\\s*(sign in|join linkedin)|class=["''][^"'']*login__form')
        THEN 'login' END AS wall
      FROM (SELECT page_id, lower(html || CASE page_id % 6 WHEN 0 THEN '<div class="G-Recaptcha">'
        WHEN 1 THEN 'Security Verification' WHEN 2 THEN '<form class="x login__form">' ELSE '' END) AS v
        FROM pages)""",
)
def access_wall(spark, sf):
    page = F.col("page_id")
    extra = (
        F.when(page % 6 == 0, '<div class="G-Recaptcha">').when(page % 6 == 1, "Security Verification")
        .when(page % 6 == 2, '<form class="x login__form">').otherwise("")
    )
    return B.read(spark, sf, "pages").select(
        "page_id", FL.access_wall(F.concat("html", extra)).alias("wall")
    )
