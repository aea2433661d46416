"""Sources over payloads built from the test tables: one landed payload per document.

Spark goes through the payload text; the check SQL says what must come out of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.catalog import Catalog, sql as S
from vacantia.plans import binding as B
from vacantia.sources import feeds, json_boards, pages

catalog = Catalog()

OUT = ["external_id", "raw_title", "raw_location", "company_name", "apply_url", "remote_type", "employment_type",
       "salary_min", "salary_max", "salary_currency", "salary_period"]
_DOUBLES = {"salary_min", "salary_max"}


def docs(spark, sf):
    at = F.timestamp_seconds(F.col("epoch"))
    doc = F.col("doc_id")
    return B.raw_postings(spark, sf).withColumn("epoch", F.lit(B.BASE_EPOCH) + (doc * 7919) % 2592000).withColumns(
        {
            "iso": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"),
            "mail": F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z"),
            "board": F.col("source_slug"),
            "page_url": F.concat(F.lit("https://pages.example.com/jobs/view/dev-"), doc.cast("string")),
            "kind": B.pick(_KINDS, doc), "place_kind": B.pick(_PLACE_KINDS, doc), "unit": B.pick(_UNITS, doc),
        }
    )


_KINDS = ["Full_Time", "part-time", "Contract", None, "Internship"]
_PLACE_KINDS = ["Hybrid", "Remote", "on-site", None]
_UNITS = ["per-year", "MONTH", "hour", None, "day", "annual", "other"]
_DOCS = f"""docs AS (SELECT *, {B.BASE_EPOCH} + (doc_id * 7919) % 2592000 AS epoch, 'Co ' || source_slug AS board_company,
  {S.pick(_KINDS, 'doc_id')} AS kind, {S.pick(_PLACE_KINDS, 'doc_id')} AS place_kind, {S.pick(_UNITS, 'doc_id')} AS unit,
  'https://pages.example.com/jobs/view/dev-' || doc_id AS page_url FROM postings)"""


def companies(spark, sf):
    boards = B.read(spark, sf, "documents").select(F.col("source").alias("board")).distinct()
    return boards.select(
        "board", F.concat(F.lit("Co "), F.col("board")).alias("company_name"),
        F.lit("https://co.example.com").alias("company_url"), F.col("board").alias("account"),
        F.lit("jobs.personio.de").alias("host"),
    )


def _remote(x: str) -> str:
    v = f"lower(coalesce({x}, ''))"
    return f"CASE WHEN contains({v}, 'hybrid') THEN 'HYBRID' WHEN contains({v}, 'remote') OR {v} = 'true' THEN 'FULLY_REMOTE' ELSE 'UNKNOWN' END"


def _employment(x: str) -> str:
    v = f"translate(lower(coalesce({x}, '')), '_-', '  ')"
    return (
        f"CASE WHEN contains({v}, 'intern') THEN 'INTERNSHIP' WHEN contains({v}, 'part time') THEN 'PART_TIME' "
        f"WHEN contains({v}, 'freelance') THEN 'FREELANCE' WHEN contains({v}, 'contract') THEN 'CONTRACT' "
        f"WHEN contains({v}, 'full time') THEN 'PERMANENT' END"
    )


def _period(x: str) -> str:
    v = f"lower(coalesce({x}, ''))"
    return (
        f"CASE WHEN contains({v}, 'hour') THEN 'HOURLY' WHEN contains({v}, 'day') THEN 'DAILY' WHEN contains({v}, 'month') "
        f"THEN 'MONTHLY' WHEN contains({v}, 'year') OR contains({v}, 'annual') THEN 'YEARLY' END"
    )


def _finish(postings):
    return postings.select(
        *OUT, F.unix_seconds("posted_at").alias("epoch"), F.sha2("description", 256).alias("text_hash")
    )


def source(name: str, where: str = "true", **expected: str):
    """Register a source query; ``expected`` gives the columns that are not null."""
    text = expected.pop("text")
    epoch = expected.pop("epoch", "epoch")
    columns = [
        f"CAST({expected.get(c, 'NULL')} AS {'DOUBLE' if c in _DOUBLES else 'VARCHAR'}) AS {c}" for c in OUT
    ]
    sql = S.with_(S.POSTINGS, _DOCS, select=f"""SELECT {', '.join(columns)}, CAST({epoch} AS BIGINT) AS epoch,
      sha256({text}) AS text_hash FROM docs WHERE {where}""")

    def register(query):
        return catalog.add(f"src_{name}", sql)(lambda spark, sf: _finish(query(spark, sf)))

    return register


def _landed(rows, payload):
    return rows.select("board", "page_url", payload.alias("payload"))


def _jobs(field, *jobs):
    """A payload with the jobs under a field, or as the array itself."""
    listed = F.array(*jobs)
    return F.to_json(listed if field is None else F.struct(listed.alias(field)))


def c(name, alias=None):
    return F.col(name).alias(alias or name)


ID = "CAST(doc_id AS VARCHAR)"
def num():
    return F.col("doc_id")


@source("greenhouse", external_id=ID, raw_title="raw_title", company_name="board_company", apply_url="apply_url",
        raw_location="CASE WHEN doc_id % 3 = 0 THEN 'Remote office' ELSE raw_location END",
        remote_type="CASE WHEN doc_id % 3 = 0 OR contains(lower(raw_location), 'remote') THEN 'FULLY_REMOTE' ELSE 'UNKNOWN' END",
        text="description")
def greenhouse(spark, sf):
    place = F.when(num() % 3 != 0, F.struct(c("raw_location", "name")))
    job = F.struct(
        c("doc_id", "id"), c("raw_title", "title"), c("iso", "updated_at"), c("apply_url", "absolute_url"),
        place.alias("location"), c("description", "content"),
        F.array(F.struct(F.lit("Remote office").alias("name"))).alias("offices"),
    )
    return json_boards.greenhouse(_landed(docs(spark, sf), _jobs("jobs", job)), companies(spark, sf))


@source("lever", external_id="'lv-' || doc_id", raw_title="raw_title", raw_location="raw_location", company_name="board_company",
        apply_url="CASE WHEN doc_id % 2 = 0 THEN apply_url || '/apply' ELSE apply_url END",
        remote_type=_remote("coalesce(place_kind, raw_location)"), employment_type=_employment("kind"),
        salary_min="doc_id * 100 + 1", salary_max="doc_id * 200", salary_currency="'EUR'", salary_period=_period("unit"),
        text="description")
def lever(spark, sf):
    job = F.struct(
        F.concat(F.lit("lv-"), num().cast("string")).alias("id"), c("raw_title", "text"), c("apply_url", "hostedUrl"),
        F.when(num() % 2 == 0, F.concat("apply_url", F.lit("/apply"))).alias("applyUrl"),
        (F.col("epoch") * 1000).alias("createdAt"), c("place_kind", "workplaceType"),
        F.struct(c("raw_location", "location"), c("kind", "commitment")).alias("categories"),
        c("description", "descriptionPlain"),
        F.struct((num() * 100 + 0.6).alias("min"), (num() * 200).alias("max"), F.lit("EUR").alias("currency"), c("unit", "interval")).alias("salaryRange"),
    )
    return json_boards.lever(_landed(docs(spark, sf), _jobs(None, job)), companies(spark, sf))


@source("ashby", external_id=ID, raw_title="raw_title", raw_location="raw_location", company_name="board_company",
        apply_url="apply_url", remote_type=f"CASE WHEN doc_id % 3 = 0 THEN 'FULLY_REMOTE' ELSE {_remote('place_kind')} END",
        employment_type=_employment("kind"), salary_min="doc_id", salary_max="doc_id + 5", salary_currency="'USD'",
        salary_period=_period("unit"), text="description")
def ashby(spark, sf):
    job = F.struct(
        num().cast("string").alias("id"), c("raw_title", "title"), c("raw_location", "location"), c("iso", "publishedAt"),
        c("apply_url", "jobUrl"), c("description", "descriptionHtml"), (num() % 3 == 0).alias("isRemote"),
        c("place_kind", "workplaceType"), c("kind", "employmentType"),
        F.struct(num().alias("minValue"), (num() + 5).alias("maxValue"), F.lit("USD").alias("currency"), c("unit", "interval")).alias("compensation"),
    )
    return json_boards.ashby(_landed(docs(spark, sf), _jobs("jobs", job)), companies(spark, sf))


@source("smartrecruiters", where="doc_id % 5 <> 4", external_id=ID, raw_title="raw_title", raw_location="raw_location",
        company_name="board_company", apply_url="apply_url", text="description || chr(10) || 'About ' || source_slug")
def smartrecruiters(spark, sf):
    rows = docs(spark, sf)
    ident = num().cast("string").alias("id")
    lists = _landed(rows.filter(num() % 5 != 4), _jobs("content", F.struct(ident, c("raw_title", "name"))))
    section = F.struct(c("description", "text"))
    empty, about = F.struct(F.lit("").alias("text")), F.struct(F.concat(F.lit("About "), "source_slug").alias("text"))
    detail = F.to_json(F.struct(
        ident, c("raw_title", "name"), F.struct(c("raw_location", "fullLocation")).alias("location"),
        c("iso", "releasedDate"), c("apply_url", "postingUrl"), c("apply_url", "applyUrl"),
        F.struct(F.struct(section.alias("job"), empty.alias("none"), about.alias("company")).alias("sections")).alias("jobAd"),
    ))
    return json_boards.smartrecruiters(lists, _landed(rows, detail), companies(spark, sf))


@source("workable", where="doc_id % 7 <> 0", external_id="'wk' || doc_id", raw_title="raw_title", company_name="board_company",
        raw_location="""CASE WHEN doc_id % 2 = 0 THEN 'Porto, Portugal; ' || raw_location ELSE concat_ws(', ', nullif(raw_location, ''), 'PT') END""",
        apply_url="apply_url", remote_type=f"CASE WHEN doc_id % 4 = 0 THEN 'FULLY_REMOTE' ELSE {_remote('place_kind')} END",
        employment_type=_employment("kind"), salary_min="doc_id", salary_currency="'EUR'", salary_period=_period("unit"),
        text="description")
def workable(spark, sf):
    places = F.array(
        F.struct(F.lit("Porto").alias("city"), F.lit("Portugal").alias("country")),
        F.struct(c("raw_location", "city"), F.lit("").alias("country")),
    )
    job = F.struct(
        F.when(num() % 3 == 0, F.concat(F.lit("wk"), num().cast("string"))).alias("shortcode"),
        F.concat(F.lit("wk"), num().cast("string")).alias("code"),
        F.when(num() % 7 != 0, F.col("raw_title")).alias("title"), c("description"), c("raw_location", "city"),
        F.lit("PT").alias("country"), (num() % 4 == 0).alias("telecommuting"), c("place_kind", "workplace_type"),
        c("kind", "employment_type"), c("iso", "published_on"), c("apply_url", "url"),
        F.when(num() % 2 == 0, places).alias("locations"),
        F.struct(num().alias("salary_from"), F.lit("EUR").alias("salary_currency"), c("unit", "salary_period")).alias("salary"),
    )
    return json_boards.workable(_landed(docs(spark, sf), _jobs("jobs", job)), companies(spark, sf))


@catalog.add(
    "src_workable_collapse",
    S.with_(S.POSTINGS, _DOCS, select="""SELECT 'wk' || doc_id AS external_id, CASE WHEN doc_id % 2 = 0 THEN raw_title ELSE raw_title || ' I' END AS raw_title,
      concat_ws('; ', CASE WHEN doc_id % 2 = 1 THEN 'Faro' END, 'Porto', 'Braga') AS raw_location, CAST(3 AS BIGINT) AS payloads FROM docs"""),
)
def workable_collapse(spark, sf):
    """The same id in three rows of its board: two offices, one of them twice with other titles."""
    def row(city, suffix):
        return F.struct(
            F.concat(F.lit("wk"), num().cast("string")).alias("code"), F.concat("raw_title", F.lit(suffix)).alias("title"),
            F.when(F.lit(city == "Porto") & (num() % 2 == 1), "Faro").otherwise(city).alias("city"), c("apply_url", "url"),
        )

    payload = F.to_json(F.struct(F.array(row("Porto", ""), row("Braga", " II"), row("Porto", " III")).alias("jobs")))
    odd = F.to_json(F.struct(F.array(
        row("Porto", " I"),
        F.struct(F.concat(F.lit("wk"), num().cast("string")).alias("code"), F.concat("raw_title", F.lit(" II")).alias("title"),
                 F.lit("Porto").alias("city"), c("apply_url", "url")),
        row("Braga", " III")).alias("jobs")))
    landed = _landed(docs(spark, sf), F.when(num() % 2 == 0, payload).otherwise(odd))
    out = json_boards.workable_collapsed(json_boards.workable(landed, companies(spark, sf)))
    return out.select(
        "external_id", "raw_title", "raw_location",
        F.size(F.from_json("raw_payload", "array<string>")).cast("bigint").alias("payloads"),
    )


@source("pinpoint", where="doc_id % 6 <> 0", external_id=ID, raw_title="raw_title", company_name="board_company", apply_url="apply_url",
        raw_location="concat_ws(', ', nullif(raw_location, ''), 'ES')", remote_type=_remote("place_kind"),
        employment_type=_employment("kind"), salary_min="doc_id * 1000", salary_max="doc_id * 1000 + 1", salary_currency="'GBP'",
        salary_period=_period("unit"), text="description || chr(10) || 'Perks'")
def pinpoint(spark, sf):
    job = F.struct(
        num().alias("id"), c("raw_title", "title"), F.when(num() % 6 != 0, F.col("apply_url")).alias("url"), c("description"),
        F.lit("").alias("key_responsibilities"), F.lit("Perks").alias("benefits"), c("place_kind", "workplace_type"),
        c("kind", "employment_type"), F.when(num() % 2 == 0, F.col("iso")).alias("published_at"), c("iso", "created_at"),
        F.concat(F.lit("£"), F.format_number(num() * 1000, 0)).alias("compensation_minimum"),
        (num() * 1000 + 1).alias("compensation_maximum"), F.lit("GBP").alias("compensation_currency"),
        c("unit", "compensation_frequency"), F.struct(c("raw_location", "name"), F.lit("ES").alias("country")).alias("location"),
    )
    return json_boards.pinpoint(_landed(docs(spark, sf), _jobs("data", job)), companies(spark, sf))


_HN_TITLE = f"{S.trim('raw_title')} || CASE WHEN trim(raw_location) <> '' THEN ' | ' || raw_location ELSE '' END"


@source("hackernews", where="doc_id % 9 <> 0", external_id=ID, company_name="company_name",
        raw_title=_HN_TITLE, raw_location=_HN_TITLE, apply_url="'https://news.ycombinator.com/item?id=' || doc_id",
        text=f"""replace(company_name, '&', '&amp;') || ' (YC S20) |' || raw_title || '&#32;| ' || raw_location || ' |' || chr(10)
          || {S.trim("'<p>' || description")}""")
def hackernews(spark, sf):
    # The header ends in a bare pipe, trimmed away with the blank before the text.
    text = F.concat(
        F.replace("company_name", F.lit("&"), F.lit("&amp;")), F.lit(" (YC S20) |"), "raw_title", F.lit("&#32;| "),
        "raw_location", F.lit(" |"), F.lit("<p>"), "description",
    )
    item = F.struct(num().alias("id"), F.lit("comment").alias("type"), c("epoch", "time"), text.alias("text"),
                    F.when(num() % 9 == 0, F.lit(True)).alias("dead"))
    return json_boards.hackernews(_landed(docs(spark, sf), F.to_json(item)))


_NL2 = "chr(10) || chr(10)"


@source("himalayas", external_id="page_url", raw_title="raw_title", company_name="company_name",
        raw_location="CASE WHEN doc_id % 3 = 0 THEN 'Worldwide' ELSE raw_location || ', PT' END",
        apply_url="CASE WHEN doc_id % 2 = 0 THEN apply_url ELSE page_url END",
        text=f"""concat_ws({_NL2}, 'Employment type: ' || kind, CASE WHEN doc_id % 4 <> 0 THEN
          'Salary: EUR ' || doc_id || '–' || (doc_id + 9) || ' yearly' END, 'Seniority: Senior, Lead', description)""")
def himalayas(spark, sf):
    job = F.struct(
        c("page_url", "guid"), c("raw_title", "title"), c("company_name", "companyName"), c("kind", "employmentType"),
        F.when(num() % 4 != 0, num()).alias("minSalary"), F.when(num() % 4 != 0, num() + 9).alias("maxSalary"),
        F.lit("yearly").alias("salaryPeriod"), F.lit("EUR").alias("currency"),
        F.array(F.lit("Senior"), F.lit("Lead")).alias("seniority"),
        F.when(num() % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("raw_location", F.lit("PT"))).alias("locationRestrictions"),
        c("description"), c("epoch", "pubDate"), F.when(num() % 2 == 0, F.col("apply_url")).alias("applicationLink"),
    )
    return json_boards.himalayas(_landed(docs(spark, sf), _jobs("jobs", job)))


@source("jobgether", external_id=ID, raw_title="raw_title", raw_location="raw_location", company_name="company_name", apply_url="apply_url",
        text="""concat_ws(chr(10), 'Employment type: ' || kind, 'Remote: ' || place_kind, CASE WHEN doc_id % 2 = 0 THEN
          'Job functions: Dev, Ops' ELSE 'Job function: Dev' END)""")
def jobgether(spark, sf):
    many = F.array(F.lit("Dev"), F.lit("Ops"))
    job = F.struct(
        num().cast("string").alias("id"), c("raw_title", "title"), c("company_name", "company"), c("apply_url", "url"),
        c("raw_location", "location"), c("place_kind", "remote"), c("kind", "contractType"), F.lit("").alias("experience"),
        F.when(num() % 2 == 0, many).otherwise(F.array(F.lit("Dev"))).alias("jobFunctions"), c("iso", "postedAt"),
    )
    return json_boards.jobgether(_landed(docs(spark, sf), _jobs("jobs", job)))


@source("jobicy", external_id=ID, raw_title="raw_title", raw_location="raw_location", company_name="company_name", apply_url="apply_url",
        text=f"""concat_ws({_NL2}, 'Employment type: ' || kind, 'Level: Senior',
          CASE WHEN doc_id % 4 = 0 THEN 'short' ELSE description END)""")
def jobicy(spark, sf):
    job = F.struct(
        num().alias("id"), c("apply_url", "url"), c("raw_title", "jobTitle"), c("company_name", "companyName"),
        F.array_compact(F.array("kind")).alias("jobType"), c("raw_location", "jobGeo"), F.lit("Senior").alias("jobLevel"),
        F.lit("short").alias("jobExcerpt"), F.when(num() % 4 == 0, "").otherwise(F.col("description")).alias("jobDescription"),
        c("iso", "pubDate"),
    )
    return json_boards.jobicy(_landed(docs(spark, sf), _jobs("jobs", job)))


@source("landingjobs", external_id=ID, raw_title="raw_title", company_name="CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE 'Ki PerforMance ' || doc_id END",
        raw_location="CASE doc_id % 3 WHEN 0 THEN 'Lisbon, PT / ES' WHEN 1 THEN 'Remote' ELSE 'Unspecified' END",
        apply_url="CASE WHEN doc_id % 5 = 0 THEN apply_url ELSE 'https://landing.jobs/at/ki-perforMance-' || doc_id || '/dev' END",
        text=f"description || {_NL2} || 'Perks'")
def landingjobs(spark, sf):
    places = F.array(
        F.struct(F.lit("Lisbon").alias("city"), F.lit("PT").alias("country_code")),
        F.struct(F.lit(None).cast("string").alias("city"), F.lit("ES").alias("country_code")),
    )
    url = F.concat(F.lit("https://landing.jobs/at/ki-perforMance-"), num().cast("string"), F.lit("/dev"))
    job = F.struct(
        num().alias("id"), c("raw_title", "title"), F.when(num() % 5 == 0, F.col("apply_url")).otherwise(url).alias("url"),
        c("iso", "created_at"), F.when(num() % 2 == 0, F.col("iso")).alias("published_at"), (num() % 3 == 1).alias("remote"),
        F.when(num() % 3 == 0, places).alias("locations"), c("description", "role_description"), F.lit("Perks").alias("perks"),
    )
    return json_boards.landingjobs(_landed(docs(spark, sf), _jobs(None, job)))


@source("nofluffjobs", external_id=ID, raw_title="raw_title", company_name="company_name", apply_url="'https://nofluffjobs.com/job/x-' || doc_id",
        raw_location="CASE WHEN doc_id % 3 = 0 THEN 'Fully remote' WHEN doc_id % 3 = 1 THEN 'Krakow, Poland / Germany' ELSE 'Remote' END",
        text="""concat_ws(chr(10), 'Category: backend', 'Seniority: Senior', 'Requirements: Java, Kafka',
          CASE WHEN doc_id > 0 THEN 'Salary: PLN ' || doc_id || '– / Month' END)""")
def nofluffjobs(spark, sf):
    def place(city, country):
        return F.struct(F.lit(city).cast("string").alias("city"), F.when(F.lit(country).isNotNull(), F.struct(F.lit(country).alias("name"))).alias("country"))

    def tile(value, kind):
        return F.struct(F.lit(value).alias("value"), F.lit(kind).alias("type"))

    places = F.when(num() % 3 == 1, F.array(place("Krakow", "Poland"), place(None, "Germany"), place(None, None))).otherwise(F.array(place(None, None)))
    job = F.struct(
        num().cast("string").alias("id"), c("company_name", "name"), c("raw_title", "title"),
        F.concat(F.lit("x-"), num().cast("string")).alias("url"), (F.col("epoch") * 1000).alias("posted"),
        (num() % 3 == 0).alias("fullyRemote"), F.lit("backend").alias("category"), F.array(F.lit("Senior")).alias("seniority"),
        F.struct(places.alias("places")).alias("location"),
        F.struct(num().alias("from"), F.lit("PLN").alias("currency"), F.lit("Month").alias("period")).alias("salary"),
        F.struct(F.array(tile("Java", "requirement"), tile("EN", "jobLanguage"), tile("Kafka", "requirement")).alias("values")).alias("tiles"),
    )
    return json_boards.nofluffjobs(_landed(docs(spark, sf), _jobs("postings", job)))


@source("remoteok", external_id=ID, raw_title="raw_title", raw_location="raw_location", company_name="company_name", apply_url="apply_url",
        text="description")
def remoteok(spark, sf):
    job = F.struct(
        num().cast("string").alias("id"), c("company_name", "company"), c("raw_title", "position"), c("raw_location", "location"),
        c("iso", "date"), c("apply_url", "url"), c("description"),
    )
    payload = F.concat(F.lit('[{"legal":"notice"},'), F.to_json(job), F.lit("]"))
    return json_boards.remoteok(_landed(docs(spark, sf), payload))


@source("remotive", external_id=ID, raw_title="raw_title", raw_location="raw_location", company_name="company_name", apply_url="apply_url",
        text=f"""concat_ws({_NL2}, CASE WHEN doc_id % 2 = 0 THEN 'Salary: 10k' END,
          'Employment type: ' || CASE WHEN doc_id % 3 = 0 THEN 'Full-time' ELSE 'other' END, description)""")
def remotive(spark, sf):
    job = F.struct(
        num().alias("id"), c("apply_url", "url"), c("raw_title", "title"), F.concat(F.lit("  "), "company_name", F.lit(" ")).alias("company_name"),
        F.when(num() % 3 == 0, "full_time").otherwise("other").alias("job_type"), c("iso", "publication_date"),
        c("raw_location", "candidate_required_location"), F.when(num() % 2 == 0, "10k").otherwise("").alias("salary"), c("description"),
    )
    return json_boards.remotive(_landed(docs(spark, sf), _jobs("jobs", job)))


@source("workingnomads", external_id="apply_url", raw_title="raw_title", raw_location="raw_location", company_name="company_name",
        apply_url="apply_url", text=f"concat_ws({_NL2}, description, CASE WHEN doc_id % 2 = 0 THEN 'Tags: a,b' END)")
def workingnomads(spark, sf):
    job = F.struct(
        c("apply_url", "url"), c("raw_title", "title"), c("description"), c("company_name"),
        F.when(num() % 2 == 0, "a,b").alias("tags"), c("raw_location", "location"), c("iso", "pub_date"),
    )
    return json_boards.workingnomads(_landed(docs(spark, sf), _jobs(None, job)))


# --- feeds ------------------------------------------------------------------------------


def _escaped(column):
    out = F.col(column)
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def _tag(name, value):
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))


def _feed(rows, *tags):
    item = F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>feed</title><item>\n'), *tags, F.lit("</item></channel></rss>"))
    return _landed(rows, item)


_TRIM = S.trim("raw_title")
_LINK = "apply_url"
_BODY = S.trim("description")


def _basics(text=None):
    body = F.when(num() % 2 == 0, _escaped("description")).otherwise(
        F.concat(F.lit("<![CDATA["), F.replace(F.replace("description", F.lit("&"), F.lit("&amp;")), F.lit("]]>"), F.lit("")), F.lit("]]>"))
    )
    return [_tag("link", _escaped("apply_url")), _tag("guid", F.when(num() % 3 != 0, num().cast("string"))),
            _tag("description", body if text is None else text), _tag("pubDate", F.col("mail"))]


_GUID = f"CASE WHEN doc_id % 3 <> 0 THEN {ID} ELSE apply_url END"


@source("germantechjobs", external_id=_GUID, raw_title=_TRIM, raw_location="'Germany'", company_name="company_name", apply_url=_LINK,
        text=f"concat_ws({_NL2}, CASE WHEN doc_id % 4 = 0 THEN 'Salary: 60 - 80k' END, {_BODY})")
def germantechjobs(spark, sf):
    title = F.concat(_escaped("raw_title"), F.lit(" @ "), _escaped("company_name"), F.when(num() % 4 == 0, " [60 - 80k]").otherwise(""))
    return feeds.germantechjobs(_feed(docs(spark, sf), _tag("title", title), *_basics()))


@source("larajobs", external_id=_GUID, raw_title=_TRIM, raw_location=f"nullif({S.trim('raw_location')}, '')",
        company_name="CASE WHEN doc_id % 2 = 0 THEN company_name ELSE 'creator' END", apply_url=_LINK,
        text=f"""concat_ws(chr(10), 'Employment type: FULL TIME', 'Location: ' || nullif({S.trim('raw_location')}, ''), 'Tags: php')""")
def larajobs(spark, sf):
    tags = [_tag("title", _escaped("raw_title")), *_basics(F.lit("")), _tag("job:job_type", F.lit("FULL_TIME")),
            _tag("job:location", _escaped("raw_location")), _tag("job:tags", F.lit("php")), _tag("dc:creator", F.lit("creator")),
            _tag("job:company", F.when(num() % 2 == 0, _escaped("company_name")))]
    return feeds.larajobs(_feed(docs(spark, sf), *tags))


@source("pythonjobs", external_id=_GUID, raw_title=f"CASE WHEN doc_id % 5 = 0 THEN replace({_TRIM}, ',', ';') ELSE {_TRIM} END",
        company_name="CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE replace(company_name, ',', '') END",
        raw_location=f"CASE WHEN {S.trim('raw_location')} <> '' THEN {S.trim('raw_location')} END", apply_url=_LINK, epoch="NULL",
        text=f"{S.trim('''('<b>' || description)''')}")
def pythonjobs(spark, sf):
    company = F.replace("company_name", F.lit(","), F.lit(""))
    title = F.when(num() % 5 == 0, F.replace("raw_title", F.lit(","), F.lit(";"))).otherwise(F.concat("raw_title", F.lit(", "), company))
    rows = docs(spark, sf).withColumns({"line": title, "body": F.concat("raw_location", F.lit("<b>"), "description")})
    return feeds.pythonjobs(_feed(rows, _tag("title", _escaped("line")), *_basics(_escaped("body"))))


@source("weworkremotely", external_id=_GUID, raw_title=f"CASE WHEN doc_id % 6 = 0 THEN {_TRIM} ELSE {_TRIM} || ': EU' END",
        company_name="CASE WHEN doc_id % 6 = 0 THEN 'Unknown' ELSE company_name END",
        raw_location=f"nullif({S.trim('raw_location')}, '')", apply_url=_LINK, text=_BODY)
def weworkremotely(spark, sf):
    title = F.when(num() % 6 == 0, F.col("raw_title")).otherwise(F.concat("company_name", F.lit(": "), F.trim("raw_title"), F.lit(": EU")))
    rows = docs(spark, sf).withColumn("line", title)
    return feeds.weworkremotely(_feed(rows, _tag("title", _escaped("line")), *_basics(), _tag("region", _escaped("raw_location"))))


@source("teamtailor", where="doc_id % 8 <> 0", external_id=_GUID, raw_title=_TRIM, company_name="board_company", apply_url=_LINK,
        raw_location=f"concat_ws(', ', 'HQ', nullif({S.trim('raw_location')}, ''))", remote_type=_remote("place_kind"), text=_BODY)
def teamtailor(spark, sf):
    rows = docs(spark, sf)
    title = _tag("title", F.when(num() % 8 != 0, _escaped("raw_title")))
    item = F.concat(title, *_basics(), _tag("remoteStatus", F.col("place_kind")), _tag("tt:name", F.lit("HQ")), _tag("tt:city", _escaped("raw_location")))
    again = F.concat(_tag("title", F.lit("copy")), *_basics())
    payload = F.concat(F.lit("<rss><channel><item>"), item, F.lit("</item>"), F.when(num() % 8 != 0, F.concat(F.lit("<item>"), again, F.lit("</item>"))).otherwise(""), F.lit("</channel></rss>"))
    # Documents of one source may share a link; the guid of those is their own here.
    return feeds.teamtailor(_landed(rows.withColumn("apply_url", F.col("apply_url")), payload), companies(spark, sf))


_OFFICES = f"concat_ws(', ', nullif({S.trim('raw_location')}, ''), 'Porto', 'Braga')"
_SECTIONS = f"('<h2>Tasks & more</h2>' || {S.trim("description || ' ' || coalesce(place_kind, '')")} || chr(10) || 'plain')"


@catalog.add(
    "src_personio",
    S.with_(S.POSTINGS, _DOCS, select=f"""SELECT {ID} AS external_id, {_TRIM} AS raw_title, {_OFFICES} AS raw_location,
      board_company AS company_name, 'https://' || source_slug || '.jobs.personio.de/job/' || doc_id || '?language=en' AS apply_url,
      {_remote(f"{S.trim('raw_location')} || ' Porto Braga ' || {_SECTIONS}")} AS remote_type, {_employment('kind')} AS employment_type, epoch,
      sha256({_SECTIONS}) AS text_hash FROM docs"""),
)
def personio(spark, sf):
    rows = docs(spark, sf)
    section = F.concat(
        F.lit("<jobDescription><name>Tasks &amp; more</name><value><![CDATA["), F.col("description"), F.lit(" "),
        F.coalesce("place_kind", F.lit("")),
        F.lit("]]></value></jobDescription><jobDescription><value>plain</value></jobDescription>"),
    )
    payload = F.concat(
        F.lit("<workzag-jobs><position>"), _tag("id", num().cast("string")), _tag("office", _escaped("raw_location")),
        F.lit("<additionalOffices><office>Porto</office><office>Braga</office></additionalOffices>"),
        _tag("name", _escaped("raw_title")), F.lit("<jobDescriptions>"), section, F.lit("</jobDescriptions>"),
        _tag("employmentType", F.col("kind")), _tag("schedule", F.lit("x")), _tag("createdAt", F.col("iso")),
        F.lit("</position></workzag-jobs>"),
    )
    out = feeds.personio(_landed(rows, payload), companies(spark, sf))
    return out.select(
        "external_id", "raw_title", "raw_location", "company_name", "apply_url", "remote_type", "employment_type",
        F.unix_seconds("posted_at").alias("epoch"), F.sha2("description", 256).alias("text_hash"),
    )


@catalog.add(
    "src_recruitee",
    S.with_(S.POSTINGS, _DOCS, select=f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'g' || doc_id ELSE {ID} END AS external_id, {_TRIM} AS raw_title,
      CASE WHEN doc_id % 3 = 0 THEN 'Ghent, Belgium' ELSE concat_ws(', ', nullif({S.trim('raw_location')}, ''), 'BE') END AS raw_location,
      board_company AS company_name, apply_url, CASE WHEN doc_id % 4 = 0 THEN 'HYBRID' WHEN doc_id % 4 = 1 THEN 'FULLY_REMOTE' ELSE 'UNKNOWN' END AS remote_type,
      {_employment('kind')} AS employment_type, CAST(doc_id AS DOUBLE) AS salary_min, 'EUR' AS salary_currency, {_period('unit')} AS salary_period,
      epoch, '<p>Hi & "you"</p>' || chr(10) || 'R' AS description FROM docs"""),
)
def recruitee(spark, sf):
    rows = docs(spark, sf)
    payload = F.concat(
        F.lit("<offers><offer>"), _tag("id", num().cast("string")), _tag("guid", F.when(num() % 2 == 0, F.concat(F.lit("g"), num().cast("string")))),
        _tag("title", _escaped("raw_title")), _tag("careers-url", _escaped("apply_url")),
        _tag("location", F.when(num() % 3 == 0, "Ghent, Belgium")), _tag("city", _escaped("raw_location")), _tag("country", F.lit("BE")),
        _tag("description", F.lit("&amp;lt;p&amp;gt;Hi &amp;amp; &amp;quot;you&amp;quot;&amp;lt;/p&amp;gt;")), _tag("requirements", F.lit("R")),
        _tag("remote", F.when(num() % 4 <= 1, "true").otherwise("false")), _tag("hybrid", F.when(num() % 4 == 0, "true").otherwise("false")),
        _tag("employment-type-code", F.col("kind")), F.lit("<salary>"), _tag("min", num().cast("string")), F.lit("<currency>EUR</currency>"),
        _tag("period", F.col("unit")), F.lit("</salary>"), _tag("created-at", F.col("iso")), F.lit("</offer></offers>"),
    )
    out = feeds.recruitee(_landed(rows, payload), companies(spark, sf))
    return out.select(
        "external_id", "raw_title", "raw_location", "company_name", "apply_url", "remote_type", "employment_type", "salary_min",
        "salary_currency", "salary_period", F.unix_seconds("posted_at").alias("epoch"), "description",
    )


@catalog.add(
    "src_rss_items",
    S.with_(S.POSTINGS, _DOCS, select=f"""SELECT CASE WHEN doc_id % 3 <> 0 THEN {ID} END AS guid, {_TRIM} AS title, sha256({_BODY}) AS text_hash, NULL::VARCHAR AS missing
      FROM docs"""),
)
def rss_items(spark, sf):
    landed = _feed(docs(spark, sf), _tag("title", _escaped("raw_title")), *_basics())
    return feeds.rss_items(landed).select(
        feeds.rss_tag("guid").alias("guid"), feeds.rss_tag("title").alias("title"),
        F.sha2(feeds.rss_tag("description"), 256).alias("text_hash"), feeds.rss_tag("nothing").alias("missing"),
    )


@catalog.add(
    "fld_sitemap_urls",
    "SELECT DISTINCT 'https://jobs.example.com/jobs/' || (page_id % 40) AS url FROM pages WHERE page_id % 3 <> 0",
)
def sitemap_urls(spark, sf):
    page = F.col("page_id")
    loc = F.concat(
        F.when(page % 3 == 0, "https://other.example.com/jobs/").otherwise("https://jobs.example.com/Jobs/".replace("/Jobs", "/jobs")),
        (page % 40).cast("string"),
    )
    xml = F.concat(F.lit('<urlset xmlns="x"><url>'), _tag("loc", loc), F.lit("</url><url><loc>https://jobs.example.com/about</loc></url></urlset>"))
    landed = B.read(spark, sf, "pages").select(F.lit("https://jobs.example.com/sitemap.xml").alias("page_url"), xml.alias("payload"))
    return feeds.sitemap_urls(landed, "/JOBS/")


# --- pages ------------------------------------------------------------------------------


@catalog.add(
    "fld_page_links",
    """WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
      SELECT DISTINCT 'https://board.example.com' || href AS url FROM links WHERE starts_with(href, '/t')""",
)
def page_links(spark, sf):
    landed = B.read(spark, sf, "pages").select(
        F.concat(F.lit("https://board.example.com/list?page="), F.col("page_id").cast("string")).alias("page_url"), c("html", "payload")
    )
    return pages.page_links(landed, "board.example.com", "/t")


def _page(*blocks):
    """A page with a broken block first, then the given ones."""
    script = '<script type="application/ld+json">'
    parts = [F.concat(F.lit(script), b, F.lit("</script>")) for b in (F.lit("{broken"), *blocks)]
    return F.concat(F.lit('<html><head><link rel="canonical" href="/jobs/view/9"></head><body>'), *parts, F.lit("<p>x</p></body></html>"))


def _posting(*extra):
    organisation = F.struct(c("company_name", "name"), F.lit("https://co.example.com").alias("sameAs"))
    pay = F.struct(F.lit("EUR").alias("currency"), F.struct(num().alias("minValue"), (num() + 7).alias("maxValue"), F.lit("YEAR").alias("unitText")).alias("value"))
    return F.struct(
        F.lit("JobPosting").alias("@type"), c("raw_title", "title"), c("safe_text", "description"), c("iso", "datePosted"),
        organisation.alias("hiringOrganization"), pay.alias("baseSalary"), *extra,
    )


def _safe_docs(spark, sf):
    """Page documents: their text must not close the script block it stands in."""
    text = F.replace("description", F.lit("</script>"), F.lit(""))
    return docs(spark, sf).withColumn("safe_text", text)


_SAFE = "replace(description, '</script>', '')"
_FULL = "'PERMANENT'"


def _address(city, country):
    return F.struct(F.struct(city.alias("addressLocality"), country.alias("addressCountry")).alias("address"))


@source("careerpage", external_id="CASE WHEN doc_id % 2 = 0 THEN 'jp-' || doc_id ELSE 'https://pages.example.com/o/' || doc_id END",
        raw_title="raw_title", raw_location="CASE WHEN raw_location = '   ' THEN '   , PT, Spain' ELSE raw_location || ', PT, Spain' END",
        company_name="company_name", apply_url="'https://pages.example.com/o/' || doc_id", remote_type="'FULLY_REMOTE'", employment_type=_FULL,
        salary_min="doc_id", salary_max="doc_id + 7", salary_currency="'EUR'", salary_period="'YEARLY'", text=_SAFE)
def careerpage(spark, sf):
    posting = _posting(
        F.concat(F.lit("/o/"), num().cast("string")).alias("url"), F.array(F.lit("FULL_TIME"), F.lit("OTHER")).alias("employmentType"),
        F.lit("TELECOMMUTE").alias("jobLocationType"), F.array(_address(F.col("raw_location"), F.lit("PT"))).alias("jobLocation"),
        F.struct(F.lit("Spain").alias("name")).alias("applicantLocationRequirements"),
        F.when(num() % 2 == 0, F.struct(F.concat(F.lit("jp-"), num().cast("string")).alias("value"))).alias("identifier"),
    )
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("WebSite").alias("@type")).alias("w")).alias("x"), F.array(posting).alias("@graph")))
    return pages.careerpage(_landed(_safe_docs(spark, sf), _page(graph)), companies(spark, sf))


@source("remoteyeah", external_id="page_url", raw_title="raw_title", raw_location="CASE WHEN doc_id % 2 = 0 THEN 'Spain, Italy' ELSE 'Remote' END",
        company_name="company_name", apply_url="page_url",
        text=f"concat_ws({_NL2}, 'Employment type: FULL_TIME', 'Skills: Go', 'Salary: EUR ' || doc_id || '–' || (doc_id + 7) || ' / YEAR', {_SAFE})")
def remoteyeah(spark, sf):
    posting = _posting(
        F.array(F.lit("FULL_TIME")).alias("employmentType"), F.lit("TELECOMMUTE").alias("jobLocationType"), F.lit("Go").alias("skills"),
        F.when(num() % 2 == 0, F.array(F.struct(F.lit("Spain").alias("name")), F.struct(F.lit("Italy").alias("name")))).alias("applicantLocationRequirements"),
    )
    other = F.lit('{"@type":"WebSite"}')
    return pages.remoteyeah(_landed(_safe_docs(spark, sf), _page(other, F.to_json(posting))))


@source("wellfound", where="trim(raw_title) <> '' AND doc_id % 10 <> 3", external_id="CASE WHEN doc_id % 2 = 0 THEN 'wf' || doc_id ELSE CAST(doc_id AS VARCHAR) END", raw_title=_TRIM,
        raw_location="CASE WHEN doc_id % 3 = 0 THEN 'Spain' WHEN doc_id % 3 = 1 THEN 'Rome, Italy; Milan, IT' ELSE 'Remote' END",
        company_name="company_name", apply_url="'https://wellfound.com/jobs/' || doc_id || '-dev'", remote_type="'FULLY_REMOTE'",
        employment_type=_FULL, salary_min="doc_id", salary_max="doc_id + 7", salary_currency="'EUR'", salary_period="'YEARLY'",
        text=S.trim(_SAFE))
def wellfound(spark, sf):
    places = F.array(F.to_json(_address(F.lit("Rome"), F.struct(F.lit("Italy").alias("name")))), F.to_json(_address(F.lit("Milan"), F.lit("IT"))))
    extra = F.concat_ws(
        ",", F.lit('"employmentType":"FULL_TIME","jobLocationType":"TELECOMMUTE"'),
        F.when(num() % 3 == 0, F.lit('"applicantLocationRequirements":{"name":" Spain "}')),
        F.when(num() % 3 == 1, F.concat(F.lit('"jobLocation":['), F.array_join(places, ","), F.lit("]"))),
        F.when(num() % 2 == 0, F.concat(F.lit('"identifier":{"value":"wf'), num().cast("string"), F.lit('"}'))),
    )
    rows = _safe_docs(spark, sf).withColumns(
        {
            "page_url": F.concat(F.lit("https://wellfound.com/jobs/"), num().cast("string"), F.lit("-dev")),
            "raw_title": F.when(num() % 10 != 3, F.col("raw_title")),
        }
    )
    body = F.concat(F.regexp_replace(F.to_json(_posting()), r"\}\z", ","), extra, F.lit("}"))
    nested = F.concat(F.lit('[{"@type":"Organization"},{"@graph":['), body, F.lit("]}]"))
    return pages.wellfound(_landed(rows, _page(nested)))


_LINE = S.trim(S.sub(_SAFE, r"\s+", "' '"))


@source("linkedin", external_id=ID, raw_title=S.collapse("raw_title"), raw_location=f"concat_ws(', ', nullif({S.collapse('raw_location')}, ''), 'Portugal')",
        company_name="company_name", apply_url="'https://www.linkedin.com/jobs/view/' || doc_id", remote_type="'FULLY_REMOTE'",
        employment_type=_FULL, salary_min="doc_id", salary_max="doc_id + 7", salary_currency="'EUR'", salary_period="'YEARLY'",
        text=f"{S.collapse(_SAFE)} || chr(10) || 'Employment type: full time, other' || chr(10) || 'Salary: EUR ' || doc_id || ' - ' || (doc_id + 7) || ' per year'")
def linkedin(spark, sf):
    posting = _posting(
        F.array(F.lit("FULL_TIME"), F.lit("OTHER")).alias("employmentType"), F.lit("TELECOMMUTE").alias("jobLocationType"),
        _address(F.col("raw_location"), F.struct(F.lit("Portugal").alias("name"))).alias("jobLocation"),
    )
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(posting.alias("inner"))).alias("list")).alias("outer")))
    rows = _safe_docs(spark, sf).withColumn("safe_text", F.regexp_replace("safe_text", "(?i)hybrid", "mixed"))
    return pages.linkedin(_landed(rows, _page(deep)))
