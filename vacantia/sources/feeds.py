"""Sources that answer with RSS or XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import blank_to_null, join_present, quoted, trimmed
from vacantia.functions.fields import (
    lenient_date,
    lenient_number,
    remote_type,
    structured_employment_type,
    structured_salary_period,
)
from vacantia.sources.shared import as_postings, labelled, listed, paragraphs, trimmed_or_null, with_companies

# --- RSS --------------------------------------------------------------------------------


def rss_items(landed: DataFrame) -> DataFrame:
    """One row per ``<item>``: ``place, item``. Works on feeds that are not well-formed XML."""
    items = F.regexp_extract_all("payload", F.lit(r"<item>[\s\S]*?</item>"), F.lit(0))
    return landed.select("*", F.posexplode(items).alias("place", "item")).drop("payload")


def rss_tag(tag: str, item: Column | None = None) -> Column:
    """Text of an item's first such tag: out of CDATA, entities decoded, trimmed; null when blank."""
    name = quoted(tag)
    item = F.col("item") if item is None else item
    text = F.regexp_extract(item, rf"<{name}(?:\s[^>]*)?>([\s\S]*?)</{name}>", 1)
    text = F.regexp_replace(text, r"^\s*<!\[CDATA\[([\s\S]*)\]\]>\s*\z", "$1")
    for entity, plain in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#039", "'"), ("nbsp", " "), ("amp", "&")]:
        text = F.replace(text, F.lit(f"&{entity};"), F.lit(plain))
    return blank_to_null(trimmed(text))


def _tags(landed: DataFrame, **tags: str) -> DataFrame:
    """The item's tags as columns, each searched for once."""
    rows = rss_items(landed)
    return rows.withColumns({name: rss_tag(tag) for name, tag in tags.items()}).drop("item")


def _payload(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def _linked(rows: DataFrame) -> dict[str, Column]:
    link = F.coalesce("link", F.lit(""))
    return {
        "external_id": F.coalesce("guid", link), "source_url": link, "apply_url": link,
        **({"posted_at": lenient_date(F.col("published"))} if "published" in rows.columns else {}),
    }


_BASIC = {"title": "title", "link": "link", "guid": "guid", "text": "description"}


def germantechjobs(landed: DataFrame) -> DataFrame:
    """Titles read "Title @ Company [pay]"."""
    rows = _tags(landed, **_BASIC, published="pubDate")
    title = F.coalesce("title", F.lit(""))
    grammar = r"^(.+?)\s*@\s*([^\[]+?)(?:\s*\[(.+)\])?\z"
    fits = title.rlike(grammar)

    def part(group: int) -> Column:
        return trimmed(F.regexp_extract(title, grammar, group))

    return as_postings(
        rows.withColumn("raw_payload", _payload("title", "link")), "germantechjobs", **_linked(rows),
        raw_title=F.when(fits, part(1)).otherwise(title),
        company_name=F.when(fits, part(2)).otherwise("Unknown"), raw_location=F.lit("Germany"),
        description=paragraphs(labelled("Salary", part(3)), F.col("text")),
    )


def larajobs(landed: DataFrame) -> DataFrame:
    """The text is empty in this feed, so it is put together from the ``job:`` tags."""
    rows = _tags(
        landed, title="title", link="link", guid="guid", published="pubDate", kind="job:job_type",
        pay="job:salary", tags="job:tags", location="job:location", company="job:company", creator="dc:creator",
    )
    return as_postings(
        rows.withColumn("raw_payload", _payload("link", "kind", "pay", "tags", "location")), "larajobs",
        **_linked(rows), raw_title=F.coalesce("title", F.lit("")), raw_location=F.col("location"),
        company_name=F.coalesce("company", "creator", F.lit("Unknown")),
        description=F.concat_ws(
            "\n", labelled("Employment type", F.replace("kind", F.lit("_"), F.lit(" "))),
            labelled("Salary", F.col("pay")), labelled("Location", F.col("location")),
            labelled("Tags", F.col("tags")),
        ),
    )


def pythonjobs(landed: DataFrame) -> DataFrame:
    """Titles read "Title, Company", split at the last comma; the text starts with the place."""
    rows = _tags(landed, **_BASIC)
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    split = title.contains(",")
    company = F.substring_index(title, ",", -1)
    head = F.substring(title, F.lit(1), F.length(title) - F.length(company) - 1)
    tag = F.instr(text, "<")
    return as_postings(
        rows.withColumn("raw_payload", _payload("title", "link")), "pythonjobs", **_linked(rows),
        raw_title=F.when(split, trimmed(head)).otherwise(title),
        company_name=F.when(split, trimmed(company)).otherwise("Unknown"),
        raw_location=F.when(tag > 1, trimmed(F.substring_index(text, "<", 1))),
        description=F.when(tag > 1, trimmed(F.substring(text, tag, F.length(text)))).otherwise(text),
    )


def weworkremotely(landed: DataFrame) -> DataFrame:
    """Titles read "Company: Title", split at the first colon."""
    rows = _tags(landed, **_BASIC, published="pubDate", region="region", category="category")
    title = F.coalesce("title", F.lit(""))
    split = title.contains(":")
    company = F.substring_index(title, ":", 1)
    rest = F.substring(title, F.length(company) + 2, F.length(title))
    return as_postings(
        rows.withColumn("raw_payload", _payload("title", "link", "region", "category")), "weworkremotely",
        **_linked(rows), raw_title=F.when(split, trimmed(rest)).otherwise(title),
        company_name=F.when(split, trimmed(company)).otherwise("Unknown"), raw_location=F.col("region"),
        description=F.coalesce("text", F.lit("")),
    )


def teamtailor(landed: DataFrame, companies: DataFrame) -> DataFrame:
    """Items without link or title are dropped; of items with one guid the first is kept."""
    rows = _tags(
        landed, **_BASIC, published="pubDate", remote="remoteStatus", name="tt:name", city="tt:city",
        country="tt:country", department="tt:department", role="tt:role", division="tt:division",
    ).filter("link IS NOT NULL AND title IS NOT NULL")
    rows = rows.withColumn("guid", F.coalesce("guid", "link"))
    order = F.struct(*[c for c in ("board", "page_url", "place") if c in rows.columns])
    firsts = rows.groupBy("guid").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "guid"]), order).alias("r"))
    rows = firsts.select("guid", "r.*")
    payload = F.to_json(F.struct("guid", "title", "link", "remote", "department", "role", "division"))
    return as_postings(
        with_companies(rows, companies).withColumn("raw_payload", payload), "teamtailor", **_linked(rows),
        raw_title=F.col("title"), raw_location=blank_to_null(F.concat_ws(", ", "name", "city", "country")),
        company_name=F.col("company_name"), company_url=F.col("company_url"), remote_type=remote_type(F.col("remote")),
        description=F.coalesce("text", F.lit("")),
    )


# --- XML --------------------------------------------------------------------------------


def personio(landed: DataFrame, companies: DataFrame, language: str = "en") -> DataFrame:
    """``companies`` also has ``account`` and ``host``."""
    feed = F.from_xml(
        "payload",
        "position array<struct<id:string,subcompany:string,office:string,"
        "additionalOffices:struct<office:array<string>>,department:string,recruitingCategory:string,name:string,"
        "jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>,employmentType:string,"
        "seniority:string,schedule:string,createdAt:string>>",
    )
    rows = landed.select("*", F.posexplode(feed["position"]).alias("place", "job")).drop("payload")

    def job(name: str) -> Column:
        return F.col(f"job.{name}")

    rows = rows.filter(trimmed_or_null(job("id")).isNotNull() & trimmed_or_null(job("name")).isNotNull())
    offices = F.concat(F.array(job("office")), F.coalesce(job("additionalOffices.office"), F.array().cast("array<string>")))
    offices = F.filter(F.transform(offices, trimmed), lambda o: o.isNotNull() & (o != ""))
    heading = F.lit("<h2>"), F.lit("</h2>")
    sections = F.transform(
        job("jobDescriptions.jobDescription"),
        lambda s: F.concat(
            F.coalesce(F.concat(heading[0], trimmed_or_null(s["name"]), heading[1]), F.lit("")),
            F.coalesce(trimmed(s["value"]), F.lit("")),
        ),
    )
    rows = with_companies(rows, companies).withColumns(
        {
            "offices": offices, "text": F.coalesce(F.array_join(sections, "\n"), F.lit("")),
            "ident": trimmed(job("id")),
        }
    )
    url = F.concat(
        F.lit("https://"), F.col("account"), F.lit("."), F.coalesce("host", F.lit("jobs.personio.com")),
        F.lit("/job/"), F.col("ident"), F.lit(f"?language={language}"),
    )
    return as_postings(
        rows.withColumn("raw_payload", F.to_json("job")), "personio",
        external_id=F.col("ident"), source_url=url, apply_url=url, raw_title=trimmed(job("name")),
        raw_location=listed(F.col("offices")), company_name=F.col("company_name"), company_url=F.col("company_url"),
        remote_type=remote_type(F.concat_ws(" ", F.array_join("offices", " "), "text")),
        employment_type=structured_employment_type(
            F.concat_ws(" ", F.coalesce(job("employmentType"), F.lit("")), F.coalesce(job("schedule"), F.lit("")))
        ),
        description=F.col("text"), posted_at=lenient_date(job("createdAt")),
    )


def _unescaped(text: Column) -> Column:
    """Markup that came as entities; other text stays as it is."""
    out = F.regexp_replace(text, "<[^>]*>", "")
    for name, plain in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")]:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(plain))
    return F.when(text.contains("&lt;") & out.contains("<"), out).otherwise(text)


def recruitee(landed: DataFrame, companies: DataFrame) -> DataFrame:
    feed = F.from_xml(
        "payload",
        "offer array<struct<id:string,guid:string,title:string,`careers-url`:string,`careers-apply-url`:string,"
        "location:string,city:string,`state-name`:string,country:string,description:string,requirements:string,"
        "remote:string,hybrid:string,`on-site`:string,department:string,`employment-type-code`:string,"
        "salary:struct<min:string,max:string,currency:string,period:string>,`published-at`:string,"
        "`created-at`:string>>",
    )
    rows = landed.select("*", F.posexplode(feed["offer"]).alias("place", "job")).drop("payload")

    def job(name: str) -> Column:
        return F.col("job")[name]

    rows = rows.withColumns(
        {
            "ident": F.coalesce(trimmed_or_null(job("guid")), trimmed_or_null(job("id"))),
            "name": trimmed_or_null(job("title")), "url": trimmed_or_null(job("careers-url")),
        }
    ).filter("ident IS NOT NULL AND name IS NOT NULL AND url IS NOT NULL")
    place = F.coalesce(
        trimmed_or_null(job("location")),
        blank_to_null(join_present(", ", job("city"), job("state-name"), job("country"))),
    )
    hybrid, remote = (F.coalesce(trimmed(job(f)) == "true", F.lit(False)) for f in ("hybrid", "remote"))
    pay = F.col("job.salary")
    return as_postings(
        with_companies(rows, companies).withColumn("raw_payload", F.to_json("job")), "recruitee",
        external_id=F.col("ident"), source_url=F.col("url"),
        apply_url=F.coalesce(trimmed_or_null(job("careers-apply-url")), F.col("url")), raw_title=F.col("name"),
        raw_location=place, company_name=F.col("company_name"), company_url=F.col("company_url"),
        remote_type=F.when(hybrid, "HYBRID").when(remote, "FULLY_REMOTE").otherwise("UNKNOWN"),
        employment_type=structured_employment_type(job("employment-type-code")),
        salary_min=lenient_number(pay["min"]), salary_max=lenient_number(pay["max"]),
        salary_currency=trimmed_or_null(pay["currency"]), salary_period=structured_salary_period(pay["period"]),
        description=F.concat_ws(
            "\n", _unescaped(blank_to_null(job("description"))), _unescaped(blank_to_null(job("requirements")))
        ),
        posted_at=lenient_date(F.coalesce(blank_to_null(job("published-at")), job("created-at"))),
    )


def sitemap_urls(landed: DataFrame, pattern: str) -> DataFrame:
    """Distinct page URLs of sitemaps that are on the sitemap's own origin and fit the pattern."""
    return _locations(landed, "url").filter(F.col("url").rlike(f"(?i){pattern}")).distinct()


def nested_sitemaps(landed: DataFrame) -> DataFrame:
    """Distinct sitemaps that sitemap indexes point to on their own origin."""
    return _locations(landed, "sitemap").distinct()


_ORIGIN = r"(?i)^\s*([a-z][a-z0-9+.\-]*://[^/?#\s]+)"


def _locations(landed: DataFrame, kind: str) -> DataFrame:
    entries = F.from_xml("payload", f"`{kind}` array<struct<loc:string>>")[kind]["loc"]
    rows = landed.select("page_url", F.explode(entries).alias("url"))
    rows = rows.withColumn("url", trimmed_or_null(F.col("url")))

    def origin(column: str) -> Column:
        return F.lower(F.regexp_extract(column, _ORIGIN, 1))

    return rows.filter(origin("url") == origin("page_url")).select("url")
