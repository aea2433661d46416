"""Sources read from the structured data of landed pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.columns import blank_to_null, collapsed, first_group, join_present, trimmed
from vacantia.functions.fields import (
    job_id_from_url,
    lenient_date,
    lenient_number,
    numbered_job_id,
    structured_employment_type,
    structured_salary_period,
    url_host,
    workplace,
    workplace_to_remote_type,
)
from vacantia.sources.shared import as_postings, labelled, listed, one_line, paragraphs, with_companies

# --- structured data --------------------------------------------------------------------

# Pages whose blocks and postings are Python values at a time: a task never holds a whole Arrow batch as such.
SLICE = 64

_BLOCK = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _types(value: dict) -> list:
    kind = value.get("@type")
    return kind if isinstance(kind, list) else [kind]


def _in_graph(value) -> list[dict]:
    """All postings among array elements and ``@graph`` members, at any depth."""
    if isinstance(value, list):
        return [p for item in value for p in _in_graph(item)]
    if not isinstance(value, dict):
        return []
    own = [value] if any(str(t).lower() == "jobposting" for t in _types(value)) else []
    return own + _in_graph(value.get("@graph"))


def _first_in_graph(value) -> list[dict]:
    """The first posting among array elements and ``@graph`` members."""
    if isinstance(value, list):
        return next((found for item in value if (found := _first_in_graph(item))), [])
    if not isinstance(value, dict):
        return []
    if value.get("@type") == "JobPosting":
        return [value]
    graph = value.get("@graph")
    return _first_in_graph(graph) if isinstance(graph, list) else []


def _first_anywhere(value) -> list[dict]:
    """The first posting in any nested value."""
    if isinstance(value, dict) and "JobPosting" in _types(value):
        return [value]
    nested = value if isinstance(value, list) else value.values() if isinstance(value, dict) else []
    return next((found for item in nested if (found := _first_anywhere(item))), [])


def _searching(find, only_first: bool):
    """An Arrow-batched search of a page's blocks; a malformed block is passed over alone."""

    def postings(blocks) -> list[str]:
        out: list[str] = []
        for block in blocks if blocks is not None else []:
            try:
                found = find(json.loads(block))
            except (ValueError, RecursionError):
                continue
            texts = [json.dumps(p, ensure_ascii=False, separators=(",", ":")) for p in found]
            # JSON may name half a character, which no text can hold.
            out += [t.encode(errors="replace").decode() for t in texts]
            if out and only_first:
                break
        return out

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield pa.array([postings(b) for b in batch.slice(at, SLICE).to_pylist()], pa.list_(pa.string()))

    return search


_all_in_graph = _searching(_in_graph, False)
_one_in_graph = _searching(_first_in_graph, True)
_one_anywhere = _searching(_first_anywhere, True)



def _one_on_top(blocks: Column) -> Column:
    """The first block that is a posting itself, as the page has it."""
    return F.slice(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "JobPosting"), 1, 1)


_POSTING = (
    "title string, description string, url string, datePosted string, employmentType string, "
    "jobLocationType string, identifier string, hiringOrganization struct<name:string,sameAs:string,url:string>, "
    "jobLocation string, applicantLocationRequirements string, skills string, "
    "baseSalary struct<currency:string,value:string,unitText:string>"
)


def structured_postings(landed: DataFrame, search) -> DataFrame:
    """Postings in the pages' structured data: ``job`` parsed, ``raw_payload`` its JSON text.

    Blocks are cut out by the JVM, so only they reach Python. Fields that may be text, object or
    array are kept as text and read by ``_objects`` and ``_words``.
    """
    blocks = F.regexp_extract_all("payload", F.lit(_BLOCK), F.lit(1))
    # The raw page goes no further than what is needed of it.
    canonical = first_group(F.col("payload"), r"""(?is)<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']*)["']""")
    reverse = first_group(F.col("payload"), r"""(?is)<link[^>]*href=["']([^"']*)["'][^>]*rel=["']canonical["']""")
    pages = landed.select(
        *[c for c in landed.columns if c != "payload"], F.coalesce(canonical, reverse).alias("canonical"),
        blocks.alias("blocks"),
    ).filter(F.size("blocks") > 0)
    rows = pages.select(
        *[c for c in pages.columns if c != "blocks"], F.posexplode(search(F.col("blocks"))).alias("place", "raw_payload")
    )
    return rows.withColumn("job", F.from_json("raw_payload", _POSTING))


def _job(name: str) -> Column:
    return F.col(f"job.{name}")


def _objects(text: Column, fields: str) -> Column:
    """One object or an array of them, as an array; empty when missing."""
    many = F.from_json(text, f"array<struct<{fields}>>")
    one = F.array(F.from_json(text, f"struct<{fields}>"))
    return (
        F.when(text.startswith("["), many).when(text.startswith("{"), one)
        .otherwise(F.array().cast(f"array<struct<{fields}>>"))
    )


def _words(text: Column) -> Column:
    """Text, or an array of texts joined by blanks."""
    return F.when(text.startswith("["), F.array_join(F.from_json(text, "array<string>"), " ")).otherwise(text)


def _named(text: Column) -> Column:
    return F.filter(
        F.transform(_objects(text, "name:string"), lambda o: blank_to_null(trimmed(o["name"]))),
        lambda n: n.isNotNull(),
    )


_ADDRESS = "address:struct<addressLocality:string,addressRegion:string,addressCountry:string>"


def _country(value: Column) -> Column:
    return F.when(value.startswith("{"), F.get_json_object(value, "$.name")).otherwise(value)


def _pay() -> Column:
    """``struct<minValue, maxValue, value, unitText>`` of the salary, a bare number as its value."""
    text = _job("baseSalary.value")
    fields = "minValue string, maxValue string, value string, unitText string"
    bare = F.struct(
        F.lit(None).cast("string").alias("minValue"), F.lit(None).cast("string").alias("maxValue"),
        text.alias("value"), F.lit(None).cast("string").alias("unitText"),
    )
    return F.when(text.startswith("{"), F.from_json(text, fields)).when(text.isNotNull(), bare)


def resolved_url(href: Column, base: Column) -> Column:
    """``href`` as seen from ``base``: absolute, scheme-relative, rooted or beside it."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    link = trimmed(href)
    out = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .when(link == "", base)
        .otherwise(F.concat(folder, link))
    )
    bare_host = out.rlike(r"^https?://[^/?#]+\z")
    return F.when(bare_host, F.concat(out, F.lit("/"))).otherwise(out)


# --- links ------------------------------------------------------------------------------

_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def page_links(landed: DataFrame, host: str, path_prefix: str) -> DataFrame:
    """Distinct links of pages that lead to a host and path: ``url``."""
    hrefs = F.array_distinct(F.regexp_extract_all("payload", F.lit(_HREF), F.lit(1)))
    rows = landed.select("page_url", F.explode(hrefs).alias("href")).filter("href <> ''")
    href = F.replace("href", F.lit("&amp;"), F.lit("&"))
    rows = rows.select(resolved_url(href, F.col("page_url")).alias("url"))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return rows.filter((url_host(F.col("url")) == host) & path.startswith(path_prefix)).distinct()


def numbered_job_links(landed: DataFrame, host: str) -> DataFrame:
    """Distinct links to ``/jobs/<number>-…`` pages of a host, without query and fragment."""
    links = page_links(landed, host, "/jobs/")
    bare = F.regexp_extract("url", r"^([^?#]*)", 1)
    return links.select(bare.alias("url")).filter(F.col("url").rlike(r"//[^/]+/jobs/\d+-[^/]+/?\z")).distinct()


# --- sources ----------------------------------------------------------------------------


def careerpage(landed: DataFrame, companies: DataFrame) -> DataFrame:
    """Every posting on companies' own pages."""
    rows = structured_postings(landed, _all_in_graph).filter(blank_to_null(_job("title")).isNotNull())
    rows = with_companies(rows, companies)
    url = resolved_url(F.coalesce(_job("url"), F.col("canonical"), F.col("page_url")), F.col("page_url"))
    rows = rows.withColumns({"url": url, "pay": _pay()})
    address = F.transform(
        _objects(_job("jobLocation"), _ADDRESS),
        lambda o: F.array(o["address"]["addressLocality"], o["address"]["addressRegion"], o["address"]["addressCountry"]),
    )
    names = F.transform(_objects(_job("applicantLocationRequirements"), "name:string"), lambda o: o["name"])
    places = F.filter(F.concat(F.flatten(address), names), lambda p: p.isNotNull() & (p != ""))
    ident = F.when(
        _job("identifier").startswith("{"), F.get_json_object(_job("identifier"), "$.value")
    ).otherwise(_job("identifier"))
    pay = F.col("pay")
    return as_postings(
        rows, "careerpage",
        external_id=F.coalesce(ident, F.col("url")), source_url=F.col("url"), apply_url=F.col("url"),
        raw_title=_job("title"), raw_location=listed(F.array_distinct(places)),
        company_name=F.coalesce(_job("hiringOrganization.name"), F.col("company_name")),
        company_url=F.coalesce(_job("hiringOrganization.sameAs"), F.col("company_url")),
        remote_type=F.when(F.upper(_job("jobLocationType")).contains("TELECOMMUTE"), "FULLY_REMOTE").otherwise("UNKNOWN"),
        employment_type=structured_employment_type(_words(_job("employmentType"))),
        salary_min=lenient_number(F.coalesce(pay["minValue"], pay["value"])),
        salary_max=lenient_number(F.coalesce(pay["maxValue"], pay["value"])),
        salary_currency=_job("baseSalary.currency"),
        salary_period=structured_salary_period(F.coalesce(pay["unitText"], _job("baseSalary.unitText"))),
        description=F.coalesce(_job("description"), F.lit("")), posted_at=lenient_date(_job("datePosted")),
    )


def _with_version(version: int) -> Column:
    """The posting's JSON with the parser version as its last key."""
    return F.concat(F.regexp_replace("raw_payload", r"\}\z", ""), F.lit(f',"parserVersion":{version}}}'))


def remoteyeah(landed: DataFrame, parser_version: int = 1) -> DataFrame:
    """The first posting block of each page; pay, type and skills go into the text."""
    rows = structured_postings(landed, _one_on_top).withColumn("pay", _pay())
    pay = F.col("pay")
    places = F.transform(_objects(_job("applicantLocationRequirements"), "name:string"), lambda o: o["name"])
    kinds = F.from_json(_job("employmentType"), "array<string>")
    bounds = blank_to_null(F.concat_ws("–", pay["minValue"], pay["maxValue"]))
    salary = one_line(
        F.concat(
            F.lit("Salary: "), F.coalesce(_job("baseSalary.currency"), F.lit("")), F.lit(" "), bounds, F.lit(" / "),
            F.coalesce(pay["unitText"], F.lit("")),
        )
    )
    url = F.col("page_url")
    return as_postings(
        rows.withColumn("raw_payload", _with_version(parser_version)), "remoteyeah",
        external_id=url, source_url=url, apply_url=url, raw_title=_job("title"),
        raw_location=F.coalesce(
            listed(places), F.when(_job("jobLocationType") == "TELECOMMUTE", "Remote").otherwise("Unspecified")
        ),
        company_name=F.coalesce(_job("hiringOrganization.name"), F.lit("Unknown")),
        description=paragraphs(
            labelled("Employment type", listed(kinds)), labelled("Skills", _job("skills")), salary, _job("description")
        ),
        posted_at=lenient_date(_job("datePosted")),
    )


def wellfound(landed: DataFrame, parser_version: int = 1) -> DataFrame:
    """The first posting of each page; one that lacks id, title, company or text is refused."""
    rows = structured_postings(landed, _one_in_graph).withColumn("pay", _pay())
    ident = F.coalesce(F.get_json_object(_job("identifier"), "$.value"), numbered_job_id(F.col("page_url")))
    addresses = F.transform(
        _objects(
            _job("jobLocation"), _ADDRESS
        ),
        lambda o: join_present(
            ", ", o["address"]["addressLocality"], o["address"]["addressRegion"], _country(o["address"]["addressCountry"])
        ),
    )
    physical = F.filter(addresses, lambda a: a != "")
    pay, url = F.col("pay"), F.col("page_url")
    remote = F.coalesce(_job("jobLocationType") == "TELECOMMUTE", F.lit(False))
    out = as_postings(
        rows.withColumn("raw_payload", _with_version(parser_version)), "wellfound",
        external_id=blank_to_null(trimmed(ident)), source_url=url, apply_url=url,
        raw_title=blank_to_null(trimmed(_job("title"))),
        raw_location=F.coalesce(
            listed(_named(_job("applicantLocationRequirements"))), listed(physical, "; "), F.when(remote, "Remote")
        ),
        company_name=blank_to_null(trimmed(_job("hiringOrganization.name"))),
        company_url=_job("hiringOrganization.sameAs"), description=blank_to_null(trimmed(_job("description"))),
        remote_type=F.when(remote, "FULLY_REMOTE").otherwise("UNKNOWN"),
        employment_type=structured_employment_type(_words(_job("employmentType"))),
        salary_min=F.coalesce(pay["minValue"], pay["value"]).try_cast("double"),
        salary_max=F.coalesce(pay["maxValue"], pay["value"]).try_cast("double"),
        salary_currency=_job("baseSalary.currency"), salary_period=structured_salary_period(pay["unitText"]),
        posted_at=lenient_date(_job("datePosted")),
    )
    return out.dropna(subset=["external_id", "raw_title", "company_name", "description"])


def linkedin(landed: DataFrame, parser_version: int = 1) -> DataFrame:
    """The first posting anywhere in each page's structured data.

    The page's own URL names the posting; an id inside the data may mean something else.
    """
    rows = structured_postings(landed, _one_anywhere).withColumn("pay", _pay())

    def line(column: Column) -> Column:
        return blank_to_null(collapsed(column))

    inner = F.get_json_object(_job("identifier"), "$.value")
    ident = F.coalesce(
        job_id_from_url(F.col("page_url")), job_id_from_url(F.col("canonical")), job_id_from_url(_job("url")),
        job_id_from_url(inner), F.when(inner.rlike(r"^\d+\z"), inner),
    )
    plain = F.when(~_job("jobLocation").rlike(r"^[\[{]"), line(_job("jobLocation")))
    addresses = F.transform(
        _objects(_job("jobLocation"), _ADDRESS),
        lambda o: F.concat_ws(
            ", ", line(o["address"]["addressLocality"]), line(o["address"]["addressRegion"]),
            line(_country(o["address"]["addressCountry"])),
        ),
    )
    place = F.coalesce(plain, listed(F.filter(addresses, lambda a: a != ""), "; "))
    low = F.coalesce(F.col("pay.minValue"), F.col("pay.value")).try_cast("double")
    high = F.coalesce(F.col("pay.maxValue"), F.col("pay.value")).try_cast("double")
    currency, unit = line(_job("baseSalary.currency")), F.lower(line(F.col("pay.unitText")))

    def number(value: Column) -> Column:
        return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))

    bounds = F.when(high.isNull() | (low == high), number(F.coalesce(low, high))).otherwise(
        F.concat(F.coalesce(number(low), F.lit("")), F.lit(" - "), number(high))
    )
    has_pay = low.isNotNull() | high.isNotNull() | currency.isNotNull()
    pay_text = F.when(has_pay, F.concat_ws(" ", currency, bounds, F.concat(F.lit("per "), unit)))
    kinds = F.lower(F.replace(F.when(
        _job("employmentType").startswith("["), F.array_join(F.from_json(_job("employmentType"), "array<string>"), ", ")
    ).otherwise(line(_job("employmentType"))), F.lit("_"), F.lit(" ")))
    text = line(_job("description"))
    url = F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("ident"))
    rows = rows.withColumns({"ident": ident, "kinds": kinds, "place_text": place, "text": text})
    out = as_postings(
        rows.withColumn("raw_payload", _with_version(parser_version)), "linkedin",
        external_id=F.col("ident"), source_url=url, apply_url=url, raw_title=line(_job("title")),
        raw_location=F.col("place_text"), company_name=line(_job("hiringOrganization.name")),
        company_url=F.coalesce(line(_job("hiringOrganization.sameAs")), line(_job("hiringOrganization.url"))),
        description=F.concat_ws(
            "\n", "text", labelled("Employment type", F.col("kinds")), labelled("Salary", pay_text)
        ),
        remote_type=workplace_to_remote_type(workplace(line(_job("jobLocationType")), F.col("text"), F.col("place_text"))),
        employment_type=structured_employment_type(F.col("kinds")), salary_min=low, salary_max=high,
        salary_currency=currency, salary_period=structured_salary_period(unit),
        posted_at=lenient_date(_job("datePosted")),
    )
    return out.dropna(subset=["external_id", "raw_title", "company_name"])
