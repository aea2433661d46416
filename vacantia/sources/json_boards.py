"""Sources that answer with JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import blank_to_null, collapsed, join_present, trimmed, value_map
from vacantia.functions.fields import (
    lenient_date,
    lenient_number,
    remote_type,
    structured_employment_type,
    structured_salary_period,
)
from vacantia.sources.shared import (
    as_postings,
    jobs_in,
    labelled,
    listed,
    one_line,
    paragraphs,
    with_companies,
)

J = F.col


def _job(name: str) -> Column:
    return F.col(f"job.{name}")


def _text(name: str) -> Column:
    return F.coalesce(_job(name), F.lit(""))


# --- boards of one company --------------------------------------------------------------


def greenhouse(landed: DataFrame, companies: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "jobs",
        "id string, title string, updated_at string, absolute_url string, location struct<name:string>, "
        "content string, offices array<struct<name:string>>",
    )
    place = F.coalesce(_job("location.name"), F.get(_job("offices.name"), F.lit(0)))
    remote = F.lower(F.coalesce(place, F.lit(""))).contains("remote")
    return as_postings(
        with_companies(rows, companies), "greenhouse",
        external_id=_job("id"), source_url=_job("absolute_url"), apply_url=_job("absolute_url"),
        company_name=J("company_name"), raw_title=_job("title"), raw_location=place,
        remote_type=F.when(remote, "FULLY_REMOTE").otherwise("UNKNOWN"), description=_text("content"),
        # The board tells when a posting was last edited, the closest it has to a posting date.
        posted_at=lenient_date(_job("updated_at")),
    )


def lever(landed: DataFrame, companies: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, None,
        "id string, text string, hostedUrl string, applyUrl string, createdAt bigint, "
        "categories struct<location:string,team:string,commitment:string>, descriptionPlain string, "
        "workplaceType string, salaryRange struct<min:string,max:string,currency:string,interval:string>",
    )
    return as_postings(
        with_companies(rows, companies), "lever",
        external_id=_job("id"), source_url=_job("hostedUrl"),
        apply_url=F.coalesce(_job("applyUrl"), _job("hostedUrl")), company_name=J("company_name"),
        raw_title=_job("text"), raw_location=_job("categories.location"),
        remote_type=remote_type(F.coalesce(_job("workplaceType"), _job("categories.location"))),
        employment_type=structured_employment_type(_job("categories.commitment")),
        salary_min=lenient_number(_job("salaryRange.min")), salary_max=lenient_number(_job("salaryRange.max")),
        salary_currency=_job("salaryRange.currency"),
        salary_period=structured_salary_period(_job("salaryRange.interval")),
        description=_text("descriptionPlain"),
        posted_at=F.when(_job("createdAt") != 0, F.timestamp_millis(_job("createdAt"))),
    )


def ashby(landed: DataFrame, companies: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "jobs",
        "id string, title string, location string, publishedAt string, jobUrl string, applyUrl string, "
        "descriptionHtml string, isRemote boolean, workplaceType string, employmentType string, "
        "compensation struct<minValue:string,maxValue:string,currency:string,interval:string>",
    )
    return as_postings(
        with_companies(rows, companies), "ashby",
        external_id=_job("id"), source_url=_job("jobUrl"), apply_url=F.coalesce(_job("applyUrl"), _job("jobUrl")),
        company_name=J("company_name"), raw_title=_job("title"), raw_location=_job("location"),
        remote_type=F.when(_job("isRemote"), "FULLY_REMOTE").otherwise(remote_type(_job("workplaceType"))),
        employment_type=structured_employment_type(_job("employmentType")),
        salary_min=lenient_number(_job("compensation.minValue")),
        salary_max=lenient_number(_job("compensation.maxValue")),
        salary_currency=_job("compensation.currency"),
        salary_period=structured_salary_period(_job("compensation.interval")),
        description=_text("descriptionHtml"), posted_at=lenient_date(_job("publishedAt")),
    )


def smartrecruiters(landed_lists: DataFrame, landed_details: DataFrame, companies: DataFrame) -> DataFrame:
    """The list says which postings are open, the detail of each has its texts."""
    wanted = jobs_in(landed_lists, "content", "id string").select("board", F.col("job.id").alias("id")).distinct()
    details = landed_details.select("board", F.col("payload").alias("raw_payload")).withColumn(
        "job",
        F.from_json(
            "raw_payload",
            "id string, name string, location struct<fullLocation:string>, releasedDate string, postingUrl string, "
            "applyUrl string, jobAd struct<sections:map<string,struct<title:string,text:string>>>",
        ),
    )
    rows = details.withColumn("id", _job("id")).join(wanted, ["board", "id"], "left_semi")
    texts = F.transform(F.map_values(_job("jobAd.sections")), lambda s: s["text"])
    filled = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return as_postings(
        with_companies(rows, companies), "smartrecruiters",
        external_id=_job("id"), source_url=_job("postingUrl"), apply_url=_job("applyUrl"),
        company_name=J("company_name"), raw_title=_job("name"), raw_location=_job("location.fullLocation"),
        description=F.coalesce(F.array_join(filled, "\n"), F.lit("")),
        posted_at=lenient_date(_job("releasedDate")),
    )


def _place(item: Column) -> Column:
    return join_present(", ", item["city"], item["state"], item["country"])


def workable(landed: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows without id, URL or title are dropped; see ``workable_collapsed`` for repeated ids."""
    rows = jobs_in(
        landed, "jobs",
        "id string, code string, shortcode string, title string, description string, country string, "
        "state string, city string, location string, telecommuting boolean, workplace_type string, "
        "employment_type string, published_on string, url string, shortlink string, application_url string, "
        "locations array<struct<city:string,state:string,country:string>>, "
        "salary struct<salary_from:string,salary_to:string,salary_currency:string,salary_period:string>",
    )
    ident = F.coalesce(_job("shortcode"), _job("code"), _job("id"))
    url = F.coalesce(_job("url"), _job("shortlink"), _job("application_url"))
    rows = rows.withColumns({"ident": blank_to_null(ident), "url": blank_to_null(url)})
    rows = rows.filter(J("ident").isNotNull() & J("url").isNotNull() & blank_to_null(_job("title")).isNotNull())
    several = F.array_join(F.transform(_job("locations"), _place), "; ")
    place = F.coalesce(
        _job("location"),
        F.when(F.size(_job("locations")) > 0, several).otherwise(_place(J("job"))),
    )
    return as_postings(
        with_companies(rows, companies), "workable",
        external_id=J("ident"), source_url=J("url"), apply_url=F.coalesce(_job("application_url"), J("url")),
        company_name=J("company_name"), company_url=J("company_url"), raw_title=_job("title"),
        raw_location=blank_to_null(place),
        remote_type=F.when(_job("telecommuting"), "FULLY_REMOTE").otherwise(remote_type(_job("workplace_type"))),
        employment_type=structured_employment_type(_job("employment_type")),
        salary_min=lenient_number(_job("salary.salary_from")), salary_max=lenient_number(_job("salary.salary_to")),
        salary_currency=_job("salary.salary_currency"),
        salary_period=structured_salary_period(_job("salary.salary_period")),
        description=_text("description"), posted_at=lenient_date(_job("published_on")),
    )


def workable_collapsed(postings: DataFrame) -> DataFrame:
    """One row per id: the first row's fields, all its distinct places and all payloads.

    Rows that repeat a place and payload are made one before they are gathered, which leaves a
    group the distinct office rows of one posting.
    """
    order = F.struct("board", "page_url", "place")
    fields = [c for c in postings.columns if c not in ("raw_location", "raw_payload", "external_id")]
    distinct = postings.groupBy("external_id", "raw_location", "raw_payload").agg(
        F.min_by(F.struct(*fields), order).alias("fields"), F.min(order).alias("first")
    )
    grouped = distinct.groupBy("external_id").agg(
        F.min_by("fields", "first").alias("fields"),
        F.sort_array(F.collect_list(F.struct("first", "raw_location", "raw_payload"))).alias("all"),
    )
    places = F.array_distinct(F.filter(J("all.raw_location"), lambda p: p.isNotNull()))
    payloads = J("all.raw_payload")
    together = F.concat(F.lit("["), F.array_join(payloads, ","), F.lit("]"))
    out = grouped.select(
        "external_id", "fields.*", listed(places, "; ").alias("raw_location"),
        F.when(F.size(payloads) > 1, together).otherwise(payloads[0]).alias("raw_payload"),
    )
    return out.select(*postings.columns)


def pinpoint(landed: DataFrame, companies: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "data",
        "id string, title string, url string, description string, benefits string, key_responsibilities string, "
        "skills_knowledge_expertise string, employment_type string, workplace_type string, published_at string, "
        "created_at string, compensation_minimum string, compensation_maximum string, "
        "compensation_currency string, compensation_frequency string, "
        "location struct<name:string,city:string,province:string,country:string>",
    )
    rows = rows.filter(
        _job("id").isNotNull() & blank_to_null(_job("title")).isNotNull() & blank_to_null(_job("url")).isNotNull()
    )
    place = join_present(", ", *[_job(f"location.{f}") for f in ("name", "city", "province", "country")])
    return as_postings(
        with_companies(rows, companies), "pinpoint",
        external_id=_job("id"), source_url=_job("url"), apply_url=_job("url"), company_name=J("company_name"),
        company_url=J("company_url"), raw_title=_job("title"),
        raw_location=F.when(_job("location").isNotNull(), place),
        remote_type=remote_type(_job("workplace_type")),
        employment_type=structured_employment_type(_job("employment_type")),
        salary_min=lenient_number(_job("compensation_minimum")),
        salary_max=lenient_number(_job("compensation_maximum")), salary_currency=_job("compensation_currency"),
        salary_period=structured_salary_period(_job("compensation_frequency")),
        description=join_present(
            "\n", _job("description"), _job("key_responsibilities"), _job("skills_knowledge_expertise"),
            _job("benefits"),
        ),
        posted_at=lenient_date(F.coalesce(_job("published_at"), _job("created_at"))),
    )


# --- boards of many companies -----------------------------------------------------------


def _decoded(text: Column) -> Column:
    """Entities decoded, tags and runs of blanks to one blank."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(x[0-9a-f]+|[0-9]+);"), F.lit(1)))

    def character(code: Column) -> Column:
        """The character a reference names; null where there is none."""
        hexadecimal = F.lower(code).startswith("x")
        digits = F.regexp_replace(F.when(hexadecimal, F.substring(code, 2, 2**30)).otherwise(code), "^0+(?=.)", "")
        # Ten digits are more than any code point has in either base.
        decimal = F.when(F.length(digits) <= 10, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits))
        number = decimal.try_cast("int")
        real = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        # Spark's chr() knows Latin-1 only; four big-endian bytes say any code point.
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))

    def replaced(acc: Column, code: Column) -> Column:
        reference = F.concat(F.lit("&#"), code, F.lit(";"))
        return F.replace(acc, reference, F.coalesce(character(code), reference))

    out = F.aggregate(codes, text, replaced)
    for name, plain in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")]:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(plain))
    return collapsed(F.regexp_replace(out, "<[^>]*>", " "))


def hackernews(landed: DataFrame) -> DataFrame:
    """Top-level comments of a hiring thread: "Company | Role | Place …", then the text."""
    rows = landed.withColumn("raw_payload", F.col("payload")).withColumn(
        "job", F.from_json("payload", "id string, time bigint, text string, deleted boolean, dead boolean")
    )
    rows = rows.filter(
        ~F.coalesce(_job("deleted"), F.lit(False)) & ~F.coalesce(_job("dead"), F.lit(False))
        & blank_to_null(_job("text")).isNotNull()
    )
    head = trimmed(F.substring_index(_job("text"), "<p>", 1))
    body = F.when(_job("text").contains("<p>"), trimmed(_job("text").substr(F.instr(_job("text"), "<p>"), F.length(_job("text")))))
    rows = rows.withColumns({"head": head, "body": body}).withColumn("line", _decoded(F.col("head")))
    segments = F.filter(F.transform(F.split("line", r"\|"), trimmed), lambda s: s != "")
    rows = rows.withColumn("segments", segments)
    company = trimmed(F.regexp_replace(F.get("segments", F.lit(0)), r"(?i)\s*\(YC\s+[^)]*\)\s*\z", ""))
    rest = F.array_join(F.slice("segments", F.lit(2), F.size("segments")), " | ")
    title = F.coalesce(blank_to_null(rest), J("line"))
    url = F.concat(F.lit("https://news.ycombinator.com/item?id="), _job("id"))
    return as_postings(
        rows, "hackernews",
        external_id=_job("id"), source_url=url, apply_url=url, raw_title=title, raw_location=title,
        company_name=F.coalesce(blank_to_null(company), F.lit("Unknown")),
        description=join_present("\n", J("head"), J("body")), posted_at=F.timestamp_seconds(_job("time")),
    )


def _set(value: Column) -> Column:
    return F.coalesce(value.try_cast("double") != 0, F.lit(False))


def himalayas(landed: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "jobs",
        "title string, companyName string, employmentType string, minSalary string, maxSalary string, "
        "salaryPeriod string, seniority array<string>, currency string, locationRestrictions array<string>, "
        "description string, pubDate bigint, applicationLink string, guid string",
    )
    bounds = F.concat_ws("–", _job("minSalary"), _job("maxSalary"))
    pay = one_line(F.concat_ws(" ", F.lit("Salary:"), _text("currency"), bounds, _text("salaryPeriod")))
    return as_postings(
        rows, "himalayas",
        external_id=_job("guid"), source_url=_job("guid"),
        apply_url=F.coalesce(_job("applicationLink"), _job("guid")), raw_title=_job("title"),
        raw_location=F.coalesce(listed(_job("locationRestrictions")), F.lit("Worldwide")),
        company_name=_job("companyName"),
        description=paragraphs(
            labelled("Employment type", _job("employmentType")),
            F.when(_set(_job("minSalary")) | _set(_job("maxSalary")), pay),
            labelled("Seniority", listed(_job("seniority"))),
            _job("description"),
        ),
        posted_at=F.when(_job("pubDate") != 0, F.timestamp_seconds(_job("pubDate"))),
    )


def jobgether(landed: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "jobs",
        "id string, title string, company string, url string, location string, remote string, "
        "contractType string, experience string, salaryRange string, jobFunctions array<string>, postedAt string",
    )
    several = F.when(F.size(_job("jobFunctions")) > 1, "Job functions: ").otherwise("Job function: ")
    return as_postings(
        rows, "jobgether",
        external_id=_job("id"), source_url=_job("url"), apply_url=_job("url"), raw_title=_job("title"),
        raw_location=_job("location"), company_name=_job("company"),
        description=F.concat_ws(
            "\n", labelled("Employment type", _job("contractType")),
            labelled("Experience level", _job("experience")), labelled("Remote", _job("remote")),
            labelled("Salary", _job("salaryRange")), F.concat(several, listed(_job("jobFunctions"))),
        ),
        posted_at=lenient_date(_job("postedAt")),
    )


def jobicy(landed: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "jobs",
        "id string, url string, jobTitle string, companyName string, jobType array<string>, jobGeo string, "
        "jobLevel string, jobExcerpt string, jobDescription string, pubDate string",
    )
    return as_postings(
        rows, "jobicy",
        external_id=_job("id"), source_url=_job("url"), apply_url=_job("url"), raw_title=_job("jobTitle"),
        raw_location=_job("jobGeo"), company_name=_job("companyName"),
        description=paragraphs(
            labelled("Employment type", listed(_job("jobType"))), labelled("Level", _job("jobLevel")),
            F.coalesce(blank_to_null(_job("jobDescription")), _job("jobExcerpt"), F.lit("")),
        ),
        posted_at=lenient_date(_job("pubDate")),
    )


def landingjobs(landed: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, None,
        "id string, title string, url string, created_at string, published_at string, remote boolean, "
        "locations array<struct<city:string,country_code:string>>, role_description string, "
        "main_requirements string, nice_to_have string, perks string",
    )
    slug = blank_to_null(F.regexp_extract(_job("url"), "/at/([^/]+)/", 1))
    # Only the first letter is raised; the rest of a word stays as it is.
    words = F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    places = F.transform(_job("locations"), lambda p: join_present(", ", p["city"], p["country_code"]))
    return as_postings(
        rows, "landingjobs",
        external_id=_job("id"), source_url=_job("url"), apply_url=_job("url"), raw_title=_job("title"),
        raw_location=F.coalesce(
            listed(places, " / "), F.when(_job("remote"), "Remote").otherwise("Unspecified")
        ),
        company_name=F.coalesce(F.array_join(words, " "), F.lit("Unknown")),
        description=join_present(
            "\n\n", _job("role_description"), _job("main_requirements"), _job("nice_to_have"), _job("perks")
        ),
        posted_at=lenient_date(F.coalesce(blank_to_null(_job("published_at")), _job("created_at"))),
    )


def nofluffjobs(landed: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "postings",
        "id string, name string, title string, url string, posted bigint, fullyRemote boolean, technology string, "
        "category string, seniority array<string>, "
        "location struct<places:array<struct<city:string,country:struct<code:string,name:string>>>>, "
        "salary struct<from:string,to:string,currency:string,period:string>, "
        "tiles struct<values:array<struct<value:string,type:string>>>",
    )
    places = F.transform(_job("location.places"), lambda p: join_present(", ", p["city"], p["country"]["name"]))
    places = F.filter(places, lambda p: p != "")
    needs = F.transform(
        F.filter(_job("tiles.values"), lambda t: t["type"] == "requirement"), lambda t: t["value"]
    )
    pay = one_line(
        F.concat(
            F.lit("Salary: "), F.coalesce(_job("salary.currency"), F.lit("")), F.lit(" "),
            F.coalesce(_job("salary.from"), F.lit("")), F.lit("–"), F.coalesce(_job("salary.to"), F.lit("")),
            F.lit(" / "), F.coalesce(_job("salary.period"), F.lit("")),
        )
    )
    url = F.concat(F.lit("https://nofluffjobs.com/job/"), _job("url"))
    return as_postings(
        rows, "nofluffjobs",
        external_id=_job("id"), source_url=url, apply_url=url, raw_title=_job("title"), company_name=_job("name"),
        raw_location=F.when(_job("fullyRemote"), "Fully remote").otherwise(
            F.coalesce(listed(places, " / "), F.lit("Remote"))
        ),
        description=F.concat_ws(
            "\n", labelled("Category", _job("category")), labelled("Primary technology", _job("technology")),
            labelled("Seniority", listed(_job("seniority"))), labelled("Requirements", listed(needs)),
            F.when(_set(_job("salary.from")) | _set(_job("salary.to")), pay),
        ),
        posted_at=F.when(_job("posted") != 0, F.timestamp_millis(_job("posted"))),
    )


def remoteok(landed: DataFrame) -> DataFrame:
    """The first element is a notice; it has no ``position``."""
    rows = jobs_in(
        landed, None,
        "id string, company string, position string, location string, date string, url string, description string",
    ).filter(_job("position").isNotNull())
    return as_postings(
        rows, "remoteok",
        external_id=_job("id"), source_url=_job("url"), apply_url=_job("url"), raw_title=_job("position"),
        raw_location=_job("location"), company_name=_job("company"), description=_text("description"),
        posted_at=lenient_date(_job("date")),
    )


# How the board's job types read.
JOB_TYPE_LABELS = {
    "full_time": "Full-time", "part_time": "Part-time", "contract": "Contract", "freelance": "Freelance",
    "internship": "Internship",
}


def remotive(landed: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, "jobs",
        "id string, url string, title string, company_name string, job_type string, publication_date string, "
        "candidate_required_location string, salary string, description string",
    )
    kind = F.coalesce(value_map(JOB_TYPE_LABELS, _job("job_type")), _job("job_type"))
    return as_postings(
        rows, "remotive",
        external_id=_job("id"), source_url=_job("url"), apply_url=_job("url"), raw_title=_job("title"),
        raw_location=_job("candidate_required_location"), company_name=trimmed(_job("company_name")),
        description=paragraphs(
            labelled("Salary", _job("salary")), labelled("Employment type", kind), _job("description")
        ),
        posted_at=lenient_date(_job("publication_date")),
    )


def workingnomads(landed: DataFrame) -> DataFrame:
    rows = jobs_in(
        landed, None,
        "url string, title string, description string, company_name string, tags string, location string, "
        "pub_date string",
    )
    return as_postings(
        rows, "workingnomads",
        external_id=_job("url"), source_url=_job("url"), apply_url=_job("url"), raw_title=_job("title"),
        raw_location=_job("location"), company_name=_job("company_name"),
        description=paragraphs(_job("description"), labelled("Tags", _job("tags"))),
        posted_at=lenient_date(_job("pub_date")),
    )


