"""Posting-shaped views over the general-purpose test tables.

The tables hold no postings, so each view projects them deterministically: a document is
a posting (company, title, place and a pay or stack sentence chosen by ``doc_id``), an order
is a canonical job, a line item is a listing and names a technology.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.columns import string_array

COMPANIES = [
    "Acme GmbH", "Globex, Inc", "Globex Inc", "Initech LLC", "Müller & Söhne AG", "Hooli",
    "Stark Industries Ltd.", "Wayne Co", "Società Blu S.r.o.", "Açaí Labs", "Umbrella Corp",
    "Tyrell Corporation", "Cyberdyne S.A.",
]
TITLES = [
    "Senior Backend Engineer", "Frontend Developer", "Sr. Fullstack Software Developer - AI Platform",
    "Staff Site Reliability Engineer", "Account Executive", "Data Engineer", "Lead iOS Developer",
    "Principal Software Architect", "Engineering Manager", "Director of Engineering",
    "Junior QA Engineer", "Machine Learning Engineer (GenAI)", "Office Coordinator",
    "Android Engineer - Remote, Germany", "DevOps Engineer", "Cloud Engineer, Big Data",
    "Senior Engineering Manager", "Mid-Level Python Developer", "Internship Software Engineer",
    "Sales Manager", "Analytics Engineer", "Data Scientist, LLM", "Security Engineer",
    "Generative AI Engineer", "Solutions Architect - European Union", "Platform Engineer (Go)",
    "Mobile Developer", "Test Automation Specialist", "Tech Lead Backend", "  Marketing Lead  ",
    "Software Engineer (US only)", "Senior Software Engineer", "Senior Frontend Engineer",
    "Backend Engineer", "Sr Data Engineer", "Engineer", "Customer Support",
]
LOCATIONS = [
    "Remote - Europe", "Remote (EU)", "Berlin, Germany", "London, UK", "Worldwide",
    "San Francisco, CA", "Remote US", "Remote, Canada", "Paris, France; Madrid, Spain",
    "APAC only", "CET timezone", "Anywhere in the world", "Remote", "Wilmington, DE",
    "Remote North America", "U.S. or U.K.", "Our European team", "Bengaluru, IN",
    "Remote EMEA, UAE", "Located in the EU", "Lisbon, Portugal", "Zurich, Switzerland",
    "Warsaw, PL", "Czech Republic", "Türkiye", "Remote EEA", "Tbilisi, Georgia", "USA",
    "Offices across Europe", "Global remote", "European Union only", "Dublin, Ireland",
    "Oslo, NO", "Rome, Italy", "UTC+1 or UTC+2", "Brazil", "Middle East only", "Amsterdam, Holland",
    "West Coast", "Côte d'Ivoire", "   ",
]
SNIPPETS = [
    "",
    "<p>Salary: €60k - €80k per year</p><p>Python, AWS &amp; Kubernetes</p>",
    "<div>Contract role, £450 per day.<br/>React.js and Node.js</div>",
    "<p>Open to candidates based in EMEA.</p>",
    "<p>Our European team works CET hours.</p>",
    "<p>USD 120,000 to 150,000 annually.</p><li>Apache Kafka, Spark, Go</li>",
    "<p>Full-time, permanent.</p>\n\n\n<p>Remote worldwide.</p>",
    "<ul><li>APAC only</li><li>golang, rust</li></ul>",
    "<p>freelance b2b, PLN 20000 – 25000 / mies</p>",
    "<p>North America only</p>&nbsp;<b>Large language models</b> &lt;RAG&gt;",
    "<style>p{margin:0}</style><script>var x = '</p>';</script><p>Part-time, $45/hour, C# and .NET</p>",
]
BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z
NOW_EPOCH = BASE_EPOCH + 31 * 86400


def pick(values: Sequence[str | None], key: Column) -> Column:
    """One of the values, by key modulo their number."""
    array = F.array(*[F.lit(v) for v in values])
    return F.get(array, F.pmod(key, F.lit(len(values))).cast("int"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in-flight posting per document."""
    doc = F.col("doc_id")
    url = F.concat(
        F.lit("https://www.Jobs.example.com/"), F.col("source"), F.lit("/"),
        F.pmod(doc * 7, F.lit(997)).cast("string"), F.lit("/?ref=feed#top"),
    )
    return read(spark, sf_dir, "documents").select(
        doc,
        F.col("source").alias("source_slug"),
        doc.cast("string").alias("external_id"),
        url.alias("source_url"),
        url.alias("apply_url"),
        pick(COMPANIES, doc).alias("company_name"),
        F.lit(None).cast("string").alias("company_url"),
        pick(TITLES, doc).alias("raw_title"),
        pick(LOCATIONS, doc).alias("raw_location"),
        F.concat_ws("\n", "text", pick(SNIPPETS, doc)).alias("description"),
        F.when(doc % 4 != 0, F.timestamp_seconds(F.lit(BASE_EPOCH) + (doc * 7919) % 2592000)).alias(
            "posted_at"
        ),
        pick(["FULLY_REMOTE", None, "HYBRID", "UNKNOWN", None], doc).alias("remote_type"),
        F.when(doc % 10 == 0, "CONTRACT").alias("employment_type"),
        F.when(doc % 17 == 0, F.lit(50000.0)).alias("salary_min"),
        F.when(doc % 17 == 0, F.lit(70000.0)).alias("salary_max"),
        F.when(doc % 17 == 0, "EUR").alias("salary_currency"),
        F.when(doc % 34 == 0, "YEARLY").alias("salary_period"),
        F.to_json(F.struct("doc_id", "source", "lang", "n_chars")).alias("raw_payload"),
    )


# --- canonical tables over orders -------------------------------------------------------

ROLE_SLUGS = [slug for slug, _, _, _ in D.ROLE_CATEGORIES]
SENIORITY_SLUGS = [level for level, _, _ in D.SENIORITY] + [None]
TECH_SLUGS = [slug for slug, _, _, _ in D.TECHNOLOGIES]
SOURCE_SLUGS = [slug for slug, _, _, status in D.SOURCES if status != "UNSUPPORTED"]
COUNTRY_SETS = [[], ["DE"], ["US"], ["FR", "ES"], ["GB", "US"], [], ["PL"]]
REGION_SETS = [
    ["EUROPE"], ["EU", "EEA", "EUROPE", "EMEA"], ["WORLDWIDE"], [], ["EMEA"], ["EUROPE", "EMEA"],
]
EMPLOYMENT = ["PERMANENT", "CONTRACT", None, "FREELANCE", "PART_TIME", "INTERNSHIP"]
REMOTE = ["FULLY_REMOTE", "HYBRID", "UNKNOWN", "FULLY_REMOTE"]


def _pick_array(values: Sequence[Sequence[str]], key: Column) -> Column:
    return F.get(
        F.array(*[string_array(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canonical job per order."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    low = F.when(key % 5 != 0, F.floor(price / 10).cast("int"))
    return read(spark, sf_dir, "orders").select(
        key.alias("job_id"),
        pick([t.strip() for t in TITLES], key).alias("title"),
        pick([label for _, label, _, _ in D.ROLE_CATEGORIES], key).alias("normalized_title"),
        pick(ROLE_SLUGS, key).alias("role_category"),
        pick(SENIORITY_SLUGS, key).alias("seniority"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("company_slug"),
        F.concat_ws(" ", F.lit("Work with"), pick(TECH_SLUGS, key * 3), "o_orderpriority").alias(
            "description_text"
        ),
        _pick_array(COUNTRY_SETS, key).alias("eligible_countries"),
        _pick_array(REGION_SETS, key).alias("eligible_regions"),
        pick(EMPLOYMENT, key).alias("employment_type"),
        pick(REMOTE, key).alias("remote_type"),
        low.alias("salary_min"),
        (low + 1000).alias("salary_max"),
        F.when(low.isNotNull(), "EUR").alias("salary_currency"),
        F.when(low.isNotNull(), "YEARLY").alias("salary_period"),
        F.col("o_orderdate").alias("posted_at"),
        (key % 3 == 0).alias("posted_at_is_inferred"),
        F.concat(F.lit("https://apply.example.com/"), key.cast("string")).alias("apply_url"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("slug"),
        F.col("c_name").alias("name"),
        F.when(
            F.col("c_custkey") % 2 == 0,
            F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example.com")),
        ).alias("website_url"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        pick(SOURCE_SLUGS, F.col("l_suppkey")).alias("source_slug"),
        ident.alias("external_id"),
        F.concat(F.lit("https://listing.example.com/"), ident).alias("source_url"),
        F.col("l_shipdate").alias("first_discovered_at"),
        F.col("l_shipdate").alias("last_seen_at"),
        (F.col("l_returnflag") != "R").alias("is_active"),
    )


def job_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("job_id"),
            pick(TECH_SLUGS, F.col("l_partkey")).alias("technology"),
        )
        .distinct()
    )


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        D.SOURCES, "slug string, display_name string, integration_method string, status string"
    )


def technologies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(slug, name, category) for slug, name, category, _ in D.TECHNOLOGIES],
        "slug string, display_name string, category string",
    )


def role_categories(spark: SparkSession) -> DataFrame:
    rows = [(slug, label) for slug, label, _, _ in D.ROLE_CATEGORIES] + [(D.OTHER_CATEGORY, "Other")]
    return spark.createDataFrame(rows, "slug string, label string")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-posting results of ingestion runs: a user's events of a day are a run of one source."""
    kinds = ["CREATED", "MERGED", "UPDATED_EXISTING_LISTING", "UNCHANGED", "REJECTED_GEOGRAPHY",
             "REJECTED_ROLE_CATEGORY"]
    day = F.date_format("ts", "yyyyMMdd")
    failed = (F.col("event_type") == "error") & (F.col("user_id") % 3 != 0)
    return read(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("run_id"),
        pick(SOURCE_SLUGS, F.col("user_id")).alias("source_slug"),
        F.col("event_id").alias("ordinal"),
        F.col("event_id").cast("string").alias("external_id"),
        F.col("ts").alias("occurred_at"),
        F.when(~failed, pick(kinds, F.col("event_id"))).alias("outcome"),
        F.when(failed, F.concat(F.lit("failed: "), F.col("props"))).alias("error"),
    )
