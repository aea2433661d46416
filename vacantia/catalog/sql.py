"""Pieces of DuckDB SQL shared by the check queries."""

from __future__ import annotations

from collections.abc import Sequence

from vacantia import dictionaries as D
from vacantia.functions.columns import quoted
from vacantia.functions.text import URL_PATTERN
from vacantia.plans import binding as B

SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def array(values: Sequence[str | None]) -> str:
    return "CAST([" + ", ".join(lit(v) for v in values) + "] AS VARCHAR[])"


def arrays(values: Sequence[Sequence[str]]) -> str:
    return "[" + ", ".join(array(v) for v in values) + "]"


def pick(values: Sequence[str | None], key: str) -> str:
    return f"list_extract({array(values)}, CAST(({key}) % {len(values)} AS INTEGER) + 1)"


def pick_array(values: Sequence[Sequence[str]], key: str) -> str:
    return f"list_extract({arrays(values)}, CAST(({key}) % {len(values)} AS INTEGER) + 1)"


def sub(text: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {to}, '{flags}')"


def trim(text: str) -> str:
    return sub(text, rf"^[{SPACE}]+|[{SPACE}]+$", "''")


def collapse(text: str) -> str:
    return sub(trim(text), rf"[{SPACE}]+", "' '")


def group(text: str, pattern: str, n: int, flags: str = "") -> str:
    return f"nullif(regexp_extract({text}, {lit(pattern)}, {n}, '{flags}'), '')"


def strip_html(html: str) -> str:
    out = sub(html, r"<script[^>]*>.*?</script>", "' '", "gis")
    out = sub(out, r"<style[^>]*>.*?</style>", "' '", "gis")
    out = sub(out, r"<br\s*/?>", "chr(10)", "gi")
    out = sub(out, r"</(p|div|li|h[1-6]|tr)>", "chr(10)", "gi")
    out = sub(out, r"<[^>]+>", "' '")
    for name, plain in [
        ("nbsp", "' '"), ("amp", "'&'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "''''"),
    ]:
        out = sub(out, f"&{name};", plain, "gi")
    out = sub(out, r"[ \t]+", "' '")
    out = sub(out, r"[ \t]*\n[ \t]*", "chr(10)")
    return trim(sub(out, r"\n{3,}", "chr(10) || chr(10)"))


def has(text: str, phrase: str) -> str:
    pattern = f"(^|[^a-z0-9]){quoted(phrase)}($|[^a-z0-9])"
    return f"(contains({text}, {lit(phrase)}) AND regexp_matches({text}, {lit(pattern)}))"


def has_any(text: str, phrases: Sequence[str]) -> str:
    body = "|".join(quoted(p) for p in phrases)
    return f"regexp_matches({text}, {lit(f'(^|[^a-z0-9])({body})($|[^a-z0-9])')})"


def case(rules: Sequence[tuple[str, str | None]], default: str = "NULL") -> str:
    body = " ".join(f"WHEN {cond} THEN {lit(v)}" for cond, v in rules)
    return f"CASE {body} ELSE {default} END"


def values(name: str, columns: Sequence[str], rows: Sequence[Sequence[str | int | None]]) -> str:
    body = ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else lit(v) for v in row) + ")" for row in rows
    )
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def phrase_rows() -> str:
    """All dictionaries as a CTE: dict, ord, phrase, value, pattern."""
    rows = [
        (d, i, p, v, f"(^|[^a-z0-9]){quoted(p)}($|[^a-z0-9])") for d, i, p, v in D.dictionary_rows()
    ]
    return values("phrases", ["dict", "ord", "phrase", "value", "pattern"], rows)


def company_norm(name: str) -> str:
    out = sub(f"lower({name})", "[.,]", "''")
    out = trim(sub(out, rf"[^a-z0-9{SPACE}&-]", "' '"))
    for suffix in D.LEGAL_SUFFIXES:
        out = trim(sub(out, rf"(^|[{SPACE}]){suffix}$", "''", ""))
    return collapse(out)


def company_slug(name: str) -> str:
    return sub(sub(f"strip_accents(lower({name}))", "[^a-z0-9]+", "'-'"), "^-+|-+$", "''")


def apply_url(url: str) -> str:
    pattern = lit(URL_PATTERN)
    host = f"regexp_replace(lower(regexp_extract({url}, {pattern}, 1)), '^www\\.', '')"
    path = sub(trim(f"regexp_extract({url}, {pattern}, 2)"), "/+$", "''")
    return (
        f"CASE WHEN regexp_matches({url}, {pattern}) THEN {host} || {path} "
        f"ELSE {trim(f'lower({url})')} END"
    )


def padded(text: str) -> str:
    return f"'  ' || {trim(f'lower({text})')} || '  '"


def dice_grams(padded_column: str) -> str:
    p = padded_column
    return f"list_distinct(list_transform(range(1, length({p}) - 1), lambda i: substr({p}, i, 3)))"


def dice(a: str, b: str) -> str:
    return f"2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


def word_grams(text: str) -> str:
    return (
        rf"list_distinct(flatten(list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def seniority(lower: str) -> str:
    return case([(has_any(lower, ks), level) for level, _, ks in D.SENIORITY])


def role(lower: str) -> str:
    return case([(has_any(lower, ks), slug) for slug, _, _, ks in D.ROLE_CATEGORIES], "'OTHER'")


def role_label(slug: str) -> str:
    return case([(f"{slug} = {lit(s)}", label) for s, label, _, _ in D.ROLE_CATEGORIES])


def normalized_title(title: str, role_column: str, level: str) -> str:
    label = role_label(role_column)
    prefix = case([(f"{level} = {lit(s)}", text) for s, text, _ in D.SENIORITY])
    return (
        f"CASE WHEN {role_column} = 'OTHER' THEN {trim(title)} "
        f"WHEN {prefix} IS NULL OR contains(lower({label}), lower({prefix})) THEN {label} "
        f"ELSE {prefix} || ' ' || {label} END"
    )


def fingerprint(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"lower({collapse(p)})" for p in parts) + ")"


NUMBER = r"\d+(?:[,\s]\d{3})*(?:\.\d+)?"
CURRENCY = "|".join(quoted(t) for t in [*D.CURRENCY_SYMBOLS, *D.CURRENCY_CODES])
SALARY = rf"(?i)({CURRENCY})\s?({NUMBER})(k)?(?:\s*(?:-|–|—|to)\s*(?:({CURRENCY})\s?)?({NUMBER})(k)?)?"


def salary_period(text: str) -> str:
    return case(
        [
            (" OR ".join(f"contains(lower({text}), {lit(w)})" for w in words), period)
            for period, words in D.PERIOD_KEYWORDS
        ]
    )


def salary(text: str) -> dict[str, str]:
    def amount(n: int, k: int) -> str:
        number = sub(group(text, SALARY, n), r"[,\s]", "''")
        scale = f"CASE WHEN {group(text, SALARY, k)} IS NOT NULL THEN 1000 ELSE 1 END"
        return f"TRY_CAST({number} AS DOUBLE) * {scale}"

    token = f"coalesce({group(text, SALARY, 4)}, {group(text, SALARY, 1)})"
    symbols = " ".join(f"WHEN {lit(s)} THEN {lit(c)}" for s, c in D.CURRENCY_SYMBOLS.items())
    return {
        "min": f"least({amount(2, 3)}, {amount(5, 6)})",
        "max": f"greatest({amount(2, 3)}, {amount(5, 6)})",
        "currency": f"CASE {token} {symbols} ELSE upper({token}) END",
        "period": f"CASE WHEN {group(text, SALARY, 1)} IS NOT NULL THEN {salary_period(text)} END",
    }


_URL = (
    "'https://www.Jobs.example.com/' || source || '/' || ((doc_id * 7) % 997) || '/?ref=feed#top'"
)
POSTINGS = f"""postings AS (
  SELECT doc_id, source AS source_slug, CAST(doc_id AS VARCHAR) AS external_id,
    {_URL} AS source_url, {_URL} AS apply_url,
    {pick(B.COMPANIES, 'doc_id')} AS company_name, {pick(B.TITLES, 'doc_id')} AS raw_title,
    {pick(B.LOCATIONS, 'doc_id')} AS raw_location,
    text || chr(10) || {pick(B.SNIPPETS, 'doc_id')} AS description,
    CASE WHEN doc_id % 4 <> 0 THEN {B.BASE_EPOCH} + (doc_id * 7919) % 2592000 END AS posted_epoch,
    {pick(['FULLY_REMOTE', None, 'HYBRID', 'UNKNOWN', None], 'doc_id')} AS remote_type,
    CASE WHEN doc_id % 10 = 0 THEN 'CONTRACT' END AS employment_type,
    CASE WHEN doc_id % 17 = 0 THEN 50000.0::DOUBLE END AS salary_min,
    CASE WHEN doc_id % 17 = 0 THEN 70000.0::DOUBLE END AS salary_max,
    CASE WHEN doc_id % 17 = 0 THEN 'EUR' END AS salary_currency,
    CASE WHEN doc_id % 34 = 0 THEN 'YEARLY' END AS salary_period,
    '{{"doc_id":' || doc_id || ',"source":"' || source || '","lang":"' || lang ||
      '","n_chars":' || n_chars || '}}' AS raw_payload
  FROM documents)"""

_MODULO_LOW = "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 10) AS INTEGER) END"
JOBS = f"""jobs AS (
  SELECT *, salary_min + 1000 AS salary_max,
    CASE WHEN salary_min IS NOT NULL THEN 'EUR' END AS salary_currency,
    CASE WHEN salary_min IS NOT NULL THEN 'YEARLY' END AS salary_period
  FROM (SELECT o_orderkey AS job_id, {pick([t.strip() for t in B.TITLES], 'o_orderkey')} AS title,
    {pick([l for _, l, _, _ in D.ROLE_CATEGORIES], 'o_orderkey')} AS normalized_title,
    {pick(B.ROLE_SLUGS, 'o_orderkey')} AS role_category,
    {pick(B.SENIORITY_SLUGS, 'o_orderkey')} AS seniority,
    'customer-' || o_custkey AS company_slug,
    'Work with ' || {pick(B.TECH_SLUGS, 'o_orderkey * 3')} || ' ' || o_orderpriority AS description_text,
    {pick_array(B.COUNTRY_SETS, 'o_orderkey')} AS eligible_countries,
    {pick_array(B.REGION_SETS, 'o_orderkey')} AS eligible_regions,
    {pick(B.EMPLOYMENT, 'o_orderkey')} AS employment_type,
    {pick(B.REMOTE, 'o_orderkey')} AS remote_type,
    {_MODULO_LOW} AS salary_min,
    o_orderdate AS posted_at, o_orderkey % 3 = 0 AS posted_at_is_inferred,
    'https://apply.example.com/' || o_orderkey AS apply_url,
    o_orderstatus <> 'F' AS is_active FROM orders) j)"""
COMPANIES = """companies AS (
  SELECT 'customer-' || c_custkey AS slug, c_name AS name,
    CASE WHEN c_custkey % 2 = 0 THEN 'https://c' || c_custkey || '.example.com' END AS website_url
  FROM customer)"""
LISTINGS = f"""listings AS (
  SELECT l_orderkey AS job_id, {pick(B.SOURCE_SLUGS, 'l_suppkey')} AS source_slug,
    l_orderkey || '-' || l_linenumber AS external_id,
    'https://listing.example.com/' || l_orderkey || '-' || l_linenumber AS source_url,
    l_shipdate AS first_discovered_at, l_shipdate AS last_seen_at, l_returnflag <> 'R' AS is_active
  FROM lineitem)"""
JOB_TECHNOLOGIES = f"""job_technologies AS (
  SELECT DISTINCT l_orderkey AS job_id, {pick(B.TECH_SLUGS, 'l_partkey')} AS technology FROM lineitem)"""
SOURCES = values("sources", ["slug", "display_name", "integration_method", "status"], D.SOURCES)
TECHNOLOGIES = values(
    "technologies", ["slug", "display_name"], [(s, n) for s, n, _, _ in D.TECHNOLOGIES]
)
ROLES = values(
    "role_categories", ["slug", "label"], [(s, l) for s, l, _, _ in D.ROLE_CATEGORIES]
)
OUTCOMES = f"""outcomes AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run_id,
    {pick(B.SOURCE_SLUGS, 'user_id')} AS source_slug, event_id AS ordinal,
    CAST(event_id AS VARCHAR) AS external_id, ts AS occurred_at,
    CASE WHEN NOT (event_type = 'error' AND user_id % 3 <> 0) THEN
      {pick(['CREATED', 'MERGED', 'UPDATED_EXISTING_LISTING', 'UNCHANGED', 'REJECTED_GEOGRAPHY',
             'REJECTED_ROLE_CATEGORY'], 'event_id')} END AS outcome,
    CASE WHEN event_type = 'error' AND user_id % 3 <> 0 THEN 'failed: ' || props END AS error
  FROM events)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
