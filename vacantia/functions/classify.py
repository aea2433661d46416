"""Dictionary-driven classification of titles and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.columns import (
    SPACE,
    bind,
    first_group,
    quoted,
    string_array,
    trimmed,
    value_map,
)
from vacantia.functions.text import (
    bind_words,
    first_value,
    has_any,
    has_token,
    matching_rows,
    words_have_any,
)


def seniority(lower_title: Column) -> Column:
    return first_value(lower_title, [(level, ks) for level, _, ks in D.SENIORITY])


def role_category(lower_title: Column) -> Column:
    hit = first_value(lower_title, [(slug, ks) for slug, _, _, ks in D.ROLE_CATEGORIES])
    return F.coalesce(hit, F.lit(D.OTHER_CATEGORY))


def role_label(slug: Column) -> Column:
    return value_map({s: label for s, label, _, _ in D.ROLE_CATEGORIES}, slug)


def domain_tags(lower_title: Column, role: Column) -> Column:
    """Tags of the role, then those its domain words add."""
    base = None
    for slug, _, tags, _ in D.ROLE_CATEGORIES:
        hit = role == slug
        base = F.when(hit, string_array(tags)) if base is None else base.when(hit, string_array(tags))
    extra = [F.when(has_any(lower_title, ks), F.lit(tag)) for tag, ks in D.DOMAIN_TAGS]
    return F.array_distinct(
        F.concat(base.otherwise(string_array([])), F.array_compact(F.array(*extra)))
    )


def normalized_title(title: Column, role: Column, level: Column) -> Column:
    """Seniority label and role label; the raw title when no role was recognised."""
    label = role_label(role)
    prefix = value_map({s: text for s, text, _ in D.SENIORITY}, level)
    prefix = F.when(~F.lower(label).contains(F.lower(prefix)), prefix)
    return F.when(role == D.OTHER_CATEGORY, trimmed(title)).otherwise(F.concat_ws(" ", prefix, label))


def with_role(df: DataFrame, title: str = "raw_title") -> DataFrame:
    """Add ``lower_title`` and ``role_category``: all that the first gate needs."""
    return df.withColumn("lower_title", F.lower(title)).withColumn(
        "role_category", role_category(F.col("lower_title"))
    )


def with_title(df: DataFrame, title: str = "raw_title") -> DataFrame:
    """Add role, seniority, normalised title and tags."""
    lower, role = F.col("lower_title"), F.col("role_category")
    out = with_role(df, title).withColumn("seniority", seniority(lower))
    return out.withColumns(
        {
            "normalized_title": normalized_title(F.col(title), role, F.col("seniority")),
            "tags": domain_tags(lower, role),
        }
    )


# Alias rows, longest alias first, so the most specific phrase is reported.
_ALIASES = sorted(
    [(alias, slug, name) for slug, name, _, aliases in D.TECHNOLOGIES for alias in aliases],
    key=lambda row: -len(row[0]),
)


_TECHNOLOGY_HITS = "array<struct<slug:string,name:string,phrase:string>>"


def technology_hits(text: Column, lower: Column, words: Column) -> Column:
    """``array<struct<slug, name, phrase>>`` of the technologies named, given the text's words."""
    slug, token = D.EXACT_CASE_TECHNOLOGY
    name = next(n for s, n, _, _ in D.TECHNOLOGIES if s == slug)

    def row(s: Column, n: Column, p: Column) -> Column:
        return F.struct(s.alias("slug"), n.alias("name"), p.alias("phrase"))

    exact = F.when(
        has_token(text, token), F.array(row(F.lit(slug), F.lit(name), F.lit(token)))
    ).otherwise(F.array().cast(_TECHNOLOGY_HITS))
    hits = matching_rows(lower, words, ["phrase", "slug", "name"], _ALIASES)
    rows = F.concat(F.transform(hits, lambda h: row(h["slug"], h["name"], h["phrase"])), exact)

    def first_per_slug(found: Column) -> Column:
        slugs = F.transform(found, lambda r: r["slug"])
        return F.filter(found, lambda r, i: F.array_position(slugs, r["slug"]) == i + 1)

    return bind(rows, first_per_slug)


def technologies(text: Column) -> Column:
    hits = bind_words(text, lambda lower, words: technology_hits(text, lower, words))
    return F.coalesce(hits, F.array().cast(_TECHNOLOGY_HITS))


def stated_employment(lower: Column, words: Column) -> Column:
    return F.coalesce(
        *[F.when(words_have_any(lower, words, ks), F.lit(kind)) for kind, ks in D.EMPLOYMENT_KEYWORDS]
    )


def employment_type(text: Column) -> Column:
    """Employment type a text states; null when it states none."""
    return bind_words(text, stated_employment)


_NUMBER = rf"\d+(?:[,{SPACE}]\d{{3}}(?!\d))*(?:\.\d+)?"
_CURRENCY = "|".join(quoted(t) for t in [*D.CURRENCY_SYMBOLS, *D.CURRENCY_CODES])
_REST = (
    rf"({_NUMBER})(k)?"
    rf"(?:[{SPACE}]*(?:-|–|—|to)[{SPACE}]*(?:({_CURRENCY})[{SPACE}]?)?({_NUMBER})(k)?)?"
)
# In a text the search goes from digit to digit and looks back for the currency: trying all
# currencies at every letter would cost far more. In a found span the order is as written.
_IN_TEXT = rf"(?i)(?=\d)(?<=({_CURRENCY})[{SPACE}]?){_REST}"
_IN_SPAN = rf"(?i)^({_CURRENCY})[{SPACE}]?{_REST}"


def salary_period(text: Column) -> Column:
    lower = F.lower(text)
    rules = []
    for period, words in D.PERIOD_KEYWORDS:
        hit = lower.contains(words[0])
        for word in words[1:]:
            hit = hit | lower.contains(word)
        rules.append(F.when(hit, F.lit(period)))
    return F.coalesce(*rules)


def salary_span(text: Column) -> Column:
    """The first currency-led amount or range."""
    return F.when(
        text.rlike(rf"(?i)(?=\d)(?<=(?:{_CURRENCY})[{SPACE}]?)"),
        F.concat(F.regexp_extract(text, _IN_TEXT, 1), F.regexp_extract(text, _IN_TEXT, 0)),
    )


def salary_of_span(span: Column, text: Column) -> Column:
    """``struct<min, max, currency, period>`` read from a span found in ``text``."""

    def part(group: int) -> Column:
        return first_group(span, _IN_SPAN, group)

    def amount(number: Column, k: Column) -> Column:
        value = F.regexp_replace(number, rf"[,{SPACE}]", "").try_cast("double")
        return F.when(k.isNotNull(), value * 1000).otherwise(value)

    low, high = amount(part(2), part(3)), amount(part(5), part(6))
    token = F.coalesce(part(4), part(1))
    currency = F.coalesce(value_map(D.CURRENCY_SYMBOLS, token), F.upper(token))
    # least and greatest skip nulls: a single amount is both bounds.
    return F.struct(
        F.least(low, high).alias("min"),
        F.greatest(low, high).alias("max"),
        currency.alias("currency"),
        F.when(span.isNotNull(), salary_period(text)).alias("period"),
    )


def salary(text: Column) -> Column:
    return bind(salary_span(text), lambda span: salary_of_span(span, text))


def prefer_structured(df: DataFrame, extracted: str = "extracted_salary") -> DataFrame:
    """Fields the source gave beat what the text says, one by one."""
    out = {"employment_type": F.coalesce("employment_type", "extracted_employment_type")}
    for field in ("min", "max", "currency", "period"):
        out[f"salary_{field}"] = F.coalesce(f"salary_{field}", F.col(extracted)[field])
    return df.withColumns(out)
