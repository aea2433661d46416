"""Location signals and the eligibility decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.columns import bind, present, sql_text, string_array, value_map
from vacantia.functions.text import bind_words, matching_rows

SIGNALS = "array<struct<phrase:string,field:string,kind:string,value:string>>"

# (phrase, kind, value), in the order signals are reported.
_BROAD = (
    [(p, "region", region) for region, ps in D.REGION_PHRASES.items() for p in ps]
    + [(p, "worldwide", "WORLDWIDE") for p in D.WORLDWIDE_PHRASES]
    + [(p, "us-eligible", "US") for p in D.US_ELIGIBLE_PHRASES]
    + [(p, "exclusive-non-european", None) for p in D.EXCLUSIVE_PHRASES]
)
_COUNTRY = [(p, "country", code) for p, code in D.COUNTRY_PHRASES]
_LATE = [(p, "timezone", None) for p in D.TIMEZONE_PHRASES] + [
    (p, "weak-company", None) for p in D.WEAK_COMPANY_PHRASES
]
_TRUSTING_FIELDS = ("locationRaw", "structured")

_WORD = "[A-Za-z0-9_]"
_DOTTED = rf"(?<!{_WORD})([A-Z])\.(?=[A-Z](?!{_WORD}))"
_SHORT = rf"(?<!{_WORD})[A-Z]{{2,4}}(?!{_WORD})"


def countries(spark: SparkSession) -> DataFrame:
    """The country dimension: code, name, aliases and region flags."""
    rows = [
        (c, n, D.COUNTRY_ALIASES.get(c, []), *[r in rs for r in ("EUROPE", "EU", "EEA", "EMEA")])
        for c, n, rs in D.COUNTRIES
    ]
    return spark.createDataFrame(
        rows,
        "code string, name string, aliases array<string>, "
        "is_europe boolean, is_eu boolean, is_eea boolean, is_emea boolean",
    )


def _region_map() -> Column:
    pairs = ", ".join(
        f"{sql_text(code)}, array({', '.join(sql_text(r) for r in regions)})"
        if regions
        else f"{sql_text(code)}, CAST(array() AS array<string>)"
        for code, regions in D.COUNTRY_REGIONS.items()
    )
    return F.expr(f"map({pairs})")


def regions_of(code: Column) -> Column:
    """Regions a country belongs to, most specific first; empty for unknown codes."""
    return F.coalesce(F.try_element_at(_region_map(), F.upper(code)), string_array([]))


def country_name(code: Column) -> Column:
    return value_map({c: n for c, n, _ in D.COUNTRIES}, F.upper(code))


def is_member(code: Column, region: str) -> Column:
    return F.array_contains(regions_of(code), region)


def short_codes(text: Column, field: str) -> Column:
    """``array<struct<phrase, value>>`` of the isolated upper-case country codes in the text."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, _DOTTED, "$1"), F.lit(_SHORT), F.lit(0))
    known = {c: c for c in D.COUNTRY_CODES} if field in _TRUSTING_FIELDS else D.SAFE_SHORT_CODES
    pairs = F.transform(
        tokens, lambda t: F.struct(t.alias("phrase"), value_map(known, t).alias("value"))
    )
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def _as_signals(rows: Column, field: str) -> Column:
    return F.transform(
        rows,
        lambda r: F.struct(
            r["phrase"].alias("phrase"), F.lit(field).alias("field"), r["kind"].alias("kind"),
            r["value"].alias("value"),
        ),
    )


def _values(signals: Column, *kinds: str) -> Column:
    hits = F.filter(signals, lambda s: s["kind"].isin(*kinds))
    return F.array_distinct(F.transform(hits, lambda s: s["value"]))


def _dictionary_signals(lower: Column, words: Column, field: str, rows) -> Column:
    return _as_signals(matching_rows(lower, words, ["phrase", "kind", "value"], rows), field)


_DECIDING_KINDS = [
    "region", "us-eligible", "exclusive-non-european", "worldwide", "timezone", "weak-company",
]


def _first_of(signals: Column, kind: str) -> Column:
    return F.get(F.filter(signals, lambda s: s["kind"] == kind), F.lit(0))


def location_signals(text: Column, field: str) -> Column:
    """All signals of one field: ``array<struct<phrase, field, kind, value>>``."""

    def with_codes(found: Column) -> Column:
        def new_codes(pairs: Column) -> Column:
            codes = F.transform(pairs, lambda p: p["value"])
            named = _values(found, "us-eligible", "country")
            fresh = F.filter(
                pairs,
                lambda p, i: ~F.array_contains(named, p["value"])
                & (F.array_position(codes, p["value"]) == i + 1),
            )
            return F.transform(
                fresh,
                lambda p: F.struct(
                    p["phrase"].alias("phrase"), F.lit(field).alias("field"),
                    F.lit("country").alias("kind"), p["value"].alias("value"),
                ),
            )

        return F.concat(found, bind(short_codes(text, field), new_codes))

    def gather(lower: Column, words: Column) -> Column:
        early = _dictionary_signals(lower, words, field, _BROAD + _COUNTRY)
        late = _dictionary_signals(lower, words, field, _LATE)
        return F.concat(bind(early, with_codes), late)

    return F.when(present(text), bind_words(text, gather)).otherwise(F.array().cast(SIGNALS))


def phrase_signals(lower: Column, words: Column, field: str) -> Column:
    """Signals without countries: what a description may contribute to the decision."""
    return F.coalesce(
        _dictionary_signals(lower, words, field, _BROAD + _LATE), F.array().cast(SIGNALS)
    )


def exclusivity(text: Column) -> Column:
    hits = [F.lower(text).contains(m) for m in D.EXCLUSIVITY_MARKERS]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def normalized_location(text: Column, field: str = "locationRaw") -> Column:
    """``struct<regions, countries, is_worldwide, is_exclusive_list, signals>`` of one field."""
    return bind(
        location_signals(text, field),
        lambda s: F.struct(
            _values(s, "region").alias("regions"),
            _values(s, "us-eligible", "country").alias("countries"),
            F.exists(s, lambda x: x["kind"] == "worldwide").alias("is_worldwide"),
            (exclusivity(text) & present(text)).alias("is_exclusive_list"),
            s.alias("signals"),
        ),
    )


def supported(code: Column) -> Column:
    return F.coalesce(code.isin(D.SUPPORTED_COUNTRIES), F.lit(False))


def implied_regions(codes: Column, explicit: Column) -> Column:
    """Explicit regions, then those of each country, without repeats."""
    return F.array_distinct(F.concat(explicit, F.flatten(F.transform(codes, regions_of))))


def location_label(regions: Column, codes: Column) -> Column:
    label = F.when(F.array_contains(regions, "WORLDWIDE"), "Remote (Worldwide)")
    for region in D.REGION_LABEL_ORDER:
        label = label.when(F.array_contains(regions, region), f"Remote ({region})")
    return label.when(
        F.size(codes) > 0, F.concat(F.lit("Remote ("), F.array_join(codes, ", "), F.lit(")"))
    ).otherwise("Remote")


def with_eligibility(
    df: DataFrame,
    location: str = "raw_location",
    title: str = "raw_title",
    description: str = "description_text",
    structured: str | None = None,
    prose: Column | None = None,
) -> DataFrame:
    """Add ``geo``: struct<eligible, confidence, countries, regions, reason, signals>.

    Title, location and structured places decide about countries; the description
    contributes phrases only, so the country list is never searched in long texts. A caller
    that has the description's ``phrase_signals`` already passes them as ``prose``.
    """
    if prose is None:
        prose = bind_words(
            F.col(description), lambda lower, words: phrase_signals(lower, words, "description")
        )
    decisive = [
        location_signals(F.col(location), "locationRaw"),
        location_signals(F.col(title), "title"),
    ]
    if structured is not None:
        places = F.coalesce(F.col(structured), string_array([]))
        decisive.insert(
            0, F.flatten(F.transform(places, lambda p: location_signals(p, "structured")))
        )
    out = df.withColumns(
        {"_decisive": F.concat(*decisive), "_prose": prose}
    )
    out = out.withColumns(
        {
            "_signals": F.concat("_decisive", "_prose"),
            "_named": _values(F.col("_decisive"), "us-eligible", "country"),
        }
    )
    signals, named = F.col("_signals"), F.col("_named")
    out = out.withColumns(
        {
            "_supported": F.filter(named, supported),
            "_regions": _values(signals, "region"),
            **{f"_first_{kind}": _first_of(signals, kind) for kind in _DECIDING_KINDS},
        }
    )

    def first(kind: str) -> Column:
        return F.col(f"`_first_{kind}`")

    def quote(prefix: str, kind: str) -> Column:
        return F.concat(F.lit(f'{prefix}: "'), first(kind)["phrase"], F.lit('"'))

    def listing(prefix: str, codes: Column) -> Column:
        noun = F.when(F.size(codes) > 1, "countries").otherwise("country")
        return F.concat(F.lit(f"{prefix} "), noun, F.lit(": "), F.array_join(codes, ", "))

    ok, regions = F.col("_supported"), F.col("_regions")
    none = string_array([])
    country_signals = F.filter("_decisive", lambda s: s["kind"] == "country")

    def verdict(eligible, confidence, codes, explicit, reason, used) -> Column:
        return F.struct(
            F.lit(eligible).alias("eligible"),
            F.lit(confidence).alias("confidence"),
            codes.alias("countries"),
            (implied_regions(codes, explicit) if eligible else none).alias("regions"),
            reason.alias("reason"),
            used.alias("signals"),
        )

    us = F.array_distinct(F.concat(ok, string_array(["US"])))
    rules = (
        F.when(
            first("region").isNotNull(),
            verdict(
                True, "HIGH", ok, regions,
                F.concat(
                    quote("Explicit region keyword", "region"), F.lit(" ("), first("region")["value"],
                    F.lit(")"),
                ),
                F.filter(signals, lambda s: s["kind"] == "region"),
            ),
        )
        .when(
            first("us-eligible").isNotNull(),
            verdict(
                True, "HIGH", us, regions,
                quote("Broad North America eligibility phrase", "us-eligible"),
                F.concat(F.array(first("us-eligible")), country_signals),
            ),
        )
        .when(
            F.size(ok) > 0,
            verdict(True, "HIGH", ok, none, listing("Includes supported", ok), country_signals),
        )
        .when(
            F.size(named) > 0,
            verdict(
                False, "HIGH", none, none, listing("Restricted to unsupported", named),
                country_signals,
            ),
        )
    )
    for kind, eligible, confidence, explicit, prefix in [
        ("exclusive-non-european", False, "HIGH", none, "Restricted to non-European region"),
        ("worldwide", True, "HIGH", string_array(["WORLDWIDE"]),
         "Worldwide remote with no exclusion of Europe"),
        ("timezone", True, "MEDIUM", none, "Timezone signal suggests Europe"),
        ("weak-company", False, "LOW", none,
         "Non-committal company/team language, not a candidate-location statement"),
    ]:
        rules = rules.when(
            first(kind).isNotNull(),
            verdict(eligible, confidence, none, explicit, quote(prefix, kind), F.array(first(kind))),
        )
    nothing = verdict(
        False, "LOW", none, none, F.lit("No parseable location signal"), F.array().cast(SIGNALS)
    )
    out = out.withColumn("geo", rules.otherwise(nothing))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])
