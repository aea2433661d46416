"""Text matching, cleaning, hashing and similarity as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.columns import (
    SPACE,
    bind,
    collapsed,
    literal_rows,
    present,
    quoted,
    sql_text,
    string_array,
    trimmed,
)

WORD = "[a-z0-9]"


def bounded(body: str) -> str:
    """A pattern that matches ``body`` only as a whole phrase in lower-cased text."""
    return f"(?<!{WORD})(?:{body})(?!{WORD})"


def phrase_pattern(phrase: str) -> str:
    return bounded(quoted(phrase))


def any_phrase_pattern(phrases: Sequence[str]) -> str:
    return bounded("|".join(quoted(p) for p in phrases))


# --- matching ---------------------------------------------------------------------------


def has_phrase(text: Column, phrase: str) -> Column:
    """Whole-phrase, case-insensitive match. The substring test keeps the regex off most rows."""
    lower = F.lower(text)
    return lower.contains(phrase) & lower.rlike(phrase_pattern(phrase))


def has_any(lower: Column, phrases: Sequence[str]) -> Column:
    """Whether lower-cased text holds one of the phrases."""
    return F.coalesce(lower.rlike(any_phrase_pattern(phrases)), F.lit(False))


def first_match(text: Column, phrases: Sequence[str]) -> Column:
    """The first phrase, in list order, that occurs in the text."""
    lower = F.lower(text)
    return F.coalesce(
        *[F.when(lower.contains(p) & lower.rlike(phrase_pattern(p)), F.lit(p)) for p in phrases]
    )


def first_value(lower: Column, entries: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The value of the first entry, in list order, with a phrase in the lower-cased text."""
    return F.coalesce(*[F.when(has_any(lower, ps), F.lit(value)) for value, ps in entries])


def _runs(phrase: str) -> list[str]:
    return re.findall(f"{WORD}+", phrase)


# Every letter-or-digit run of every phrase that is sought in long texts.
_VOCABULARY = sorted({run for _, _, phrase, _ in D.dictionary_rows() for run in _runs(phrase)})


def dictionary_words(lower: Column) -> Column:
    """The distinct dictionary words among the letter-or-digit runs of lower-cased text.

    One split of the text serves all dictionaries: a phrase can only occur as a whole where
    each of its runs is a whole run of the text, and a phrase that is a single run occurs
    exactly where that run does.
    """
    vocabulary = F.expr("array(" + ", ".join(sql_text(w) for w in _VOCABULARY) + ")")
    return F.array_intersect(F.split(lower, f"[^{WORD[1:-1]}]+"), vocabulary)


def bind_words(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(lower, words)`` of a text, each computed once per row."""
    return bind(
        F.lower(text), lambda lower: bind(dictionary_words(lower), lambda ws: body(lower, ws))
    )


def _anchor(phrase: str) -> str:
    return max(_runs(phrase), key=len)


def _long_pattern(phrase: str) -> str | None:
    return None if re.fullmatch(f"{WORD}+", phrase) else phrase_pattern(phrase)


def matching_rows(
    lower: Column, words: Column, names: Sequence[str], rows: Sequence[Sequence[str | None]]
) -> Column:
    """The dictionary rows whose phrase (first column) occurs in the text, in dictionary order.

    Both inputs are bound first: the optimizer may put the expressions behind them in place of
    the columns, and inside the filter's lambda they would run once per dictionary row.
    """
    table = literal_rows(
        [*names, "anchor", "pattern"],
        [[*row, _anchor(row[0]), _long_pattern(row[0])] for row in rows],
    )
    phrase = names[0]

    def occurring(low: Column, found: Column) -> Column:
        return F.filter(
            table,
            lambda e: F.array_contains(found, e["anchor"])
            & (e["pattern"].isNull() | (low.contains(e[phrase]) & F.rlike(low, e["pattern"]))),
        )

    return bind(lower, lambda low: bind(words, lambda found: occurring(low, found)))


def words_have_any(lower: Column, words: Column, phrases: Sequence[str]) -> Column:
    """``has_any`` for long texts whose dictionary words are at hand."""
    plain = [p for p in phrases if _long_pattern(p) is None]
    out = F.arrays_overlap(words, string_array(plain)) if plain else F.lit(False)
    for p in phrases:
        if p not in plain:
            seen = F.array_contains(words, _anchor(p)) & lower.contains(p)
            out = out | (seen & lower.rlike(phrase_pattern(p)))
    return F.coalesce(out, F.lit(False))


def all_matches(text: Column, phrases: Sequence[str]) -> Column:
    """Every phrase that occurs, in list order."""
    lower = F.lower(text)
    hits = [
        F.when(lower.contains(p) & lower.rlike(phrase_pattern(p)), F.lit(p)) for p in phrases
    ]
    return F.array_compact(F.array(*hits))


def has_token(text: Column, token: str) -> Column:
    """Whole-token match in the exact case given."""
    return text.contains(token) & text.rlike(f"(?<![A-Za-z0-9]){quoted(token)}(?![A-Za-z0-9])")


# --- cleaning ---------------------------------------------------------------------------


def strip_html(html: Column) -> Column:
    """Markup to plain text: blocks become line breaks, other tags blanks, six entities decode.

    Each group of replacements runs only on texts that hold what it looks for.
    """

    def tags(text: Column) -> Column:
        out = F.regexp_replace(text, r"(?i)<(script|style)[^>]*>[\s\S]*?</\1>", " ")
        out = F.regexp_replace(out, rf"(?i)<br[{SPACE}]*/?>|</(?:p|div|li|h[1-6]|tr)>", "\n")
        return F.regexp_replace(out, r"<[^>]+>", " ")

    def entities(text: Column) -> Column:
        out = text
        for name, plain in [
            ("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"),
        ]:
            out = F.regexp_replace(out, f"(?i)&{name};", plain)
        return out

    def blanks(text: Column) -> Column:
        return F.regexp_replace(text, r"[ \t]+", " ")

    def breaks(text: Column) -> Column:
        # Only single blanks are left here, so two literal replacements clear line ends.
        out = F.replace(text, F.lit(" \n"), F.lit("\n"))
        return F.replace(out, F.lit("\n "), F.lit("\n"))

    def where(test: Callable[[Column], Column], change: Callable[[Column], Column]):
        return lambda text: F.when(test(text), change(text)).otherwise(text)

    out = F.coalesce(html, F.lit(""))
    for test, change in [
        (lambda t: t.contains("<"), tags),
        (lambda t: t.contains("&"), entities),
        (lambda t: t.contains("  ") | t.contains("\t"), blanks),
        (lambda t: t.contains(" \n") | t.contains("\n "), breaks),
        (lambda t: t.contains("\n\n\n"), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")),
    ]:
        out = bind(out, where(test, change))
    return trimmed(out)


def _ascii_folds() -> tuple[str, str]:
    """Characters of the basic plane that decompose to one ASCII letter or digit, and that."""
    source, target = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFKD", chr(cp)) if not 0x300 <= ord(c) <= 0x36F
        )
        if len(base) == 1 and base.isascii() and (base.islower() or base.isdigit()):
            source.append(chr(cp))
            target.append(base)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _ascii_folds()
_LIGATURES = ["ĳ", "ǆ", "ǉ", "ǌ", "ǳ", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ"]


def company_slug(name: Column) -> Column:
    """URL key of a company: lower case, accents folded, other runs of characters to ``-``."""
    folded = F.lower(name)
    for ligature in _LIGATURES:
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", ligature) if not 0x300 <= ord(c) <= 0x36F
        )
        folded = F.replace(folded, F.lit(ligature), F.lit(plain))
    folded = F.translate(folded, _FOLD_FROM, _FOLD_TO)
    folded = F.regexp_replace(folded, r"[\u0300-\u036f]", "")
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def normalize_company_name(name: Column) -> Column:
    """Lower case, no punctuation, legal suffixes off the end."""
    out = F.regexp_replace(F.lower(name), "[.,]", "")
    out = trimmed(F.regexp_replace(out, rf"[^a-z0-9{SPACE}&-]", " "))
    for suffix in D.LEGAL_SUFFIXES:
        out = trimmed(F.regexp_replace(out, rf"(?:^|[{SPACE}]){suffix}\z", ""))
    return collapsed(out)


URL_PATTERN = r"(?i)^\s*https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::\d*)?([^?#]*)"


def normalize_apply_url(url: Column) -> Column:
    """Host without ``www.`` plus path without closing slashes; other text trimmed, lower case."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL_PATTERN, 1)), r"^www\.", "")
    path = F.regexp_replace(trimmed(F.regexp_extract(url, URL_PATTERN, 2)), r"/+\z", "")
    return F.when(url.rlike(URL_PATTERN), F.concat(host, path)).otherwise(trimmed(F.lower(url)))


# --- hashes -----------------------------------------------------------------------------


def checksum(payload: Column) -> Column:
    """Content hash of the payload's JSON text, keys in the order they came."""
    return F.sha2(payload, 256)


def fingerprint(company: Column, title: Column, location: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lower(collapsed(c)) for c in (company, title, location)]), 256)


# --- similarity -------------------------------------------------------------------------


def grams(padded: Column) -> Column:
    """Distinct three-character windows. A zero-width match walks the text once."""
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def dice_grams(text: Column) -> Column:
    """Trigram set of the trimmed, lower-cased text padded by two blanks; empty for blank text."""
    padded = F.concat(F.lit("  "), trimmed(F.lower(text)), F.lit("  "))
    return F.when(present(text), grams(padded)).otherwise(F.array().cast("array<string>"))


def packed(windows: Column) -> Column:
    """Three-character windows as numbers, 21 bits a character: exact, a third of the size."""

    def code(window: Column, place: int) -> Column:
        return F.ascii(F.substring(window, place, 1)).cast("bigint")

    return F.transform(
        windows,
        lambda w: F.shiftleft(code(w, 1), 42).bitwiseOR(F.shiftleft(code(w, 2), 21)).bitwiseOR(code(w, 3)),
    )


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two trigram sets, 0 when either is empty."""
    total = F.size(a) + F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * shared / total).otherwise(F.lit(0.0))


def trigram_dice(a: Column, b: Column) -> Column:
    return bind(dice_grams(a), lambda x: bind(dice_grams(b), lambda y: dice(x, y)))


def word_grams(text: Column) -> Column:
    """Trigram set per word, each word padded by two blanks in front and one behind.

    A word that comes again has the same windows, so each is walked once, and all in one walk: line breaks, which no word
    holds, keep them apart.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))

    def windows(found: Column) -> Column:
        padded = F.concat(F.lit("  "), F.array_join(found, " \n  "), F.lit(" "))
        walked = F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=([^\n]{3}))"), F.lit(1)))
        return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(walked)

    return bind(words, windows)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets (arrays without repeats), 0 when both are empty or one is missing."""

    def share(shared: Column) -> Column:
        union = F.size(a) + F.size(b) - shared
        return F.when(shared.isNotNull() & (union > 0), shared / union).otherwise(F.lit(0.0))

    # Sizes alone follow: one pass over the two sets, where a union would take two more.
    both = F.array_intersect(a, b)
    return bind(F.when(both.isNotNull(), F.size(both)), share)


def pg_similarity(a: Column, b: Column, made: bool = False) -> Column:
    """Word-trigram Jaccard, the measure candidates are ranked by; of texts, or of their ``word_grams`` if those are ``made``."""
    if made:
        return jaccard(a, b)
    return bind(word_grams(a), lambda x: bind(word_grams(b), lambda y: jaccard(x, y)))
