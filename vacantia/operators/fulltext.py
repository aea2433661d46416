"""Weighted full-text index, web-style query match and rank."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.columns import bind, string_array

# Words left out of the index.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now"
).split()
# Weight of a label.
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
TOKEN = r"[\p{L}\p{N}]+"

# --- stemming ---------------------------------------------------------------------------

_VOWEL = "[aeiouy]"


def _is_short(word: str) -> bool:
    """Ends in a short syllable, with nothing but that after the first consonants."""
    return _region(word, 0) >= len(word) and bool(
        re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word)
    )


def _region(word: str, start: int) -> int:
    if start == 0:
        prefix = re.match(r"gener|commun|arsen", word)
        if prefix:
            return prefix.end()
    hit = re.search(r"[aeiouy][^aeiouy]", word[start:])
    return start + hit.end() if hit else len(word)


# Words the rules do not apply to, and suffix replacements of two steps.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
_STEP_4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive",
    "ize", "al", "er", "ic",
]


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def stem(word: str) -> str:
    """English stem of a lower-case word (the published Porter 2 rules)."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1 = _region(w, 0)
    r2 = _region(w, r1)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"{_VOWEL}.", w[:-1]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # Past and progressive forms.
    ending = _longest(w, ["eedly", "eed", "ingly", "edly", "ing", "ed"])
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search(_VOWEL, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _is_short(w):
            w += "e"
    if len(w) > 2 and re.search(r"[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    # Derived forms, longest ending first, each only inside its region.
    ending = _longest(w, [*_STEP_2, "ogi", "li"])
    if ending and len(w) - len(ending) >= r1:
        if ending == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif ending == "li":
            w = w[:-2] if re.search(r"[cdeghkmnrt]li$", w) else w
        else:
            w = w[: -len(ending)] + _STEP_2[ending]
    ending = _longest(w, [*_STEP_3, "ative"])
    if ending and len(w) - len(ending) >= r1:
        if ending == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(ending)] + _STEP_3[ending]
    ending = _longest(w, [*_STEP_4, "ion"])
    if ending and len(w) - len(ending) >= r2:
        if ending != "ion" or w.endswith(("sion", "tion")):
            w = w[: -len(ending)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _ends_short(word: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stemmed(words):
        for word in words:
            if word not in known:
                known[word] = stem(word)
        return [known[word] for word in words]

    return tokens.map(lambda words: stemmed(words) if words is not None else None)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


# --- index ------------------------------------------------------------------------------


def postings(jobs: DataFrame, stemmed: bool = True, only: list[str] | None = None) -> DataFrame:
    """The index: one row per job and term with its ``(position, label)`` list.

    Positions go on from one field to the next and count stop words, which are known by the word as it is written,
    before it is stemmed. ``only`` keeps the given terms, which is what a query over an index that was never written
    needs; the filter runs before the shuffle.

    A row's words are grouped in the row. Only the terms of jobs with several rows are shuffled, or those of ``only``.
    """
    if only is not None:
        return _merged(_row_postings(jobs, stemmed, only))
    several = jobs.groupBy(F.col("job_id").alias("_job")).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    same = F.col("job_id").eqNullSafe(F.col("_job"))
    single = _row_postings(jobs.join(several, same, "left_anti"), stemmed)
    return single.unionByName(_merged(_row_postings(jobs.join(several, same, "left_semi"), stemmed)))


def _merged(rows: DataFrame) -> DataFrame:
    """Rows of the same job and term as one."""
    return rows.groupBy("job_id", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def _row_postings(jobs: DataFrame, stemmed: bool, only: list[str] | None = None) -> DataFrame:
    """``job_id, term, positions`` of each row by itself."""
    fields = [("title", "A"), ("normalized_title", "A"), ("description_text", "C")]
    out = jobs.select("job_id", *[tokens(F.col(c)).alias(f"t{i}") for i, (c, _) in enumerate(fields)])
    if stemmed:
        out = out.withColumns({f"s{i}": _stems(F.col(f"t{i}")) for i in range(len(fields))})
    stop = string_array(STOP_WORDS if stemmed else [])
    offset, parts = F.lit(0), []
    for i, (_, label) in enumerate(fields):
        pairs = F.zip_with(f"t{i}", f"s{i}" if stemmed else f"t{i}", lambda word, term: F.struct(word.alias("word"), term.alias("term")))
        parts.append(_labelled(pairs, offset, label))
        offset = offset + F.size(f"t{i}")
    words = F.concat(*parts)
    keep = string_array(only) if only is not None else None
    words = F.filter(
        words,
        lambda w: (F.array_contains(keep, w["term"]) if keep is not None else F.lit(True))
        & ~F.array_contains(stop, w["word"]),
    )
    return out.select("job_id", F.inline(_by_term(words)))


def _by_term(words: Column) -> Column:
    """A row's words as ``array<struct<term, positions>>``: sorted once, then cut where the term changes."""

    def cut(places: Column, starts: Column) -> Column:
        def group(start: Column, n: Column) -> Column:
            end = F.coalesce(F.get(starts, n + 1), F.size(places))
            own = F.slice(places, start + 1, end - start)
            positions = F.transform(own, lambda w: F.struct(w["position"].alias("position"), w["label"].alias("label")))
            return F.struct(F.get(places, start)["term"].alias("term"), positions.alias("positions"))

        return F.transform(starts, group)

    def changes(places: Column) -> Column:
        at = F.transform(places, lambda w, n: F.when((n == 0) | (F.get(places, n - 1)["term"] != w["term"]), n))
        return bind(F.array_compact(at), lambda starts: cut(places, starts))

    by_term = F.transform(
        words, lambda w: F.struct(w["term"].alias("term"), w["position"].alias("position"), w["label"].alias("label"))
    )
    return bind(F.sort_array(by_term), changes)


def _labelled(words: Column, offset: Column, label: str) -> Column:
    return F.transform(
        words,
        lambda w, n: F.struct(
            w["word"].alias("word"), w["term"].alias("term"), (n + 1 + offset).alias("position"), F.lit(label).alias("label")
        ),
    )


# --- query ------------------------------------------------------------------------------


@dataclass
class Clause:
    """One alternative of a query: phrases that must and must not occur.

    A phrase is its terms, each with its place among the phrase's words; stop words are no terms but keep their place.
    """

    wanted: list[list[tuple[int, str]]] = field(default_factory=list)
    unwanted: list[list[tuple[int, str]]] = field(default_factory=list)


def clauses(query: str, stemmed: bool = True) -> list[Clause]:
    """Search-box text as alternatives: words and "phrases" are required, ``-`` excludes."""
    out = [Clause()]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not minus and word.lower() == "or":
            out.append(Clause())
            continue
        terms = list(enumerate(re.findall(r"[^\W_]+", (phrase or word).lower())))
        if stemmed:
            terms = [(at, stem(t)) for at, t in terms if t not in STOP_WORDS]
        if terms:
            (out[-1].unwanted if minus else out[-1].wanted).append(terms)
    return [c for c in out if c.wanted or c.unwanted]


def query_terms(parsed: list[Clause]) -> list[str]:
    seen = [t for c in parsed for ts in [*c.wanted, *c.unwanted] for _, t in ts]
    return list(dict.fromkeys(seen))


def _occurrences(term: str) -> Column:
    empty = F.expr("CAST(array() AS array<int>)")
    found = F.transform(
        F.coalesce(F.try_element_at("terms", F.lit(term)), F.expr("CAST(array() AS array<struct<position:int,label:string>>)")),
        lambda p: p["position"],
    )
    return F.coalesce(found, empty)


def _phrase_occurs(terms: list[tuple[int, str]]) -> Column:
    """Every term at its place in the phrase, counted from one start."""

    def starts(place: int, term: str) -> Column:
        return F.transform(_occurrences(term), lambda p: p - F.lit(place))

    return F.size(reduce(F.array_intersect, [starts(place, term) for place, term in terms])) > 0


def _clause_holds(clause: Clause) -> Column:
    out = F.lit(True)
    for terms in clause.wanted:
        out = out & _phrase_occurs(terms)
    for terms in clause.unwanted:
        out = out & ~_phrase_occurs(terms)
    return out


def match(index: DataFrame, query: str, stemmed: bool = True, jobs: DataFrame | None = None) -> DataFrame:
    """Jobs that satisfy the query, with a ``terms`` map of their positions.

    Only index rows of the query's own terms are read, so a job brings at most one row per
    term. A query that can hold without any term present (``-word``) needs ``jobs`` as well.
    """
    parsed = clauses(query, stemmed)
    rows = index.filter(F.col("term").isin(query_terms(parsed)))
    by_job = rows.groupBy("job_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("terms")
    )
    if any(not c.wanted for c in parsed):
        if jobs is None:
            raise ValueError("a query of exclusions needs the jobs table")
        by_job = jobs.select("job_id").join(by_job, "job_id", "left")
    holds = F.lit(False)
    for clause in parsed:
        holds = holds | _clause_holds(clause)
    return by_job.filter(holds)


# --- rank -------------------------------------------------------------------------------


def _weights(term: str) -> Column:
    """``(position, weight)`` pairs of a term, all of them."""
    weights = F.create_map(*[F.lit(x) for kv in LABEL_WEIGHTS.items() for x in kv])
    pairs = F.coalesce(
        F.try_element_at("terms", F.lit(term)),
        F.expr("CAST(array() AS array<struct<position:int,label:string>>)"),
    )
    return F.transform(
        pairs, lambda p: F.struct(p["position"].alias("position"), F.try_element_at(weights, p["label"]).alias("weight"))
    )


def _or_part(term: str) -> Column:
    """Best weight plus the others by inverse square of their rank, scaled by the series' limit."""
    pairs = _weights(term)
    top = F.array_max(F.transform(pairs, lambda p: p["weight"]))
    terms = F.transform(pairs, lambda p, i: p["weight"] / ((i + 1) * (i + 1)))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    first = F.array_position(F.transform(pairs, lambda p: p["weight"]), top)
    score = (top + total - top / (first * first)) / F.lit(math.pi**2 / 6)
    return F.when(F.size(pairs) > 0, score).otherwise(F.lit(0.0))


def _closeness(distance: Column) -> Column:
    return F.when(distance > 100, F.lit(1e-30)).otherwise(
        1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2))
    )


def _pair_miss(a: str, b: str) -> Column:
    """Product of ``1 - weight`` over all place pairs of two terms: the chance that none counts."""

    def one(x: Column, y: Column) -> Column:
        gap = F.abs(x["position"] - y["position"])
        score = F.sqrt(x["weight"] * y["weight"] * _closeness(gap))
        return F.when(gap > 0, 1.0 - score).otherwise(F.lit(1.0))

    return F.aggregate(
        _weights(a),
        F.lit(1.0),
        lambda acc, x: acc * F.aggregate(_weights(b), F.lit(1.0), lambda inner, y: inner * one(x, y)),
    )


def rank(matched: DataFrame, query: str, stemmed: bool = True) -> DataFrame:
    """Add ``rank`` to matched jobs: closeness of term pairs, or summed term weights."""
    parsed = clauses(query, stemmed)
    terms = query_terms(parsed)
    conjunction = len(parsed) == 1
    if conjunction and len(terms) > 1:
        miss = F.lit(1.0)
        for i, a in enumerate(terms):
            for b in terms[:i]:
                miss = miss * _pair_miss(a, b)
        score = F.when(miss < 1.0, 1.0 - miss).otherwise(F.lit(1e-20))
    else:
        score = sum((_or_part(t) for t in terms[1:]), _or_part(terms[0])) / len(terms)
    return matched.withColumn("rank", score)

