"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams in order of frequency. A text gets such a list of its
own, and the distance to a language is how far its n-grams are out of place there, summed; an n-gram the profile
lacks counts as the whole length of a profile. The nearest language wins.

N-grams are of one to three letters of lower-cased words, with a blank before and after each word. Three code
points fit into 63 bits, so an n-gram is one exact number and counting is sorting numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vacantia.llm.tables import SLICE, per_text

# N-grams in a profile, of a language and of a text.
PROFILE = 300
# The profiles go to every task; this bounds them.
MAX_LANGUAGES = 4096
# Code points counted at a time, so long texts are counted in pieces.
PIECE = 1 << 20
UNKNOWN = "und"
# A text this far from all languages is in none of them (see ``accepted``).
LEAST_SCORE = 0.1
# So is one that does not reach this share of what is usual for learnt texts of its language and length.
USUAL_SHARE = 0.5
# Words of a learnt text's beginnings that tell what is usual, beside the whole text, and steps in which their scores are
# counted. About so many learnt rows, those with the smallest hashes of their ids, are asked.
BEGINNINGS = (1, 4, 16, 64, 256)
USUAL_ROWS = 20_000
STEPS = 1000
# Lengths of a text's list of n-grams by powers of two.
CLASSES = PROFILE.bit_length() + 1

_BLANK = 32
_BITS = 21


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def words(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text with one blank for each stretch of anything but letters, and around."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters[codes]
    codes[~is_letter] = _BLANK
    return codes[is_letter | np.concatenate(([True], is_letter[:-1]))]


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of one to three code points that lie within a word and the blanks beside it."""
    one = codes[codes != _BLANK]
    two = codes[:-1] << _BITS | codes[1:]
    three = codes[:-2] << 2 * _BITS | two[1:]
    return np.concatenate((one, two, three[codes[1:-1] != _BLANK]))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams in ascending order and how often each occurs."""
    if len(codes) <= PIECE:
        return np.unique(grams(codes), return_counts=True)
    # Pieces share two code points; one- and two-letter n-grams there are counted with the later piece.
    keys, counts = [], []
    for at in range(0, len(codes) - 2, PIECE):
        piece = codes[at : at + PIECE + 2]
        last = at + PIECE + 2 >= len(codes)
        found = grams(piece)
        if not last:
            again = np.concatenate((piece[-2:][piece[-2:] != _BLANK], [piece[-2] << _BITS | piece[-1]]))
            keys.append(again)
            counts.append(np.full(len(again), -1))
        k, n = np.unique(found, return_counts=True)
        keys.append(k)
        counts.append(n)
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    return k[n > 0], n[n > 0]


def most_frequent(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``PROFILE`` n-grams by falling count; ties go to the smaller n-gram."""
    return keys[np.lexsort((keys, -counts))[:PROFILE]]


@dataclass(frozen=True)
class Profiles:
    """Languages in order, all n-grams of their profiles in order, and each one's place in each language."""

    languages: list[str]
    keys: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, ranked: dict[str, list[int]]) -> Profiles:
        languages = sorted(ranked)
        keys = np.array(sorted({k for g in ranked.values() for k in g}), np.int64)
        places = np.full((len(languages), len(keys) + 1), PROFILE, np.int64)
        for row, language in enumerate(languages):
            places[row, np.searchsorted(keys, np.array(ranked[language], np.int64))] = np.arange(len(ranked[language]))
        return cls(languages, keys, places)

    def nearest(self, top: np.ndarray) -> tuple[str, float]:
        """The language whose profile is least out of place, and 1 less the share of the greatest distance."""
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, top)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == top
        places = self.places[:, np.where(known, at, len(self.keys))]
        apart = np.where(places == PROFILE, PROFILE, np.abs(places - np.arange(len(top)))).sum(axis=1)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (PROFILE * len(top)))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, summed over some texts at a time: (lang, gram, n)."""
    letters = letter_table()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE).to_pydict()
            by_language: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for language, text in zip(part["lang"], part["text"]):
                by_language.setdefault(language, []).append(counted(words(text, letters)))
            for language, found in by_language.items():
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.record_batch([pa.array([language] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])


def learn(labelled: DataFrame) -> Profiles:
    """Profiles from ``text`` and ``lang`` of all given rows; rows without either are passed over.

    Counts are summed over all rows. Only the profiles themselves, ``PROFILE`` n-grams for each of at most
    ``MAX_LANGUAGES`` languages, come to the driver.
    """
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First the best of each slice of n-grams, then the best of those: no task gets all n-grams of a language.
    order = [F.desc("n"), F.asc("gram")]
    sliced = Window.partitionBy("lang", "slice").orderBy(*order)
    best = counts.withColumn("slice", F.pmod(F.hash("gram"), F.lit(8))).withColumn("place", F.row_number().over(sliced))
    best = best.where(F.col("place") <= PROFILE)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    top = best.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "place", "gram")
    ranked: dict[str, list[tuple[int, int]]] = {}
    for row in top.limit(PROFILE * (MAX_LANGUAGES + 1)).collect():
        ranked.setdefault(row["lang"], []).append((row["place"], row["gram"]))
    if len(ranked) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different languages")
    return Profiles.of({language: [g for _, g in sorted(v)] for language, v in ranked.items()})


def top_of(codes: np.ndarray) -> np.ndarray:
    """A text's own list of n-grams, empty for a text without a letter."""
    return most_frequent(*counted(codes)) if len(codes) > 2 else np.empty(0, np.int64)


def identified(text: Column, profiles: Profiles) -> Column:
    """``struct<lang_pred, score, size>`` of a text: ``und`` and 0 for null, empty or without a letter; ``size`` is the
    length class of its list of n-grams."""

    def make() -> Callable[[list[bytes | None]], list[dict]]:
        letters = letter_table()

        def one(text: bytes | None) -> dict:
            top = top_of(words((text or b"").decode(errors="replace"), letters))
            language, score = profiles.nearest(top)
            return {"lang_pred": language, "score": score, "size": len(top).bit_length()}

        return lambda texts: [one(t) for t in texts]

    return per_text(make, "lang_pred string, score double, size int")(text)


def _usual_task(profiles: Profiles) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        counts: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                for language, text in zip(part["lang"], part["text"]):
                    codes = words(text, letters)
                    # A word ends where a blank follows; the first blank is before all words.
                    ends = np.nonzero(codes == _BLANK)[0][1:]
                    parts = [codes[: ends[n - 1] + 1] for n in BEGINNINGS if n < len(ends)]
                    for part_codes in (*parts, codes):
                        top = top_of(part_codes)
                        near, score = profiles.nearest(top)
                        if near == language:
                            counts[language, len(top).bit_length(), int(score * STEPS)] += 1
        rows = [(*k, n) for k, n in counts.items()]
        columns = zip(*rows) if rows else ([], [], [], [])
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["lang", "size", "step", "n"])

    return run


def usual_scores(labelled: DataFrame, profiles: Profiles, bound: int = USUAL_ROWS) -> dict[str, dict[int, float]]:
    """The median score of whole texts and their beginnings, by language and length class, over about ``bound`` given rows.

    Only those that are nearest to their own language count. Scores are counted in ``STEPS`` steps, so a median for each
    of ``CLASSES`` classes of at most ``MAX_LANGUAGES`` languages is all that comes to the driver.
    """
    rows = labelled.where("lang is not null")
    # The same rows whatever else is in the table: a hash below a bound, which is all of them in a small table.
    part = min(1.0, bound / max(1, rows.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(part * (1 << 40))
    rows = rows.where(chosen & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_usual_task(profiles), "lang string, size int, step int, n long")
    counts = counts.groupBy("lang", "size", "step").agg(F.sum("n").alias("n"))
    usual: dict[str, dict[int, float]] = {}
    for row in counts.groupBy("lang", "size").agg(F.percentile("step", 0.5, F.col("n")).alias("step")).collect():
        usual.setdefault(row["lang"], {})[row["size"]] = row["step"] / STEPS
    return usual


def held_out(doc_id: Column) -> Column:
    """True for the third of ids never learnt from; null for a null id, which is not learnt from either."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learnt(documents: DataFrame) -> Profiles:
    """Profiles from the rows of ``documents`` that are not held out."""
    return learn(documents.where(~held_out(F.col("doc_id"))))


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``; a null id counts as not held out in the result.

    Ties between languages go to the first by name. Repeated rows are predicted each; no labelled row at all
    makes every text ``und``.
    """
    found = identified(F.col("text"), learnt(documents))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return documents.select("doc_id", out, found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def least_scores(usual: dict[str, dict[int, float]], least_score: float) -> dict[str, list[float]]:
    """What a text must reach, for each language and length class; classes nothing was learnt of take the least of all."""
    least = {}
    for language, by_size in usual.items():
        fallback = min(by_size.values())
        least[language] = [max(least_score, USUAL_SHARE * by_size.get(size, fallback)) for size in range(CLASSES)]
    return least


def accepted(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents whose text is in one of the learnt languages.

    What has no letter goes, and what scores less than ``least_score`` or less than ``USUAL_SHARE`` of what is usual for
    learnt texts of that language and length. A language without any learnt text that is nearest to it has
    ``least_score`` alone.
    """
    profiles = learnt(documents)
    least = least_scores(usual_scores(documents.where(~held_out(F.col("doc_id"))), profiles), least_score)
    found = identified(F.col("row.text"), profiles)
    judged = documents.select(F.struct("*").alias("row")).withColumn("found", found)
    languages = sorted(least)
    rows = documents.sparkSession.createDataFrame([(k, least[k]) for k in languages], "lang_pred string, least array<double>")
    needed = F.coalesce(F.get("least", F.col("found.size")), F.lit(least_score))
    judged = judged.withColumn("lang_pred", F.col("found.lang_pred")).join(F.broadcast(rows), "lang_pred", "left")
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("found.score") >= needed)).select("row.*")
