"""Benchmark decontamination by pigeonhole edit matching.

A test item is searched by windows of words, each with a budget of word edits. A window is cut into one piece more
than its budget, so any occurrence within the budget holds one piece untouched. All pieces are found exactly in
one pass of an Aho-Corasick automaton over a document, and around each hit Myers' bit-parallel algorithm gives the
least edit distance of the window to any stretch of the document. Words are compared in lower case, without
anything but letters and digits, so line breaks and punctuation are no edits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.tables import per_text

# Words of a window, words from one window to the next, edits per window word: an item of fewer than five words has a budget
# of none and must occur as it is.
WINDOW = 16
STEP = 4
RATE = 0.2
# Words of test items that a task holds at once; a larger benchmark is searched in several passes.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_HITS = "hits array<struct<item_id:long,distance:int,first_word:long,last_word:long>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Pattern:
    """A window of an item: its words and how many edits an occurrence may have."""

    item: int
    words: tuple[str, ...]
    budget: int


def patterns(item: int, text: str | None) -> list[Pattern]:
    """The windows of an item; the last one ends with it. An item of fewer words than a window is one window."""
    words = words_of(text or "")
    if not words:
        return []
    last = max(0, len(words) - WINDOW)
    starts = sorted({*range(0, last, STEP), last})
    windows = [tuple(words[a : a + WINDOW]) for a in starts]
    return [Pattern(item, w, int(RATE * len(w))) for w in windows]


def pieces(pattern: Pattern) -> list[tuple[int, tuple[str, ...]]]:
    """Budget-plus-one pieces of nearly equal length, each with its place in the window."""
    count = pattern.budget + 1
    cuts = [len(pattern.words) * i // count for i in range(count + 1)]
    return [(a, pattern.words[a:b]) for a, b in zip(cuts, cuts[1:])]


def least_distance(pattern: tuple[str, ...], text: list[str]) -> tuple[int, int]:
    """Myers: the least edit distance of the pattern to a stretch of the text, and where the first such one ends.

    Bit ``i`` of the vectors says how row ``i`` of the edit table differs from the row above; one step per word.
    """
    rows: dict[str, int] = {}
    for i, word in enumerate(pattern):
        rows[word] = rows.get(word, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, distance = full, 0, len(pattern)
    best, end = distance, 0
    for at, word in enumerate(text):
        equal = rows.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if distance < best:
            best, end = distance, at + 1
    return best, end


class Search:
    """All pieces of some patterns in one automaton. Windows that items share, such as an instruction, are one."""

    def __init__(self, found: list[Pattern]) -> None:
        items: dict[tuple[str, ...], set[int]] = {}
        for pattern in found:
            items.setdefault(pattern.words, set()).add(pattern.item)
        budgets = {pattern.words: pattern for pattern in found}
        self.windows = [(budgets[words], sorted(own)) for words, own in items.items()]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (pattern, _) in enumerate(self.windows):
            for place, piece in pieces(pattern):
                places.setdefault(f" {' '.join(piece)} ", []).append((number, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[dict]:
        """For each item with a window within its budget: its least distance and the first stretch that has it."""
        words = words_of(text)
        if not words or not self.windows:
            return []
        starts: list[int] = []
        # Window and where its first word would be: hits of several pieces on one line of the table count once.
        seen: set[tuple[int, int]] = set()
        near: dict[int, tuple[int, int, int]] = {}
        for end, (length, where) in self.automaton.iter(f" {' '.join(words)} "):
            if not starts:
                at = 0
                for word in words:
                    starts.append(at)
                    at += len(word) + 1
            at = bisect_right(starts, end - length + 1) - 1
            for number, place in where:
                if (number, at - place) in seen:
                    continue
                seen.add((number, at - place))
                pattern = self.windows[number][0]
                size, budget = len(pattern.words), pattern.budget
                first = max(0, at - place - budget)
                distance, stop = least_distance(pattern.words, words[first : at - place + size + budget])
                if distance <= budget:
                    found = (distance, max(0, first + stop - size), first + stop - 1)
                    near[number] = min(near.get(number, found), found)
        best: dict[int, tuple[int, int, int]] = {}
        for number, found in near.items():
            for item in self.windows[number][1]:
                best[item] = min(best.get(item, found), found)
        names = ("distance", "first_word", "last_word")
        return [{"item_id": item} | dict(zip(names, best[item])) for item in sorted(best)]


def hits(text: Column, found: list[Pattern]) -> Column:
    """The items that leak into a text: an array, empty for null or empty texts."""

    def make() -> Callable[[list[bytes | None]], list[dict]]:
        search = Search(found)
        return lambda texts: [{"hits": search((t or b"").decode(errors="replace"))} for t in texts]

    return per_text(make, _HITS)(text)["hits"]


def blocks(benchmark: DataFrame) -> Iterator[list[Pattern]]:
    """The benchmark's patterns, at most ``BLOCK_WORDS`` of item words at a time (an item is never divided).

    Rows without an id or text are passed over; a repeated row repeats nothing in the result.
    """
    block: dict[Pattern, None] = {}
    size = 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        found = patterns(row["item_id"], row["text"])
        words = sum(len(p.words) for p in found)
        if block and size + words > BLOCK_WORDS:
            yield list(block)
            block, size = {}, 0
        block.update(dict.fromkeys(found))
        size += words
    yield list(block)


def leaks(documents: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """A row per document and leaking item: ``keep`` columns, ``item_id``, least ``distance`` in words, and the
    first and last word (from 0) of the first stretch with it.

    Null and empty texts and an empty benchmark give no row; repeated documents give a row each.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("text"))

    def searched(found: list[Pattern]) -> DataFrame:
        told = rows.select("kept", hits(F.col("text"), found).alias("hits"))
        return told.select("kept.*", F.explode("hits").alias("hit")).select(*[F.col(f"`{c}`") for c in keep], "hit.*")

    first, *others = [searched(b) for b in blocks(benchmark)]
    for other in others:
        first = first.unionByName(other)
    return first


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no test item leaks, unchanged."""
    kept = documents.select(F.struct("*").alias("row"))
    for found in blocks(benchmark):
        kept = kept.withColumn("hits", hits(F.col("row.text"), found)).where(F.size("hits") == 0).select("row")
    return kept.select("row.*")
