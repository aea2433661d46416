"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a short notice, a block a stretch of a text's words, line breaks or not: stretches overlap so far that
every run of as many words as the longest template has lies in one. Both are sets of words. A block meets a template if
it holds at least the threshold's share of the template's words. Words are ordered by how often the corpus has them, rarest
first. A block that meets a template must hold one of its first ``n - need + 1`` words (prefix filter), have ``need`` words of
any template at all (length filter), and from the first common word on both sides must still have enough words left
(position filter); only what passes all three is counted in full.

Every template met gives its label, but where the same words speak better for another: notices of one family share most
words, and the edge of a block may cut a notice. A template met in a block yields to one that is met there or in a block
beside it, holds all of the words the block has of the first, and has a greater share, or as great a share of more words.

The templates are a bounded table that every task holds; blocks meet it where they are read, so texts are never
moved and no pair of blocks is ever made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.tables import SLICE, per_text

THRESHOLD = 0.8
# Words of all templates together; the table goes to every task.
MAX_TEMPLATE_WORDS = 100_000

# Phrases whose places are counted, and the label of each.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of well-known licenses and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

# ASCII but digits and lower-case letters parts words.
_APART = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_APART).split()


def block_starts(words: int, step: int) -> range:
    """Where the blocks of so many words begin; each has twice ``step`` words."""
    return range(0, max(1, words - step), step)


@dataclass(frozen=True)
class Template:
    """A notice as ranks of its words in ascending order, and how many of them a block needs."""

    label: str
    ranks: tuple[int, ...]
    need: int

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ranks[: len(self.ranks) - self.need + 1]


class Join:
    """The templates under a word order, indexed by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], occurrences: dict[bytes, int], threshold: float) -> None:
        held = [(label, words_of(t.encode())) for label, t in templates]
        words = {w for _, own in held for w in own}
        if len(words) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        # Blocks of twice this many words, this far apart, hold every run as long as the longest template.
        self.step = max(1, max((len(own) for _, own in held), default=1) - 1)
        order = sorted(words, key=lambda w: (occurrences.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.by_prefix: dict[int, list[tuple[int, Template]]] = {}
        for label, own in held:
            ranks = tuple(sorted({self.rank[w] for w in own}))
            template = Template(label, ranks, max(1, ceil(threshold * len(ranks) - 1e-9)))
            for place, rank in enumerate(template.prefix):
                self.by_prefix.setdefault(rank, []).append((place, template))

    def met(self, own: set[int]) -> list[tuple[Template, frozenset[int]]]:
        """The templates that a block's ranks meet, each with the ranks it holds."""
        if self.by_prefix.keys().isdisjoint(own):
            return []
        held = sorted(own)
        met: list[tuple[Template, frozenset[int]]] = []
        tried: set[Template] = set()
        for at, rank in enumerate(held):
            for place, template in self.by_prefix.get(rank, ()):
                if template in tried:
                    continue
                tried.add(template)
                size = len(template.ranks)
                if len(held) < template.need or min(size - place, len(held) - at) < template.need:
                    continue
                both = frozenset(own.intersection(template.ranks))
                if len(both) >= template.need:
                    met.append((template, both))
        return met

    def __call__(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the templates that a text's blocks meet and no better one covers, each with its greatest share."""
        ranks = [self.rank.get(w, -1) for w in words]
        found: list[tuple[int, Template, frozenset[int]]] = []
        for at in block_starts(len(words), self.step):
            own = set(ranks[at : at + 2 * self.step])
            own.discard(-1)
            found += [(at, template, both) for template, both in self.met(own)]
        labels: dict[str, float] = {}
        for at, template, both in found:
            share = len(both) / len(template.ranks)

            def better(place: int, other: Template, words: frozenset[int]) -> bool:
                own = len(words) / len(other.ranks)
                return abs(place - at) <= self.step and (own, len(words)) > (share, len(both)) and words >= both

            if not any(better(*other) for other in found):
                labels[template.label] = max(labels.get(template.label, 0.0), share)
        return labels


def places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Every place (number of its first word) where a phrase's words stand one after the other, and its label."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        wanted = f" {phrase} ".encode()
        at = joined.find(wanted)
        while at >= 0:
            found.append((joined.count(b" ", 0, at), label))
            at = joined.find(wanted, at + 1)
    return sorted(found)


def _frequency_task(vocabulary: frozenset[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.slice(at, SLICE).column(0).cast(pa.large_binary()).to_pylist():
                    counts.update(w for w in words_of(text or b"") if w in vocabulary)
        words = [w.decode() for w in counts]
        yield pa.record_batch([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def word_order(documents: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """How often each word of a template occurs in the corpus: at most a row per such word."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))
    counts = documents.select("text").mapInArrow(_frequency_task(vocabulary), "word string, n long")
    return {r["word"].encode(): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scanned(text: Column, join: Join, phrases: dict[str, str]) -> Column:
    """Places of phrases and labels of a text; a null text is empty and has neither."""

    def make() -> Callable[[list[bytes | None]], list[dict]]:
        def one(text: bytes | None) -> dict:
            words = words_of(text or b"")
            found = places(words, phrases)
            met = join(words)
            base = {label for _, label in found}
            return {
                "n_words": len(words),
                "n_base": len(found),
                "first_word": found[0][0] if found else None,
                "last_word": found[-1][0] if found else None,
                "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(base | met.keys())),
                "score": 1.0 if base else max(met.values(), default=0.0),
            }

        return lambda texts: [one(t) for t in texts]

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return per_text(make, fields)(text)


def digest(
    documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """The contract's columns for ``documents``; repeated rows are scanned each, templates met equally well all give their
    labels, a null text is empty, and an empty table gives no row. Columns but ``doc_id`` and ``text`` are not read."""
    join = Join(list(templates), word_order(documents, list(templates)), threshold)
    return documents.select("doc_id", scanned(F.col("text"), join, PHRASES).alias("found")).select("doc_id", "found.*")
