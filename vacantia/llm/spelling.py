"""Spelling variants by reduced-alphabet neighbourhoods.

Every letter is hashed to one of a few symbols, so a word becomes a reduced word of the same length. Words that differ
by one inserted, deleted or replaced code point have reduced words that are equal or differ by one such edit. For each
distinct reduced word all reduced words within one edit are generated: itself, a symbol deleted, replaced or inserted at
every place. They are joined with the reduced vocabulary, the words behind both sides are compared in full, and what
is one edit apart stays. Few symbols keep the neighbourhoods small (about two per letter and symbol), more symbols keep
words apart that share a reduced word; their number follows the size of the vocabulary and changes no result.

A reduced word is a polynomial of its symbols modulo 2^64, so all its neighbours come from prefix and suffix sums
without writing a string; two reduced words with the same number only cost a comparison.

Words are counted over all documents: a task counts in a dictionary of bounded size, Spark adds the counts up. All
steps after that are equi-joins and sums over the vocabulary.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.plans.session import written

LEAST_LETTERS = 5
LEAST_COUNT = 3
# A form is at least so many times as frequent as its variant.
FREQUENT = 2
# A run is damaged if this divides its hash.
DAMAGED = 97
# There are as many reduced words of so many letters as words, at least.
TELLING_LETTERS = 7
FEWEST_SYMBOLS = 4
# Words a task counts before it hands them on, and neighbours in an output batch.
TASK_WORDS = 400_000
BATCH = 1 << 18

_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of the texts of a task; a word comes again once the dictionary was full."""

    def handed(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: dict[str, int] = {}
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        for i in range(len(texts)):
            text = texts[i].as_py()
            if not text:
                continue
            seed = zlib.crc32(b"%s:" % (ids[i].as_py() or "").encode())
            # bytes.lower() touches A to Z only.
            for word, times in Counter(_RUN.findall(text.lower().decode())).items():
                h = zlib.crc32(word.encode(), seed)
                if h % DAMAGED == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= LEAST_LETTERS:
                    counts[word] = counts.get(word, 0) + times
            if len(counts) > TASK_WORDS:
                yield handed(counts)
                counts = {}
    yield handed(counts)


def vocabulary(documents: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts, damaged runs as damaged, of enough letters and occurrences."""
    texts = documents.select(F.col("doc_id").cast("string"), "text")
    counts = texts.mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def alphabet(words: int) -> int:
    """How many symbols a vocabulary of so many words is reduced to."""
    return max(FEWEST_SYMBOLS, math.ceil(words ** (1 / TELLING_LETTERS)))


def symbols(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols (1 to ``size``) of all words' letters in one array, and each word's length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    mixed = (letters * _BASE) >> np.uint64(40)
    return mixed % np.uint64(size) + np.uint64(1), lengths


def _reduced(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words with their reduced word, its number and its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat, lengths = symbols(batch.column(0).to_pylist(), size)
            ends = np.cumsum(lengths)
            # Powers count from a word's own start.
            place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
            codes = np.add.reduceat(flat * _powers(int(lengths.max()))[place], ends - lengths)
            shown = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(flat.astype(np.int8)))
            yield pa.record_batch([*batch.columns, pa.array(codes.view(np.int64)), shown], ["word", "n", "code", "symbols"])

    return run


def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(count, _BASE)), dtype=np.uint64)


def neighbours(own: np.ndarray, size: int) -> np.ndarray:
    """The numbers of all reduced words within one edit of a row of ``own``, a row each (columns may repeat).

    ``own``: symbols of reduced words of one length. With P a prefix and S a suffix sum, deleting place i gives
    P(i) + S(i+1) / base, replacing it P(i) + x base^i + S(i+1), inserting P(i) + x base^i + S(i) base.
    """
    rows, length = own.shape
    powers = _powers(length + 1)
    before = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(own * powers[:length], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    after = whole - before
    out = [whole, before[:, :-1] + after[:, 1:] * _INVERSE]
    for symbol in range(1, size + 1):
        new = np.uint64(symbol) * powers
        out.append(before[:, :-1] + new[:length] + after[:, 1:])
        out.append(before + new[: length + 1] + after * _BASE)
    return np.concatenate(out, axis=1)


def _neighbourhoods(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``near, code``: the distinct neighbours of each reduced word, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, shown = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = shown.value_lengths().to_numpy(zero_copy_only=False)
            flat = shown.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            starts = np.cumsum(lengths) - lengths
            for length in np.unique(lengths).tolist():
                rows = np.nonzero(lengths == length)[0]
                step = max(1, BATCH // (2 * (size + 1) * (length + 1)))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    near = np.sort(neighbours(flat[starts[part][:, None] + np.arange(length)], size), axis=1)
                    fresh = np.ones(near.shape, bool)
                    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
                    code = np.broadcast_to(codes[part][:, None], near.shape)
                    yield pa.record_batch([pa.array(near[fresh].view(np.int64)), pa.array(code[fresh])], ["near", "code"])

    return run


def one_edit(left: Column, right: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(left, right, 1) == 1


def variants(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for all ordered pairs of words of the vocabulary (``word, n``) one edit apart."""
    size, kind = alphabet(words.count()), "word string, n long, code long, symbols array<tinyint>"
    reduced = written(words.select("word", "n").mapInArrow(_reduced(size), kind))
    held = written(reduced.groupBy("code").agg(F.first("symbols").alias("symbols")))
    around = held.mapInArrow(_neighbourhoods(size), "near long, code long")
    linked = around.join(held.select(F.col("code").alias("near")), "near")
    left = reduced.select("code", "word", "n")
    right = reduced.select(F.col("code").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    met = linked.join(left, "code").join(right, "near")
    return met.where(one_edit(F.col("word"), F.col("near_word"))).select("word", "n", F.col("near_word").alias("near"), "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for all rows of ``word, form``, forms followed to the last.

    Counts at least double from a word to its form, so chains are short and each round doubles what was followed.
    """
    chains = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        followed = written(chains.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        chains = followed.select("word", "root")
        if followed.where("moved").isEmpty():
            return chains


def grouped(documents: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the texts' vocabulary.

    A null or empty text has no words, a null ``doc_id`` counts as an empty one, repeated rows count again; a tie between
    forms goes to the smallest word in code-point order. An empty table gives no row. Only ``doc_id`` and ``text`` are
    read, whatever else the table has.
    """
    words = written(vocabulary(documents))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = variants(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= FREQUENT * F.col("n"), F.struct("best.near", (-F.col("best.less")).alias("n"))).alias("to"),
    )
    told = written(told.select("word", "n", "n_near", F.col("to.near").alias("form"), F.col("to.n").alias("form_n")))
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(documents: DataFrame) -> DataFrame:
    """The variants of ``documents``, a row per word; see ``grouped`` for odd rows."""
    return grouped(documents).select("word", "form", "root", "n", "n_near", "form_n")
