"""Quality rules: plain counts of a text, and a hashed n-gram likelihood ratio.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are counted: one from the
trusted target (documents labelled good), one from all documents. A document's score is the mean, over its
n-grams, of the logarithm of their ratio, so long and short texts compare; every document is judged against one
fixed threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.tables import SLICE, per_text

BUCKETS = 1 << 14
# N-grams that the target is credited with in the proportions of the raw corpus, as a share of its own, so that buckets the
# target says little about have a ratio near one. A share: a corpus told twice gives every document the same score.
CREDIT = 0.5
# Mean log ratio below which a document is not kept.
THRESHOLD = -0.1
# The trusted target is at most this many labelled documents, those with the smallest hash of their id; their ids are what
# is broadcast, some megabytes at most.
TRUSTED = 100_000
# Rules: fewer words fail, and so does a greater percentage of words in repeated windows of this many words.
LEAST_WORDS = 20
REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
# Words hashed at a time, so a long text needs no more memory than this many.
PIECE = 1 << 16

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def bucket_counts(words: list[bytes]) -> np.ndarray:
    """How many of the words and pairs of neighbouring words fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(words), PIECE):
        # A piece takes the next piece's first word along for the pair across.
        part = words[at : at + PIECE + 1]
        hashes = np.fromiter(map(zlib.crc32, part), np.uint64, len(part))
        pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xD6E8FEB86659FD93)
        own = hashes[:PIECE] * np.uint64(0x9E3779B97F4A7C15)
        shift = np.uint64(65 - BUCKETS.bit_length())
        buckets = np.concatenate((own >> shift, pairs >> shift)).astype(np.int64)
        counts += np.bincount(buckets, minlength=BUCKETS)
    return counts


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts: (bucket, raw, target), one row per bucket that occurs."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            trusted = part.column("trusted").to_pylist()
            raw += bucket_counts_of([t for t in texts if t])
            target += bucket_counts_of([t for t, good in zip(texts, trusted) if t and good])
    used = np.nonzero(raw)[0]
    yield pa.record_batch([pa.array(x) for x in (used, raw[used], target[used])], ["bucket", "raw", "target"])


def bucket_counts_of(texts: list[bytes]) -> np.ndarray:
    return sum((bucket_counts(t.split()) for t in texts), np.zeros(BUCKETS, np.int64))


def learn(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of the target's to the raw corpus' probability, for each bucket.

    The raw counts are over all documents. The ids of the trusted ones are bounded by ``TRUSTED`` and so may be
    broadcast; only counts by bucket come to the driver. Rows without an id are raw corpus only; without any trusted
    document the ratio is zero everywhere.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    bounded = good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(TRUSTED)
    texts = documents.select("doc_id", "text").where("text is not null")
    marked = texts.join(F.broadcast(bounded), F.col("doc_id") == F.col("trusted_id"), "left")
    marked = marked.select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    counts = marked.mapInArrow(_count_task, "bucket long, raw long, target long")
    total = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in total.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw / raw.sum()
    share = (target / target.sum() + CREDIT * expected) / (1 + CREDIT)
    return np.log(np.divide(share, expected, out=np.ones(BUCKETS), where=expected > 0))


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words that is found twice or more, the first time included.

    Windows are named exactly: names of windows of twice the length are the names of pairs of shorter ones.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        pairs = names[:-size] * (len(words) + 1) + names[size:]
        names = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.nonzero(twice)[0], 1)
    np.add.at(edges, np.nonzero(twice)[0] + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def counted(text: bytes) -> dict:
    """The plain counts of a text, and whether the rules fail it."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    return {
        "n_words": len(words),
        "word_chars": len(b"".join(words).translate(None, _CONTINUATION)),
        "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": len(words) < LEAST_WORDS or 100 * repeated > REPEATED_PERCENT * len(words),
    }


def judged(text: Column, ratio: np.ndarray, threshold: float = THRESHOLD) -> Column:
    """Counts of a text, ``kept`` and ``score``; a null text is empty, has score 0 and fails the rules."""

    def make() -> Callable[[list[bytes | None]], list[dict]]:
        def one(text: bytes | None) -> dict:
            found = counted(text or b"")
            counts = bucket_counts((text or b"").split())
            score = float(counts @ ratio / counts.sum()) if found["n_words"] else 0.0
            return found | {"kept": not found["base_failed"] and score >= threshold, "score": score}

        return lambda texts: [one(t) for t in texts]

    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return per_text(make, f"{longs}, base_failed boolean, kept boolean, score double")(text)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``: every row is judged, repeated rows each."""
    found = judged(F.col("text"), learn(documents, labels))
    return documents.select("doc_id", found.alias("found")).select("doc_id", "found.*")
