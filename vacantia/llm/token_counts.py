"""Token counts by section with offset-mapped attribution.

A document is encoded once as a whole, so its tokens are those a model sees. The tokenizer is byte-level: its tokens'
byte lengths add up to the places of the tokens in the text. Sections are spans of characters; both are sorted by
place, and a binary search of section ends among token places is the interval join.

A token that crosses the border of a section is allocated by one of two rules: ``start`` gives it whole to every
section that holds its first byte, ``share`` gives each section the share of the token's bytes it holds. If the
sections part the text without gaps, either adds up to the number of tokens of the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from vacantia.llm.tables import SLICE

TOKENIZER = "byte_bpe_50k.tiktoken"
RULES = ("start", "share")

_SECTION = "section int, start long, end long, n_tokens double, n_crossing long"


def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(tokens: tiktoken.Encoding) -> np.ndarray:
    """Bytes of each token by its id."""
    lengths = np.zeros(tokens.n_vocab, np.int64)
    for token in tokens.token_byte_values():
        lengths[tokens.encode_single_token(token)] = len(token)
    return lengths


def lines(text: bytes) -> np.ndarray:
    """Spans of the lines in bytes, each with the line break that ends it; none for an empty text."""
    ends = np.nonzero(np.frombuffer(text, np.uint8) == 0x0A)[0] + 1
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    return np.stack((np.concatenate(([0], ends[:-1])), ends), axis=1) if len(ends) else np.zeros((0, 2), np.int64)


def attributed(ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each span, and how many of the tokens it touches cross its border; places are in bytes."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    begin, stop = spans[:, 0], spans[:, 1]
    # Tokens that touch a span are those from the one that holds its first byte to the one that holds its last.
    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, stop, "left")
    some = (stop > begin) & (last > first)
    head = some & (starts[np.minimum(first, len(ends) - 1)] < begin) if len(ends) else some
    tail = some & (ends[np.maximum(last, 1) - 1] > stop) if len(ends) else some
    crossing = head.astype(np.int64) + tail - (head & tail & (last - first == 1))
    if rule == "start":
        counts = np.searchsorted(starts, stop, "left") - np.searchsorted(starts, begin, "left")
        return np.where(some, counts, 0).astype(float), crossing
    # Tokens as a function of the place: whole tokens before it and the share of the one it lies in.
    edges, at = np.concatenate(([0], ends)), np.arange(len(ends) + 1)
    return np.where(some, np.interp(stop, edges, at) - np.interp(begin, edges, at), 0.0), crossing


def _task(path: str, rule: str, by_line: bool):
    returned = ArrayType(StructType.fromDDL(_SECTION))
    kind = to_arrow_type(returned)

    def one(tokens: tiktoken.Encoding, lengths: np.ndarray, text: bytes, sections: list[dict | None] | None) -> list[dict]:
        ids = np.array(tokens.encode_ordinary(text.decode(errors="replace")), np.int64)
        ends = np.cumsum(lengths[ids])
        # Characters begin at every byte that continues none.
        begins = np.append(np.nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)[0], len(text))
        if by_line:
            spans = lines(text)
            characters = np.searchsorted(begins, spans)
        else:
            asked = [(s["start"], s["end"]) for s in sections or [] if s and s["start"] is not None and s["end"] is not None]
            characters = np.clip(np.array(asked, np.int64).reshape(-1, 2), 0, len(begins) - 1)
            spans = begins[characters]
        counts, crossing = attributed(ends, spans, rule)
        columns = zip(characters[:, 0].tolist(), characters[:, 1].tolist(), counts.tolist(), crossing.tolist())
        names = ("section", "start", "end", "n_tokens", "n_crossing")
        return [dict(zip(names, (i, *row))) for i, row in enumerate(columns)]

    @F.arrow_udf(returned)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokens = encoding(path)
        lengths = token_lengths(tokens)
        for texts, sections in batches:
            texts, parts = texts.cast(pa.large_binary()), []
            for at in range(0, len(texts), SLICE):
                rows = zip(texts.slice(at, SLICE).to_pylist(), sections.slice(at, SLICE).to_pylist())
                parts.append(pa.array([one(tokens, lengths, t or b"", s) for t, s in rows], type=kind))
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run


def section_counts(
    text: Column, sections: Column | None = None, rule: str = "start", tokenizer: str | None = None
) -> Column:
    """Array of each section's number, span in characters, tokens, and tokens that cross its border.

    ``sections`` is an array of structs with ``start`` and ``end`` (characters, end exclusive); they may overlap and
    leave gaps, are cut to the text, and nulls among them are passed over. Without it the lines are the sections. A
    null or empty text has no line, and no token in any section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    run = _task(tokenizer or public_tokenizers.path(TOKENIZER), rule, sections is None)
    none = F.lit(None).cast("array<struct<start:long,end:long>>")
    return run(text, none if sections is None else sections)


def digest(documents: DataFrame) -> DataFrame:
    """A row per document and line of ``documents``: its span and tokens; a document without a line gives none.

    A token across lines, such as one of several line breaks, counts for the line that holds its first byte.
    """
    found = documents.select("doc_id", F.explode(section_counts(F.col("text"))).alias("line"))
    line = [F.col(f"line.{c}") for c in ("section", "start", "end")]
    return found.select("doc_id", *line, F.col("line.n_tokens").cast("long").alias("n_tokens"), "line.n_crossing")
