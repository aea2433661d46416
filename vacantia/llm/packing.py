"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own items best-fit, longest first, and its nearly full bins are done. The underfull bins
are the items of the next round, on fewer partitions, and so on up a tree until one task holds what is left or a
round gains nothing. A task never packs more than ``TASK_ITEMS`` items at once, so what a task holds is bounded
whatever the data; every item ends in exactly one bin.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vacantia.llm.tables import SLICE
from vacantia.plans.session import written

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
# A bin this full is done.
NEARLY = 0.998
# Bins a task packs at once, how many partitions become one, and the gain below which rounds stop.
TASK_ITEMS = 200_000
MERGE = 8
LEAST_GAIN = 0.002
# Words whose ids a task remembers before it starts to remember anew.
REMEMBERED = 500_000
# Letters that lower-case to letters of the same list and never combine, and characters that are no letter, digit or
# apostrophe: the tokenizer cuts between the two.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(rf"[{_LETTERS}]+")


class Encoder:
    """Ids of texts by a tokenizer that never looks across white space, as little-endian unsigned 32-bit numbers.

    Texts are encoded whole: the tokenizer turns white space into word breaks and encodes word by word, so a word's
    ids are the same in every text and are asked from the tokenizer once. Most words are letters and then perhaps
    punctuation; both parts are words of their own to the tokenizer, so those are asked once too.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _lettered(self, cores: list[bytes]) -> list[bytes]:
        """Ids of lower-case words of letters: one call for all, cut where the tokenizer counts a new word."""
        found = self.tokenizer.encode(b" ".join(cores).decode(), add_special_tokens=False)
        words, ids = np.array(found.word_ids, np.int64), np.array(found.ids, "<u4")
        if len(cores) != (words[-1] + 1 if len(words) else 0):
            raise ValueError("the tokenizer does not take a word of letters as one word")
        cuts = np.searchsorted(words, np.arange(len(cores) + 1)).tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _ascii(self, core: bytes) -> bytes:
        """Ids of a lower-case word of ASCII letters, which all steps before the model leave as it is."""
        ids = [token.id for token in self.model.tokenize(core.decode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, text: bytes) -> bytes:
        if text not in self.parts:
            self.parts[text] = self._encoded([text])[0] if text else b""
        return self.parts[text]

    def _learn(self, words: list[bytes]) -> None:
        known, parts = self.words, self.parts
        lettered: dict[bytes, bytes] = {}
        odd: list[bytes] = []
        for word in words:
            core = word.rstrip(_TAIL)
            if core.isalpha():
                low = core.lower()
                ids = parts.get(low)
                if ids is None:
                    ids = parts[low] = self._ascii(low)
                known[word] = ids + self._part(word[len(core) :])
            elif core and _WORD.fullmatch(low := core.decode(errors="replace").lower()):
                lettered[word] = low.encode()
            else:
                odd.append(word)
        if new := list(set(lettered.values()) - parts.keys()):
            parts.update(zip(new, self._lettered(new)))
        for word, low in lettered.items():
            known[word] = parts[low] + self._part(word[len(word.rstrip(_TAIL)) :])
        if odd:
            known.update(zip(odd, self._encoded(odd)))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        if len(self.words) > REMEMBERED:
            self.words, self.parts = {}, {}
        known = self.words
        self._learn([word for word in set().union(*split) if word not in known])
        return [b"".join([known[word] for word in words]) for words in split]


def _pieces_task(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                rows, starts, ids = [], [], []
                for row, found in enumerate(encode([t or b"" for t in texts])):
                    found += end
                    for start in range(0, len(found), 4 * capacity):
                        rows.append(row)
                        starts.append(start // 4)
                        ids.append(found[start : start + 4 * capacity])
                start = np.array(starts, np.int64)
                yield pa.record_batch(
                    [
                        part.column("record").take(pa.array(rows, pa.int64())),
                        pa.array((start // capacity).astype(np.int32)),
                        pa.array(start),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["record", "piece", "start", "length", "ids"],
                )

    return run


def pieces(
    documents: DataFrame, keep: list[str], tokenizer: str | None = None, text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Each text's ids and the end id, cut into pieces of ``capacity``: ``record`` (the ``keep`` columns), ``piece``,
    ``start``, ``length`` and ``ids`` (binary). A null text is empty and gives the end id alone."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("record"), F.col(f"`{text}`").alias("text"))
    record = rows.schema["record"].dataType.simpleString()
    schema = f"record {record}, piece int, start long, length long, ids binary"
    return rows.mapInArrow(_pieces_task(path, capacity), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that has room, else into a new one.

    Bins are kept by the room they have, and a number has a bit for each room some bin has.
    """
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own, made = capacity, made, made + 1
        bins[item] = own
        if room > length:
            by_room[room - length].append(own)
            rooms |= 1 << (room - length)
    return bins


def _round_task(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs a partition's bins, ``TASK_ITEMS`` at a time: (fill, members), both for the new bins."""

    def packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        fill = table["fill"].to_numpy()
        own = best_fit(fill, capacity)
        order = np.argsort(own, kind="stable")
        members = table["members"].chunk(0).take(pa.array(order))
        counts = np.bincount(own, members.value_lengths().to_numpy()[np.argsort(order)]).astype(np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        new = pa.ListArray.from_arrays(offsets, members.flatten())
        sums = np.bincount(own, fill).astype(np.int64)
        yield from pa.Table.from_arrays([pa.array(sums), new], ["fill", "members"]).to_batches(4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_ITEMS:
                yield from packed(held)
                held = []
        if sum(b.num_rows for b in held):
            yield from packed(held)

    return run


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``item`` and ``length`` of each row of ``items`` with its ``sequence_id`` and its ``offset`` there.

    Lengths are from 1 to ``capacity``. Items may be null or repeated; none is lost. No item gives no row.
    """
    member = F.struct("item", F.col("length").cast("long").alias("length"))
    bins = written(items.select(F.col("length").cast("long").alias("fill"), F.array(member).alias("members")))
    kind = bins.schema["members"].dataType.simpleString()
    parts, count, done = bins.rdd.getNumPartitions(), bins.count(), []
    number = 0
    while count:
        full = F.col("fill") >= int(NEARLY * capacity)
        made = bins.mapInArrow(_round_task(capacity), f"fill long, members {kind}")
        # Numbered when written, so the numbers stay; the round keeps those of different rounds apart.
        name = F.monotonically_increasing_id() * 32 + number
        table = written(made.select("fill", "members", name.alias("sequence_id"), full.alias("full")))
        number += 1
        rest = table.where(~F.col("full"))
        left = rest.count()
        fewer = max(parts // MERGE, -(-left // TASK_ITEMS), 1)
        if parts == 1 or left == 0 or (fewer >= parts and left > (1 - LEAST_GAIN) * count) or number == 31:
            done.append(table)
            break
        done.append(table.where("full"))
        bins, parts, count = rest.select("fill", "members").coalesce(fewer), fewer, left
    if not done:
        return bins.select("members.item", "fill").selectExpr("item[0] item", "fill length", "0L sequence_id", "0L offset")
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    placed = every.select("sequence_id", F.posexplode("members").alias("at", "member"), F.col("members.length").alias("lengths"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, n: a + n)
    return placed.select("member.item", "member.length", "sequence_id", before.alias("offset"))


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``, a row per piece."""
    columns = ["record.doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")]
    cut = pieces(documents, ["doc_id"]).select(*columns)
    return packed(cut.select(F.struct("*").alias("item"), "length")).select("item.*", "sequence_id", "offset")
