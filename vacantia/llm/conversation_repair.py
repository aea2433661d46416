"""Conversation repair: the cheapest edits that give every conversation a legal order of roles.

Legal are conversations whose role initials read ``(s?(ua)+)?``. What was read so far is in one of four states: nothing,
a system row alone, a user row last, an assistant row last. A row is kept, given another role or deleted, and empty rows
may be inserted before it; each choice leads from a state to a state at a cost. Three passes stream over rows that Spark
has dealt by conversation and sorted by turn, each with a state of fixed size that it carries across Arrow batches, so a
conversation of any length needs no more memory than a short one:

1. Forward, without texts: the cheapest cost of each state after each row and which cheapest edits come first in order.
   A row's choices for the four states are 24 bits; these backpointers go to the shared folder.
2. Backward over the backpointers: the state the cheapest way ends in, row by row to the start, gives each row its edits.
3. Forward over texts and edits, merged by sort order: the repaired rows. Texts are shuffled once, here.

Ties between cheapest ways go to the edits that read first. Ways to different states are compared by rank: the edits of
two ways up to the same row cannot begin one another (both end with an edit of that row, and have as many such edits), so
what comes later never turns their order.

A row whose role and text came earlier is found by Spark: the first turn of each role and text in its conversation is
aggregated and joined back, so no task remembers texts.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vacantia.plans.session import written

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# A state that much dearer than the cheapest is never part of a cheapest way: two inserted rows make up for any state.
BEHIND = 2 * INSERT
BLANKS = " \t\n\x0b\x0c\r"
EDITS = "KRD"
# Output rows, and characters of their texts, that a task holds at a time.
HELD_ROWS = 4096
HELD_CHARS = 1 << 22

# States after some rows: nothing, a system row, a user row last, an assistant row last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
# The state that the next row with this initial leads to, where it is legal.
_NEXT = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_SOUND, _SHORT, _GONE = range(3)
_FAULTS = {None: _SOUND, "truncated": _SHORT, "blank": _GONE, "duplicate": _GONE}

# Of each state: cheapest cost over the least of all states, and rank of its edits; None where no way leads.
Vector = tuple[tuple[int, int] | None, ...]
_START: Vector = ((0, 0), None, None, None)


def _inserted(state: int, times: int) -> tuple[int, list[str]]:
    """The state after inserting so many rows, and their roles."""
    roles = []
    for _ in range(times):
        state = ASSISTANT if state == USER else USER
        roles.append(_ROLE[state])
    return state, roles


@lru_cache(maxsize=1 << 16)
def step(vector: Vector, initial: str, fault: int) -> tuple[Vector, int, int]:
    """The vector after a row, the row's backpointers, and by how much the least cost grew."""
    best: dict[int, tuple] = {}
    for source, way in enumerate(vector):
        if way is None:
            continue
        for times in range(3):
            at, _ = _inserted(source, times)
            ways = [(at, "D", DELETE)]
            if fault != _GONE:
                more = TRUNCATED if fault == _SHORT else 0
                ways += [(_NEXT[at, initial], "K", more)] if (at, initial) in _NEXT else []
                ways += [(_NEXT[at, new], "R", REROLE + more) for new in "ua" if (at, new) in _NEXT]
            for target, edit, cost in ways:
                way_there = (way[0] + INSERT * times + cost, way[1], "I" * times + edit, source, times)
                if target not in best or way_there < best[target]:
                    best[target] = way_there
    least = min(w[0] for w in best.values())
    best = {t: w for t, w in best.items() if w[0] <= least + BEHIND}
    order = sorted({(w[1], w[2]) for w in best.values()})
    after = tuple((best[t][0] - least, order.index(best[t][1:3])) if t in best else None for t in _STATES)
    back = 0
    for target, (_, _, edits, source, times) in best.items():
        back |= (source | times << 2 | EDITS.index(edits[-1]) << 4) << 6 * target
    return after, back, least


def finish(vector: Vector) -> tuple[int, int, int]:
    """The state before the last inserted rows, how many those are, and their cost over the least."""
    ends = []
    for source, way in enumerate(vector):
        for times in range(3) if way is not None else ():
            at, _ = _inserted(source, times)
            if at in (NOTHING, ASSISTANT):
                ends.append((way[0] + INSERT * times, way[1], times, source))
    cost, _, times, source = min(ends)
    return source, times, cost


class _Out:
    """Rows of a schema in batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, *row: object, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= HELD_ROWS or self.chars >= HELD_CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self.rows, self.chars = [], 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        # A slice at a time: a batch of long texts is never there twice as a whole.
        for at in range(0, len(batch), 256):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 256).columns])


def _streamed(work: Callable[[Iterator[tuple], Callable], Iterator], schema: StructType) -> Callable:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(arrow)
        yield from work(_rows(batches), out.add)
        yield from out.rest()

    return run


def _forward(rows: Iterator[tuple], add: Callable) -> Iterator:
    """Rows of a conversation in order, with their place, fault and backpointers; after them a row for its end."""
    conv, place, vector, before = None, 0, _START, None

    def end() -> Iterator:
        source, times, _ = finish(vector)
        return add(conv, place, True, None, None, None, None, source | times << 2)

    for conv_id, turn, role, digest, fault, later in rows:
        if before is not None and conv_id != conv:
            yield from end()
            place, vector, before = 0, _START, None
        conv, own = conv_id, (turn, role, digest)
        if fault != "blank" and (later or own == before):
            fault = "duplicate"
        vector, back, _ = step(vector, role[:1], _FAULTS[fault])
        yield from add(conv, place, False, turn, role, digest, fault, back)
        place, before = place + 1, own
    if before is not None:
        yield from end()


def _backward(rows: Iterator[tuple], add: Callable) -> Iterator:
    """Each row's edits, from a conversation's end to its start: state before, inserted rows, edit and state after."""
    state = NOTHING
    for conv, place, last, turn, role, digest, fault, back in rows:
        if last:
            state = back & 3
            yield from add(conv, place, last, turn, role, digest, fault, back)
            continue
        told = back >> 6 * state & 63
        yield from add(conv, place, last, turn, role, digest, fault, told | state << 6)
        state = told & 3


def _merged(rows: Iterator[tuple], add: Callable) -> Iterator:
    """Repaired rows: each text meets the edits that stand before it in the order."""
    waiting: deque[tuple] = deque()
    for conv, last, turn, role, _, is_text, place, fault, told, text in rows:
        if not is_text and not last:
            # Equal rows of a turn wait together, as two numbers each.
            waiting.append((place, fault, told))
            continue
        if is_text:
            place, fault, told = waiting.popleft()
        _, roles = _inserted(told & 3, told >> 2 & 3)
        for number, new in enumerate(roles):
            yield from add(conv, place, number, None, None, new, "", None, "I")
        if is_text:
            edit = EDITS[told >> 4 & 3]
            new = _ROLE[told >> 6] if edit == "R" else role
            yield from add(conv, place, len(roles), turn, role, new, text, fault, edit, chars=len(text))


def _fault(text: Column) -> Column:
    """``blank`` or ``truncated``, or null."""
    bare = F.rtrim(text, F.lit(BLANKS))
    ends = bare.endswith(".") | bare.endswith("!") | bare.endswith("?")
    return F.when(bare == "", "blank").when(~ends, "truncated")


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of all conversations with their edits, and the inserted ones, in order within a partition.

    Of ``conv_id, turn, role, text`` (other columns are not read). Gives ``conv_id, place`` (of the row in its conversation,
    from 0; inserted rows have the place they stand before), ``step`` (order within a place), ``turn, old_role, role, text``,
    ``fault`` (blank, duplicate, truncated or null) and ``edit`` (K kept, R new role, D deleted, I inserted). The
    conversation after repair is all rows but the deleted ones.

    Rows go by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text, so equal rows are neighbours
    and all but the first are duplicates. A null role or text counts as one space; a role's initial is its first character,
    and an empty role has none that is legal. A null ``conv_id`` is one conversation. An empty table gives no row.
    """
    space = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    narrow = rows.select("conv_id", "turn", "role", "digest", _fault(F.col("text")).alias("fault"))
    # Counted without texts; only what comes twice is joined back.
    firsts = narrow.groupBy(F.col("conv_id").alias("in_conv"), F.col("role").alias("by"), F.col("digest").alias("said")).agg(
        F.min(F.struct("turn"))["turn"].alias("first"), F.count("*").alias("times")
    ).where("times > 1")
    same = F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("said"))
    later = F.col("times").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("first") < F.col("turn")))
    flagged = narrow.join(firsts, same, "left").select(*narrow.columns, F.coalesce(later, F.lit(False)).alias("later"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = StructType.fromDDL(
        f"conv_id {kind}, place long, last boolean, turn long, role string, digest binary, fault string, told int"
    )
    dealt = flagged.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    traced = written(dealt.mapInArrow(_streamed(_forward, shape), shape))
    down = traced.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place"))
    edits = down.mapInArrow(_streamed(_backward, shape), shape)
    none = F.lit(None)
    both = edits.select(
        "conv_id", "last", "turn", "role", "digest", F.lit(False).alias("is_text"), "place", "fault", "told", none.cast("string").alias("text")
    ).unionByName(
        rows.select(
            "conv_id", F.lit(False).alias("last"), "turn", "role", "digest", F.lit(True).alias("is_text"),
            none.cast("long").alias("place"), none.cast("string").alias("fault"), none.cast("int").alias("told"), "text",
        )
    )
    out = StructType.fromDDL(
        f"conv_id {kind}, place long, step int, turn long, old_role string, role string, text string, fault string, edit string"
    )
    order = ["conv_id", "last", "turn", "role", "digest", "is_text", "place"]
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_streamed(_merged, out), out)


# --- the query ---------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by the CRC-32 of ``conv_id:turn`` (nulls: one space)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(key) % 20, F.coalesce("text", space)
    marked = conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        # No copy, one or two.
        F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return marked.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


class _Summary:
    """What the digest says of a conversation, from its repaired rows in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.faults, self.illegal, self.cost = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.least = self.most = self.initial = None
        self.turns, self.rows, self.audit, self.sha = 0, 0, bytearray(), hashlib.sha256()

    def read(self, turn: int | None, old_role: str | None, role: str, text: str, fault: str | None, edit: str) -> None:
        self.audit += edit.encode()
        if edit == "I":
            self.cost += INSERT
        else:
            if fault:
                self.faults[fault] += 1
            if self.initial is not None and self.initial + old_role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = old_role[:1]
            if turn is not None and turn != self.most:
                self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
            self.cost += {"K": 0, "R": REROLE, "D": DELETE}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "D":
            self.sha.update(b"\n" if self.rows else b"")
            self.sha.update(f"{role}:{text}".encode())
            self.rows += 1

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def _summarised(rows: Iterator[tuple], add: Callable) -> Iterator:
    now = None
    for conv, _, _, turn, *row in rows:
        if now is not None and now.conv != conv:
            yield from add(*now.row(), chars=len(now.audit))
            now = None
        now = now or _Summary(conv)
        now.read(turn, *row)
    if now is not None:
        yield from add(*now.row())


def digest(conversations: DataFrame) -> DataFrame:
    """A row per ``conv_id`` of ``conversations`` after ``damaged``: faults, cost, edits and a hash of what was repaired.

    Conversations of which damage leaves no row have zeros, no edits and the hash of an empty text. Odd rows are taken as
    in ``repaired``, and an empty table gives no row.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    shape = StructType.fromDDL(f"id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
    # Straight after the stream that gives the rows: its order is theirs.
    told = repaired(damaged(conversations)).mapInArrow(_streamed(_summarised, shape), shape)
    ids = conversations.select("conv_id").distinct()
    return ids.join(told, ids["conv_id"].eqNullSafe(told["id"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
