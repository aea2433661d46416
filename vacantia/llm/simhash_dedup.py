"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by their Gray rank, so neighbours differ in few bits. Consecutive ones form a leaf, and
consecutive leaves form nodes above it. A node keeps the bits that all below it share: a mask and the value
under it. Two nodes cannot hold linked fingerprints if they differ in more than the allowed number of bits that
both share, so the self-join walks down pairs of nodes from the top: a pair's differences so far are carried
along, a level adds those in bits not yet compared, and a pair over the limit is pruned with all below it.
What reaches the leaves is compared in full; nothing is missed.

Every level is a pair of equi-joins on node ids. A task that compares leaves emits a spanning forest of the links
it found, never all pairs of a group. Components come from the forests, in one task while they fit it, else by
alternating large and small stars.
Equal texts have equal fingerprints and are one entry of the index from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.tables import per_text, row_key
from vacantia.plans.session import written

SHINGLE = 3
SEED = 42
DISTANCE = 2
# Fingerprints in a leaf, nodes in a node, levels that one pass over a sorted stretch builds.
LEAF = 64
FAN = 32
LEVELS = 3
STRETCH = LEAF * FAN * FAN
# Links that one task may join; more are joined by rounds of stars.
TASK_EDGES = 500_000
# Shingles hashed at a time, so a long text needs no more memory than this many.
PIECE = 1 << 16

_NODE = "level int, id long, mask long, value long, children array<struct<id:long,mask:long,value:long>>"


def text_fingerprint(text: bytes) -> int:
    """The 64 bits of a text: a bit is set if it is in over half of the hashes of its shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(SHINGLE, len(words))
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    sums = np.zeros(64, np.int64)
    for at in range(0, len(stops), PIECE):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        sums += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(stops), bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash of a text as a long; 0 for null or no word."""

    def make() -> Callable[[list[bytes | None]], list[dict]]:
        return lambda texts: [{"bits": text_fingerprint(t or b"")} for t in texts]

    return per_text(make, "bits long")(text)["bits"]


def gray_rank(bits: Column) -> Column:
    """Place of the bits in the Gray order, as a signed long in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits.bitwiseXOR(F.lit(-(2**63)))


def _nodes_task(sizes: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes over a sorted stretch of items, all levels: a node per ``sizes[0]`` items, per ``sizes[1]`` nodes, ..."""

    def shared(mask: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(mask), size)
        ones = np.bitwise_and.reduceat(value, at)
        zeros = np.bitwise_and.reduceat(~value & mask, at)
        # Bits that all share: set under every mask and everywhere one, or everywhere zero.
        alike = (ones & np.bitwise_and.reduceat(mask, at)) | zeros
        return alike, ones & alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches]
        if not read or not sum(len(r[0]) for r in read):
            return
        ids, mask, value = (np.concatenate([r[i] for r in read]).astype(np.int64) for i in range(3))
        for level, size in enumerate(sizes):
            size = size or len(ids)
            offsets = np.append(np.arange(0, len(ids), size), len(ids)).astype(np.int32)
            fields = [pa.array(x) for x in (ids, mask, value)]
            children = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["id", "mask", "value"]))
            mask, value = shared(mask, value, size)
            ids = ids[offsets[:-1]]
            columns = [pa.array(np.full(len(ids), level, np.int32)), *map(pa.array, (ids, mask, value)), children]
            yield from pa.Table.from_arrays(columns, ["level", "id", "mask", "value", "children"]).to_batches(1024)

    return run


def index(prints: DataFrame) -> list[DataFrame]:
    """The levels of the index over distinct ``bits``, leaves first; the last level has one stretch of nodes.

    Each pass sorts its items into stretches of bounded size and builds ``LEVELS`` levels within each; the roots
    of the stretches are the items of the next pass, until they fit one stretch.
    """
    items = prints.select(F.col("bits").alias("id"), F.lit(-1).cast("long").alias("mask"), F.col("bits").alias("value"))
    count, levels, first = prints.count(), [], True
    while count:
        stretches = -(-count // STRETCH)
        order = gray_rank(F.col("value"))
        # One stretch needs no dealing, only one task of bounded size.
        dealt = items.coalesce(1) if stretches == 1 else items.repartitionByRange(stretches, order)
        laid = dealt.sortWithinPartitions(order, "id")
        sizes = (LEAF, FAN, 0) if first else (FAN, FAN, 0)
        nodes = written(laid.mapInArrow(_nodes_task(sizes), _NODE))
        levels += [nodes.where(F.col("level") == i) for i in range(LEVELS)]
        roots = nodes.where(F.col("level") == LEVELS - 1)
        count = roots.count()
        if count == 1:
            break
        items, first = roots.select("id", "mask", "value"), False
    return levels


def _differences(pairs: DataFrame, distance: int) -> DataFrame:
    """Compare the bits both sides share and were not compared above; prune pairs over the limit."""
    new = F.col("a.mask").bitwiseAND(F.col("b.mask")).bitwiseAND(F.bitwise_not("seen"))
    added = F.bit_count(F.col("a.value").bitwiseXOR(F.col("b.value")).bitwiseAND(new))
    told = pairs.withColumn("apart", F.col("apart") + added).withColumn("seen", F.col("seen").bitwiseOR(new))
    return told.where(F.col("apart") <= distance)


def leaf_pairs(levels: list[DataFrame], distance: int) -> DataFrame:
    """Pairs of leaves (``a`` and ``b``, each its fingerprints) that may hold links, each pair once."""
    top = levels[-1].select(F.struct("id", "mask", "value").alias("a"))
    start = top.withColumn("b", F.col("a")).withColumns({"apart": F.lit(0), "seen": F.lit(0).cast("long")})
    pairs = start
    for down, level in enumerate(reversed(levels[1:])):
        below = level.select(F.col("id").alias("node"), "children")
        pairs = pairs.join(below, F.col("a.id") == F.col("node")).drop("node")
        pairs = pairs.withColumn("same", F.col("a.id") == F.col("b.id")).withColumn("a", F.explode("children")).drop("children")
        # A child against the whole other node first: most go here, before that node's children come in.
        near = _differences(pairs, distance).select("a", "b", "apart", "seen", "same")
        pairs = near.join(below, F.col("b.id") == F.col("node")).drop("node").withColumn("b", F.explode("children"))
        pairs = _differences(pairs.drop("children").where(~F.col("same") | (F.col("a.id") <= F.col("b.id"))), distance)
        pairs = pairs.select("a", "b", "apart", "seen")
    leaves = levels[0].select("id", F.col("children.id").alias("held"))
    first = leaves.select(F.col("id").alias("node"), F.col("held").alias("left"))
    second = leaves.select(F.col("id").alias("node"), F.col("held").alias("right"))
    ids = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    met = ids.join(first, F.col("a") == F.col("node")).drop("node")
    return met.join(second, F.col("b") == F.col("node")).select("left", "right", (F.col("a") == F.col("b")).alias("same"))


class Forest:
    """Components of what was joined so far, each named by its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.parent[max(p, q)] = min(p, q)

    def edges(self) -> pa.RecordBatch:
        """Each member but the smallest with the smallest."""
        linked = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        return pa.record_batch([pa.array([e[k] for e in linked], pa.int64()) for k in (0, 1)], ["u", "v"])


def _links_task(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within and between leaves, as a spanning forest of those of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest = Forest()
            left, right, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for i, own in enumerate(same):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= distance
                rows, columns = np.nonzero(np.triu(near, 1) if own else near)
                for x, y in zip(a[rows].tolist(), b[columns].tolist()):
                    forest.join(x, y)
            yield forest.edges()

    return run


def _forest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
    yield forest.edges()


def roots_of(links: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``u`` and the smallest node ``v`` of its component, for every node of the links but the smallest ones.

    Links that fit one task (there are at most as many as linked fingerprints) are joined there; more of them are
    joined by stars.
    """
    edges = written(links)
    if edges.count() <= task_edges:
        return edges.coalesce(1).mapInArrow(_forest_task, "u long, v long")
    return stars(edges)


def stars(edges: DataFrame) -> DataFrame:
    """``u`` and the smallest node ``v`` of its component, for every node of the edges but the smallest ones.

    Alternating stars: neighbours larger than a node, then the smaller ones, are hung on the smallest it knows.
    Only minima are aggregated and joined back, so a hub's neighbours are never collected.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges
        before = state


def classes(documents: DataFrame, keep: dict[str, Column], text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The ``keep`` columns of each row, its fingerprint ``bits`` and its class, named by its smallest ``bits``.

    A null text and a text without a word have fingerprint 0 and are linked like any other; repeated rows stay.
    """
    marked = documents.select(*[c.alias(n) for n, c in keep.items()], fingerprint(F.col(f"`{text}`")).alias("bits"))
    prints = written(marked)
    distinct = written(prints.select("bits").distinct())
    levels = index(distinct)
    if not levels:
        return prints.withColumn("root", F.col("bits"))
    links = leaf_pairs(levels, distance).mapInArrow(_links_task(distance), "u long, v long")
    roots = roots_of(links).select(F.col("u").alias("bits"), F.col("v").alias("root"))
    return prints.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def components(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hexadecimal) and ``component_id``, the smallest id of the class.

    Rows without an id link others but lend no id; a class of such rows alone has none.
    """
    rows = written(classes(documents, {"doc_id": F.col("doc_id")}))
    # A table of its own, so that a join with a large class can be split.
    least = written(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    hexadecimal = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return rows.join(least, "root").select("doc_id", hexadecimal, "component_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class: the smallest id (null last), and of repeated rows one."""
    columns = documents.columns
    rows = written(classes(documents, {"doc_id": F.col("doc_id"), "key": row_key(columns)}))
    first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key"))["key"].alias("key"))
    times = rows.groupBy("key").agg(F.count("*").alias("times"))
    kept = written(first.join(times, "key").select(F.col("key").alias("kept_key"), (F.col("times") > 1).alias("repeated")))
    keyed = documents.select(F.struct("*").alias("row"), row_key(columns).alias("key"))

    def chosen(repeated: bool) -> DataFrame:
        own = kept.where(F.col("repeated") == repeated)
        return keyed.join(own, F.col("key") == F.col("kept_key"), "left_semi").select("row.*")

    again = not kept.where("repeated").isEmpty()
    return chosen(False).unionByName(chosen(True).dropDuplicates()) if again else chosen(False)
