"""Embedding near-duplicates by collision-counting projections.

Every vector is projected on many one-dimensional directions; in each direction the vectors are sorted, a window is centred
on every one of them, and a pair collides if one lies in the other's window. Pairs that collide often enough are compared
in full. Near vectors have near projections, so how often a pair at the threshold collides follows from the directions
alone: the projections of two unit vectors on a random direction are two normal numbers whose correlation is the cosine.
The count that a pair must reach is calibrated by drawing such numbers: the greatest one that ``RECALL`` of the pairs
exactly at the threshold reach. It holds for any data.

In the middle of a direction a window as wide as near vectors need holds a fixed share of all vectors, so windows there
would meet as many pairs as there are. Far out they are thin. Each vector therefore takes part in the directions in which
it lies farthest out: directions come in families, a direction is the sum of one of a first and one of a second set of
``m`` base directions or their opposites (so ``4 m^2`` directions cost ``2 m`` products), and a vector enters the
``ENTRIES`` directions of each family with its greatest projections. ``m`` grows with the square root of a label's vectors,
so a vector meets about as many others by chance at every size.

Vectors with equal values are one from the start. The sorted vectors of a direction are cut into blocks, and blocks whose
ranges a window can span meet in pairs, so a direction that a large group of copies shares is many small tasks. Links become
spanning forests, then components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.simhash_dedup import Forest, roots_of
from vacantia.plans.session import written

COSINE = 0.93
# Directions: families, and of each family the directions a vector enters.
FAMILIES = 8
ENTRIES = 3
# Half the width of a window, in standard deviations of a projection.
WINDOW = 1.0
# Of the pairs exactly at the threshold so many must reach the count, and so many are drawn to find it.
RECALL = 0.995
DRAWN = 2000
SEED = 12
# Vectors of a label that 16 base directions per set serve; four times the directions serve 16 times the vectors.
SERVED = 512
# Sorted vectors in a block, and vectors or pairs worked on at a time.
BLOCK = 256
SLICE = 1024


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by a power of two, so that no square runs out of range."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    vectors = np.ldexp(vectors, -exponent)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def base_size(vectors: int) -> int:
    """Base directions per set for a label of so many vectors."""
    return 16 * 4 ** max(0, math.ceil(math.log(max(vectors, 1) / SERVED, 16)))


@lru_cache(maxsize=8)
def base_directions(size: int, length: int) -> np.ndarray:
    """The base directions of all families for vectors of a length, the same in every task."""
    return np.random.default_rng([SEED, size, length]).standard_normal((FAMILIES * 2 * size, length)).T


def entries(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (rows x families x ``ENTRIES``) a vector enters, and its projections on them.

    ``projected``: rows x families x 2 x size, projections on the base directions.
    """
    size = projected.shape[-1]
    far = np.argpartition(-np.abs(projected), min(ENTRIES, size) - 1, axis=-1)[..., :ENTRIES]
    value = np.take_along_axis(projected, far, axis=-1)
    # Opposite directions follow the base directions in number.
    number, value = far + size * (value < 0), np.abs(value)
    sums = (value[:, :, 0, :, None] + value[:, :, 1, None, :]).reshape(*value.shape[:2], -1)
    names = (number[:, :, 0, :, None] * (2 * size) + number[:, :, 1, None, :]).reshape(sums.shape)
    best = np.argsort(-sums, axis=-1, kind="stable")[..., :ENTRIES]
    family = np.arange(FAMILIES)[None, :, None] * (4 * size * size)
    return np.take_along_axis(names, best, axis=-1) + family, np.take_along_axis(sums, best, axis=-1) / math.sqrt(2)


@lru_cache(maxsize=64)
def needed(size: int, cosine: float) -> int:
    """The calibrated count of collisions for ``size`` base directions per set."""
    random, counts = np.random.default_rng([SEED, size]), []
    for _ in range(0, DRAWN, step := max(1, (1 << 20) // (FAMILIES * 2 * size))):
        one = random.standard_normal((step, FAMILIES, 2, size))
        other = cosine * one + math.sqrt(1 - cosine * cosine) * random.standard_normal(one.shape)
        (a, x), (b, y) = entries(one), entries(other)
        met = (a[..., :, None] == b[..., None, :]) & (np.abs(x[..., :, None] - y[..., None, :]) <= WINDOW)
        counts.append(met.sum(axis=(1, 2, 3)))
    return max(1, int(np.quantile(np.concatenate(counts), 1 - RECALL, method="lower")))


def _matrix(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    taken = column.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label, need, direction, value, node`` of the directions that nodes enter."""
    for batch in batches:
        label, node, vector, size, need = (batch.column(i) for i in range(5))
        lengths, sizes = vector.value_lengths().to_numpy(zero_copy_only=False), size.to_numpy()
        for length, many in sorted(set(zip(lengths.tolist(), sizes.tolist()))):
            rows = np.nonzero((lengths == length) & (sizes == many))[0]
            step = max(1, min(SLICE, (1 << 22) // (FAMILIES * 2 * many)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                projected = unit(_matrix(vector, part, length)) @ base_directions(many, length)
                direction, value = entries(projected.reshape(len(part), FAMILIES, 2, many))
                again = pa.array(np.repeat(part, FAMILIES * direction.shape[-1]))
                columns = [label.take(again), need.take(again), pa.array(direction.ravel()), pa.array(value.ravel()), node.take(again)]
                yield pa.record_batch(columns, ["label", "need", "direction", "value", "node"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries as blocks of one direction each; a direction with a single vector gives none."""
    names = ["label", "need", "direction", "block", "low", "high", "held", "at"]
    state: dict = {"key": None, "block": 0, "rows": []}
    done: list[tuple] = []

    def close() -> None:
        rows = state["rows"]
        if rows and (state["block"] or len(rows) > 1):
            label, need, direction = state["key"]
            done.append((label, need, direction, state["block"], rows[0][0], rows[-1][0], [r[1] for r in rows], [r[0] for r in rows]))
        state["rows"] = []

    def table(kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        done.clear()
        return out

    for batch in batches:
        kind = batch.column(0).type
        for label, need, direction, value, node in zip(*[c.to_pylist() for c in batch.columns]):
            key = (label, need, direction)
            if key != state["key"]:
                close()
                state.update(key=key, block=0)
            elif len(state["rows"]) == BLOCK:
                close()
                state["block"] += 1
            state["rows"].append((value, node))
        if len(done) >= SLICE:
            yield table(kind)
    close()
    if done:
        yield table(kind)


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, need`` for each pair of two blocks (or of one with itself) in whose windows they lie."""
    for batch in batches:
        needs = batch.column(0).to_pylist()
        for i, need in enumerate(needs):
            held, at, other, beyond = (batch.column(k)[i].values.to_numpy() for k in range(1, 5))
            near = np.abs(at[:, None] - beyond[None, :]) <= WINDOW
            # A block met with itself: each pair once.
            near = np.triu(near, 1) if len(held) == len(other) and held[0] == other[0] else near
            x, y = np.nonzero(near)
            a, b = held[x], other[y]
            columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), need, np.int32))]
            yield pa.record_batch(columns, ["a", "b", "need"])


def _verified(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            m, n = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (u, v))
            linked = np.zeros(len(batch), bool)
            for length in np.unique(m[m == n]).tolist():
                rows = np.nonzero((m == length) & (n == length))[0]
                for at in range(0, len(rows), SLICE):
                    part = rows[at : at + SLICE]
                    dots = np.einsum("ij,ij->i", unit(_matrix(u, part, length)), unit(_matrix(v, part, length)))
                    linked[part] = dots >= cosine
            yield batch.filter(pa.array(linked)).select(["a", "b", "a_rows", "b_rows"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a batch's links at a time."""
    for batch in batches:
        forest = Forest()
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
        yield forest.edges()


def candidates(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``a, b`` for pairs of ``node, label, vector`` that collide often enough."""
    kind = nodes.schema["label"].dataType.simpleString()
    sizes = nodes.groupBy("label").agg(F.count("*").alias("vectors"))
    # Only the few sizes that occur come to the driver.
    limits = [SERVED * 16**k for k in range(12)]
    level = F.aggregate(F.array(*map(F.lit, limits)), F.lit(16).cast("int"), lambda m, x: F.when(F.col("vectors") > x, m * 4).otherwise(m))
    sizes = written(sizes.select("label", level.alias("size")))
    found = sorted(r["size"] for r in sizes.select("size").distinct().collect())
    need = F.element_at(F.create_map(*[F.lit(x) for m in found for x in (m, needed(m, cosine))]), F.col("size")) if found else F.lit(1)
    sized = nodes.join(sizes, "label").select("label", "node", "vector", "size", need.cast("int").alias("need"))
    entered = sized.mapInArrow(_entered, f"label {kind}, need int, direction long, value double, node long")
    laid = entered.repartition("label", "direction").sortWithinPartitions("label", "direction", "value", "node")
    shape = f"label {kind}, need int, direction long, block int, low double, high double, held array<long>, at array<double>"
    blocks = written(laid.mapInArrow(_blocks, shape))
    own = blocks.select("need", "held", "at", F.col("held").alias("other"), F.col("at").alias("beyond"))
    # Only a direction with several blocks has pairs of blocks.
    later = blocks.where("block > 0").select(
        F.col("label").alias("of"), F.col("direction").alias("on"), F.col("block").alias("later"), F.col("low").alias("after"),
        F.col("held").alias("other"), F.col("at").alias("beyond"),
    )
    across = (F.col("label") == F.col("of")) & (F.col("direction") == F.col("on")) & (F.col("block") < F.col("later"))
    crossed = blocks.join(later, across & (F.col("after") - F.col("high") <= WINDOW)).select("need", "held", "at", "other", "beyond")
    met = own.unionByName(crossed).mapInArrow(_collisions, "a long, b long, need int")
    return met.groupBy("a", "b").agg(F.count("*").alias("times"), F.first("need").alias("need")).where("times >= need").select("a", "b")


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``a, b, a_rows, b_rows`` of the linked pairs of ``node, label, vector, rows``."""
    pairs = candidates(nodes, cosine)
    left = nodes.select(F.col("node").alias("a"), F.col("vector").alias("u"), F.col("rows").alias("a_rows"))
    right = nodes.select(F.col("node").alias("b"), F.col("vector").alias("v"), F.col("rows").alias("b_rows"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verified(cosine), "a long, b long, a_rows long, b_rows long")


def classes(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row.

    Rows are linked if their labels are equal and their cosine reaches the threshold. A null label, a null, empty or zero
    vector, one with a null or non-finite component, and one of another length link with nothing. Repeated rows and equal
    vectors link like others; rows without an id lend none, and are kept in no class. An empty table gives no row.
    """
    rows = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    sound = F.col("label").isNotNull() & usable(F.col("vector"))
    # 128 bits of label and vector.
    keys = [F.when(sound, F.xxhash64(F.lit(k), "label", "vector")).alias(f"key{k}") for k in (0, 1)]
    rows = rows.select("*", *keys)
    grouped = rows.where("key0 IS NOT NULL").groupBy("key0", "key1").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("rows"), F.min("vec_id").alias("least")
    )
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()))
    found = written(links(nodes, cosine))
    both = found.select(F.col("a").alias("node"), F.col("b_rows").alias("others")).unionByName(found.select(F.col("b").alias("node"), F.col("a_rows").alias("others")))
    degrees = both.groupBy("node").agg(F.sum("others").alias("others"))
    roots = roots_of(found.select("a", "b").mapInArrow(_forest, "u long, v long")).select(F.col("u").alias("node"), F.col("v").alias("root"))
    named = nodes.join(degrees, "node", "left").join(roots, "node", "left").select(
        "key0", "key1", "least", F.coalesce("root", "node").alias("root"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    named = written(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("key0", "key1", "n_links", "component_id")
    own = rows.select("vec_id", "key0", "key1").join(named, ["key0", "key1"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return own.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
