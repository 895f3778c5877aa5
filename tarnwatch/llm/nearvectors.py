"""Near duplicates among vectors by Euclidean p-stable hashing.

Vectors are normalised, so a cosine c is a distance of sqrt(2 - 2c). A table hashes a vector by `width` projections on Gaussian
directions, each shifted and cut into steps four times as wide as the distance that belongs to `least`; vectors of one bucket
are compared exactly. The number of projections grows with the logarithm of the number of vectors, so that unlike vectors
seldom meet; the number of tables follows from it, so that a pair right at the limit is found with probability `recall` (nearer
pairs more surely).

Equal vectors are one class before anything is hashed, with their number as weight. First only (bucket, vector) numbers move;
vectors follow only into buckets of several. A bucket over BLOCK vectors is split into pieces, and each pair of pieces is a unit
of work of its own. No pair leaves a task: a unit gives, per vector, the weight of the links it found and the first vector of
those it is connected with. A pair that shares several buckets counts in the first table where it does; for that the hashes
are sums of integers, exact in double precision, and the same wherever they are taken.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different
lengths link with nothing either. Rows without id, or with the same id, are rows of their own; the component's id is its smallest
id that is not null (null, if there is none), and a row is kept if its id is that id, null counting as equal to null. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.llm.exprs import components, partitions
from tarnwatch.llm.spread import lookup
from tarnwatch.llm.textkit import mixed
from tarnwatch.plans.freeze import freeze

BLOCK = 1024
STEP = 4.0
SCALE_VECTOR, SCALE_DIRECTION = 1 << 20, 1 << 10
SEED = 71


def agreement(distance: float, step: float) -> float:
    """Probability that one p-stable hash of steps of this width agrees for two vectors at this distance."""
    r = step / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, least: float, recall: float) -> tuple[int, int]:
    """Projections of a table and number of tables for n vectors."""
    near = math.sqrt(2 - 2 * least)
    step = STEP * near
    width = max(2, math.ceil(math.log(max(n, 2)) / -math.log(agreement(math.sqrt(2), step))))
    return width, math.ceil(math.log(1 - recall) / math.log(1 - agreement(near, step) ** width))


@functools.lru_cache(maxsize=8)
def _directions(size: int, width: int, tables: int, step: float):
    draw = np.random.Generator(np.random.PCG64([SEED, size]))
    directions = np.rint(np.clip(draw.standard_normal((size, width * tables)), -8, 8) * SCALE_DIRECTION)
    unit = int(step * SCALE_VECTOR * SCALE_DIRECTION)
    codes = draw.integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return directions, draw.integers(0, unit, width * tables), unit, codes, draw.integers(1, 2**63, tables, dtype=np.uint64)


def bucket_keys(vectors: np.ndarray, width: int, tables: int, step: float) -> np.ndarray:
    """Bucket of every (unit) vector in every table."""
    directions, shifts, unit, codes, names = _directions(vectors.shape[1], width, tables, step)
    whole = np.rint(vectors * SCALE_VECTOR) @ directions
    cells = (whole.astype(np.int64) + shifts) // unit
    return mixed((cells.astype(np.uint64).reshape(len(vectors), tables, width) * codes).sum(2, dtype=np.uint64) + names).view(np.int64)


def normalised(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of all vectors of one length, for every length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, normalised(values[starts[rows, None] + np.arange(length)])


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def _linked(vectors: np.ndarray, keys: np.ndarray, here: int, left: np.ndarray, right: np.ndarray | None, least: float):
    """Pairs (i, j) with a cosine of at least `least` and no earlier common table, of one set of rows or across two."""
    other = left if right is None else right
    near = vectors[left] @ vectors[other].T >= least
    if right is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = left[i], other[j]
    for table in range(keys.shape[1]):
        if not len(i) or keys[left[0], table] == here:
            break
        new = keys[i, table] != keys[j, table]
        i, j = i[new], j[new]
    return i, j


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes can reach over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _found(rows: pa.Table, width: int, tables: int, step: float, least: float) -> pa.Table:
    """Node, weight of its links, first node of those connected with it, of one unit."""
    node, weight, key, low, high, piece = (rows[c].to_numpy() for c in ("node", "copies", "key", "low", "high", "piece"))
    out = []
    for members, vectors in by_length(rows["vector"]):
        keys = bucket_keys(vectors, width, tables, step)
        order = np.lexsort((node[members], high[members], low[members], key[members]))
        k, l, h = key[members][order], low[members][order], high[members][order]
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (l[1:] != l[:-1]) | (h[1:] != h[:-1])) + 1
        for run in np.split(order, cuts):
            if len(run) < 2:
                continue
            at = members[run]
            first = piece[at] == low[at[0]]
            across = low[at[0]] != high[at[0]]
            i, j = _linked(vectors, keys, key[at[0]], run[first] if across else run, run[~first] if across else None, least) \
                if not across or first.any() and not first.all() else (run[:0], run[:0])
            if not len(i):
                continue
            some, place = np.unique(np.concatenate((i, j)), return_inverse=True)
            a, b = place[:len(i)], place[len(i):]
            total = np.zeros(len(some), np.int64)
            w = weight[members[some]]
            np.add.at(total, a, w[b])
            np.add.at(total, b, w[a])
            nodes = node[members[some]]
            out.append((nodes, total, nodes[connected(len(some), a, b)]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("node", "links", "first"), columns)))


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct vector: its smallest id, its number of rows and a number that grows with the smallest id."""
    parts = F.pmod("_row", F.lit(partitions(rows.sparkSession)))
    some = rows.where("_usable").groupBy("_k1", "_k2", parts).agg(
        F.any_value("_vector").alias("vector"), F.min("_id").alias("id"), F.count("*").alias("copies"))
    one = some.groupBy("_k1", "_k2").agg(F.any_value("vector").alias("vector"), F.min("id").alias("id"), F.sum("copies").alias("copies"))
    ordered = one.orderBy(F.col("id").asc_nulls_last(), "_k1", "_k2")
    return freeze(ordered.withColumn("node", F.monotonically_increasing_id()), "vector_classes")


def links(classes: DataFrame, n: int, least: float = 0.95, recall: float = 0.99) -> DataFrame:
    """(node, links, first) rows found among distinct vectors (node, copies, vector); a node may have several rows."""
    spark = classes.sparkSession
    width, tables = plan(n, least, recall)
    step = STEP * math.sqrt(2 - 2 * least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for rows, vectors in by_length(batch.column("vector")):
                for some in range(0, len(rows), 1000):
                    keys = bucket_keys(vectors[some:some + 1000], width, tables, step)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(node[rows[some:some + 1000]], tables))], ["key", "node"])

    buckets = freeze(classes.select("node", "vector").mapInArrow(hashed, "key long, node long"), "buckets")
    parts = partitions(spark)
    sizes = buckets.groupBy("key", F.pmod("node", F.lit(parts))).count().groupBy("key").agg(F.sum("count").alias("size"))
    shared = lookup(buckets, sizes.where("size > 1"), ["key"], F.col("node")).where("size is not null")
    pieces = F.ceil(F.col("size") / BLOCK).cast("int")
    shared = shared.select("key", "node", pieces.alias("pieces"), F.pmod(F.xxhash64("node"), pieces).cast("int").alias("piece"))
    dealt = freeze(shared.select("*", F.explode(F.expr("sequence(0, pieces - 1)")).alias("other")).select(
        "key", "node", "pieces", "piece", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high")), "dealt")
    units = F.lit(max(parts, dealt.count() // (4 * BLOCK)))
    unit = F.when(F.col("pieces") == 1, F.pmod("key", units)).otherwise(F.xxhash64("key", "low", "high"))
    sent = dealt.join(classes.select("node", "copies", "vector"), "node").withColumn("unit", unit)
    found = sent.groupBy("unit").applyInArrow(
        lambda rows: _found(rows, width, tables, step, least), "node long, links long, first long")
    return freeze(found, "vector_links")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.95,
                    recall: float = 0.99) -> DataFrame:
    """id, n_links, component_id, kept of every row: how many other rows were found at a cosine of at least `least`, the smallest
    id reachable over such links, and whether it is the row's own."""
    vector = F.col(vector_column)
    rows = vectors.select(F.col(id_column).alias("_id"), vector.alias("_vector"), usable(vector).alias("_usable"),
                          F.xxhash64(F.lit(1), vector).alias("_k1"), F.xxhash64(F.lit(2), vector).alias("_k2"))
    rows = freeze(rows.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    classes = _classes(rows)
    found = links(classes, classes.count(), least, recall)
    joined = components(found.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")), "vector_edges")
    known = classes.select("node", "_k1", "_k2", "copies", F.col("id").alias("own")).join(joined, "node", "left").join(
        found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    known = lookup(known, classes.select(F.col("node").alias("component"), F.col("id").alias("component_id")), ["component"], F.col("node"))
    known = known.select("_k1", "_k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         "component_id", F.lit(True).alias("_known"))
    out = lookup(rows.where("_usable").select("_id", "_row", "_k1", "_k2"), known, ["_k1", "_k2"], F.col("_row")).select(
        "_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not _usable").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_column), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
