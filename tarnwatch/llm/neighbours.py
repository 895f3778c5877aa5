"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that gives all the same length, so the largest inner product is the smallest distance.
Centroids are fitted on a bounded sample; clusters that outgrow twice their share are split again. Every vector is posted
to its nearest centroid and, if it lies near a boundary, to further ones up to `replicas`. Centroids are looked up by a
beam search of an in-memory neighbour graph, when vectors are posted as well as when queries choose lists; a query reads the
lists of its beam whose centroid is at most `ratio` times as far as its nearest one. Beam and ratio are those that read the
fewest lists while the share `recall` of the true neighbours of TRIALS vectors is read; these neighbours are found by comparing
the few with all entries. What a query reads is scored in double precision.

Neighbouring lists make up a group, and a group goes to one task, so a vector posted to several of its lists moves once and
a query gets its best k + 1 entries of all the group's lists. Queries read their nearest FIRST lists before the others; the
k + 1st score found there is a bound below which the other groups return nothing, so the rows that leave the tasks are
in proportion to the queries, not to the lists they read. Groups with many entries or queries are cut into pieces for different tasks.

Equal vectors are one entry with their k + 1 smallest ids (more can't be among the k nearest), and equal queries are
searched once, so a group of copies of any size costs one entry. Queries that found fewer than k are searched again in all lists.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than most vectors have (of equally many, the longest), nor those whose squared length is beyond a double; rows that repeat
an id and a vector count once; a null vec_id takes no part; ties go to the smaller vec_id; with fewer candidates than k all
are returned; an empty table gives no rows. Other columns are ignored. Components are read as they are stored, floats or doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tarnwatch.plans.freeze import freeze

PIECE = 1 << 16             # entries of a group that one task scores
QUERIES = 1 << 13           # queries of a group that one task serves
FIRST = 8                   # lists that a query reads before it has a bound
GROUP = 64                  # lists of a group, on average
TRIALS = 256                # vectors of the sample by which beam and ratio are chosen
POSTING_BEAM = 48           # beam by which entries look for their lists
MERGE = 1 << 21             # scores a task holds before it cuts them to k + 1 a query


@dataclass
class Centroids:
    points: np.ndarray          # with the added component
    group: np.ndarray           # group of each centroid
    graph: np.ndarray           # neighbours of each centroid
    entries: np.ndarray         # where a search begins
    largest: float              # squared length that every vector is brought to
    ratio: float = 2.0
    beam: int = 64

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest centroids of each row that the graph leads to, and their distances; both in order. A place for
        which the graph found no centroid has an infinite distance."""
        if len(x) > 512:        # a few rows at a time: the search remembers per row which centroids it saw
            parts = [self.nearest(x[i:i + 512], beam) for i in range(0, len(x), 512)]
            return np.concatenate([o for o, _ in parts]), np.concatenate([f for _, f in parts])
        n, k = len(x), len(self.points)
        if beam >= k:
            far = _distances(x, self.points)
            order = np.argsort(far, 1, kind="stable")
            return order, np.take_along_axis(far, order, 1)
        ids = np.tile(self.entries, (n, 1))
        far = _distances(x, self.points[self.entries])
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        opened = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(far, 1, kind="stable")[:, :beam]
            ids, far, opened = (np.take_along_axis(z, order, 1) for z in (ids, far, opened))
            closed = ~opened & np.isfinite(far)
            row, at = np.nonzero(closed & (np.cumsum(closed, 1) <= 4))
            if not len(row):
                return ids, far
            opened[row, at] = True
            reached = np.unique((row[:, None] * k + self.graph[ids[row, at]]).ravel())
            reached = reached[~seen.ravel()[reached]]
            seen.ravel()[reached] = True
            who, which = reached // k, reached % k
            count = np.bincount(who, minlength=n)
            place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            more = np.zeros((n, count.max(initial=0)), ids.dtype)
            distance = np.full(more.shape, np.inf)
            more[who, place] = which
            distance[who, place] = np.sqrt(((x[who] - self.points[which]) ** 2).sum(1))
            ids, far = np.concatenate((ids, more), 1), np.concatenate((far, distance), 1)
            opened = np.concatenate((opened, np.zeros(more.shape, bool)), 1)

    def posted(self, x: np.ndarray, replicas: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
        """The lists of each entry, and which of the places hold one."""
        order, far = self.nearest(x, max(replicas, POSTING_BEAM))
        order, far = order[:, :replicas], far[:, :replicas]
        return order, np.isfinite(far) & (far <= spread * far[:, :1])

    def read(self, x: np.ndarray, beam: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """The lists of each query, nearest first, and which of the places are read."""
        order, far = self.nearest(x, beam)
        return order, np.isfinite(far) & (far <= ratio * self.nearest_distance(far))

    def nearest_distance(self, far: np.ndarray) -> np.ndarray:
        return np.maximum(far[:, :1], 1e-6 * np.sqrt(self.largest))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _own(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, some rows at a time."""
    half = (centers * centers).sum(1) / 2
    parts = [(x[i:i + 2048] @ centers.T - half).argmax(1) for i in range(0, len(x), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with a component that brings all to the same length."""
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))))


def _means(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _own(x, centers)
        size = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], np.searchsorted(own[order], full))
        centers = centers.copy()
        centers[full] = sums / size[full, None]
    return centers


def fit(sample: np.ndarray, largest: float, lists: int) -> Centroids:
    rng = np.random.default_rng(7)
    x = lifted(sample, largest)
    lists = max(1, min(lists, len(x) // 8))
    points = _means(x, lists, rng)
    for _ in range(4):      # clusters over twice their share are split
        own = _own(x, points)
        size = np.bincount(own, minlength=len(points))
        large = [c for c in np.flatnonzero(size > 2 * len(x) / lists) if len(np.unique(x[own == c], axis=0)) > 1]
        if not large:
            break
        parts = [_means(x[own == c], min(2, int(size[c])), rng, 4) for c in large]
        points = np.concatenate([np.delete(points, large, 0), *parts])
    between = _distances(points, points).astype(np.float32)
    graph = np.argsort(between, 1, kind="stable")[:, 1:17].astype(np.int32) if len(points) > 1 else np.zeros((1, 1), np.int32)
    # As many of those that it is near to: a centroid in nobody's list would never be found.
    to, at = graph.ravel(), np.repeat(np.arange(len(graph), dtype=np.int32), graph.shape[1])
    order = np.lexsort((between[at, to], to))
    turn = np.arange(len(to)) - np.searchsorted(to[order], to[order])
    back = np.tile(np.arange(len(graph), dtype=np.int32)[:, None], (1, graph.shape[1]))
    first = turn < graph.shape[1]
    back[to[order][first], turn[first]] = at[order][first]
    graph = np.concatenate((graph, back), 1)
    entries = rng.choice(len(points), min(len(points), 5 * int(np.ceil(np.sqrt(len(points))))), replace=False)
    group = _own(points, _means(points, -(-len(points) // GROUP), rng))
    return Centroids(points, group, graph, np.sort(entries), largest)


def tune(found: Centroids, asked: np.ndarray, near: list[np.ndarray], recall: float, replicas: int, spread: float):
    """Sets the beam and the ratio that read the fewest lists, of those by which the share `recall` of the true neighbours
    (vectors, one array per asked vector) is read."""
    of = np.repeat(np.arange(len(near)), [len(x) for x in near])
    if not len(of):
        found.ratio, found.beam = np.inf, len(found.points)
        return
    lists, held = found.posted(lifted(np.concatenate(near), found.largest), replicas, spread)
    beam, asked = 256, lifted(asked, 0.0)
    while True:
        order, far = found.nearest(asked, beam)
        relative = far / found.nearest_distance(far)
        place = np.full((len(asked), len(found.points)), order.shape[1])
        row, at = np.nonzero(np.isfinite(far))
        place[row, order[row, at]] = at
        needed = np.where(held, place[of[:, None], lists], order.shape[1]).min(1)       # place of the list that holds it
        if beam >= len(found.points) or (needed < order.shape[1]).mean() >= recall + 0.5 * (1 - recall):
            break
        beam *= 2
    reached = needed < order.shape[1]
    ratio = np.where(reached, relative[of, np.minimum(needed, order.shape[1] - 1)], np.inf)
    best = None
    for width in np.unique((1.15 ** np.arange(0, 1 + np.log(order.shape[1]) / np.log(1.15))).astype(int).clip(1, order.shape[1])):
        limit = float(np.quantile(np.where(needed < width, ratio, np.inf), recall, method="higher")) * (1 + 1e-9)
        if np.isfinite(limit):
            reads = (relative[:, :width] <= limit).sum(1).mean()
            if best is None or reads < best[0]:
                best = reads, int(width), limit
    _, found.beam, found.ratio = best or (0, len(found.points), np.inf)


def _true_neighbours(entries: DataFrame, asked: np.ndarray, dim: int, dtype, k: int) -> list[np.ndarray]:
    """The k nearest entries of each of a few vectors, by comparing all; vectors equal to the asked one don't count."""
    shared = entries.sparkSession.sparkContext.broadcast(asked)
    names = [x.tobytes() for x in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value.astype(np.float64)
        top, vectors = np.full((len(q), k), -np.inf), np.zeros((len(q), k, dim), dtype)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                x = _matrix(batch.column("vector").slice(start, 2048), dim, dtype)
                s = q @ x.T
                same = {v.as_py(): i for i, v in enumerate(batch.column("vector").slice(start, 2048))}
                for i, name in enumerate(names):
                    if name in same:
                        s[i, same[name]] = -np.inf
                s = np.concatenate((top, s), 1)
                at = np.argsort(-s, 1, kind="stable")[:, :k]
                top = np.take_along_axis(s, at, 1)
                old = np.take_along_axis(vectors, np.minimum(at, k - 1)[:, :, None], 1)
                vectors = np.where((at < k)[:, :, None], old, x[np.maximum(at - k, 0)])
        row, at = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(top[row, at]),
                                          pa.array([vectors[r, c].tobytes() for r, c in zip(row, at)], pa.binary())], ["query", "score", "vector"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vector")
    found = entries.select("vector").mapInArrow(run, "query int, score double, vector binary").withColumn(
        "r", F.row_number().over(best)).where(F.col("r") <= k).select("query", "vector").toArrow()
    query, x = found.column("query").to_numpy(), _matrix(found.column("vector"), dim, dtype)
    return [x[query == i] for i in range(len(asked))]


def _clean(dtype):
    """vec_id, dimension, squared length and bytes of vectors that are whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").cast(pa.large_list(pa.from_numpy_dtype(dtype)))
            offsets, values = vectors.offsets.to_numpy(), vectors.values
            flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            absent = vectors.is_null().to_numpy(zero_copy_only=False) | batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            keep, out, size, norm = [], [], [], []
            for row in np.flatnonzero(~absent):
                v = flat[offsets[row]:offsets[row + 1]]
                length = float(v.astype(np.float64) @ v) if len(v) else 0.0
                if np.isfinite(length) and length > 0:
                    keep.append(row)
                    out.append((v + v.dtype.type(0)).tobytes())
                    size.append(len(v))
                    norm.append(length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()).take(pa.array(keep, pa.int64())), pa.array(size, pa.int32()),
                 pa.array(norm, pa.float64()), pa.array(out, pa.binary())], ["vec_id", "dim", "norm", "vector"])
    return run


def _matrix(column, dim: int, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]
    return np.stack(parts) if parts else np.zeros((0, dim), dtype)


def _by_group(group: np.ndarray, order: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, group and lists of every (row, group) that holds chosen places."""
    row, at = np.nonzero(chosen)
    lists = order[row, at]
    of = group[lists]
    turn = np.lexsort((lists, of, row))
    row, of, lists = row[turn], of[turn], lists[turn]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (of[1:] != of[:-1]))))
    cuts = pa.array(np.append(starts, len(row)).astype(np.int32))
    return row[starts], of[starts], pa.ListArray.from_arrays(cuts, pa.array(lists.astype(np.int32)))


def _post(shared, dim: int, dtype, replicas: int, spread: float):
    """Every entry once per group that holds some of its lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                order, held = found.posted(lifted(_matrix(part.column("vector"), dim, dtype), found.largest), replicas, spread)
                row, group, lists = _by_group(found.group, order, held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.astype(np.int32)), lists, *(part.column(c).take(pa.array(row)) for c in ("key", "first", "vector"))],
                    ["grp", "lists", "key", "first", "vector"])
    return run


def _ask(shared, dim: int, dtype, whole: bool):
    """Every query once per turn (0: its nearest lists) and group that holds some of the lists it reads; with `whole` all lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        beam, ratio = (len(found.points), np.inf) if whole else (found.beam, found.ratio)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                order, wanted = found.read(lifted(_matrix(part.column("vector"), dim, dtype), 0.0), beam, ratio)
                near = np.arange(order.shape[1]) < FIRST
                for turn, chosen in enumerate((wanted & near, wanted & ~near)):
                    row, group, lists = _by_group(found.group, order, chosen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), turn, np.int32)), pa.array(group.astype(np.int32)), lists,
                         *(part.column(c).take(pa.array(row)) for c in ("key", "vector"))], ["turn", "grp", "lists", "key", "vector"])
    return run


FOUND = "query long, key long, first long, score double"


def _places(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold which list: the lists, where each begins, and rows in order of lists."""
    column = column.combine_chunks()
    lists = column.flatten().to_numpy()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    order = np.argsort(lists, kind="stable")
    names, starts = np.unique(lists[order], return_index=True)
    return names, np.append(starts, len(rows)), rows[order]


def _score(dim: int, dtype, k: int):
    """The best k + 1 entries of each query among the lists that it reads here, those at its bound or above."""
    def run(key, entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "first": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        x, q = (_matrix(t.column("vector"), dim, dtype).astype(np.float64) for t in (entries, queries))
        first, bound = entries.column("first").to_numpy(), queries.column("bound").to_numpy()
        names, starts, rows = _places(entries.column("lists"))
        asked, asked_at, askers = _places(queries.column("lists"))
        pairs, held = [], 0

        def best() -> np.ndarray:
            # One of each pair, with the score that does not depend on how scores were taken together; ties go to the smaller id.
            pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            a, b = pair // len(x), pair % len(x)
            exact = np.concatenate([(q[a[i:i + 4096]] * x[b[i:i + 4096]]).sum(1) for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0)
            order = np.lexsort((first[b], -exact, a))
            place = np.arange(len(a)) - np.searchsorted(a[order], a[order])
            kept = order[place <= k]
            return pair[kept], exact[kept]

        for at in np.flatnonzero(np.isin(names, asked)):
            e = rows[starts[at]:starts[at + 1]]
            j = np.searchsorted(asked, names[at])
            who = askers[asked_at[j]:asked_at[j + 1]]
            for i in range(0, len(who), 256):
                w = who[i:i + 256]
                s = q[w] @ x[e].T
                border = bound[w]
                if s.shape[1] > k + 1:
                    border = np.maximum(border, np.partition(s, -k - 1, 1)[:, -k - 1])
                # Everything within rounding of the border stays, so ties are decided by ids.
                slack = 1e-12 * np.maximum(1.0, np.abs(np.where(np.isfinite(border), border, 0.0)))
                r, c = np.nonzero(s >= (border - slack)[:, None])
                pairs.append(w[r] * np.int64(len(x)) + e[c])
                held += len(r)
                if held > MERGE:
                    pairs = [best()[0]]
                    held = len(pairs[0])
        pair, exact = best()
        a, b = pair // len(x), pair % len(x)
        return pa.table({"query": queries.column("key").to_numpy()[a], "key": entries.column("key").to_numpy()[b], "first": first[b],
                         "score": exact})
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = 20_000, list_size: int = 20, replicas: int = 4,
           spread: float = 1.1, recall: float = 0.93) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of every query (rows where is_query holds), without the query's own id.
    vectors: vec_id, embedding. sample bounds the fit, and an eighth of it the number of lists; every vector is posted."""
    spark = vectors.sparkSession
    dtype = np.float32 if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), True) else np.float64
    rows = freeze(vectors.select("vec_id", "embedding").mapInArrow(_clean(dtype), "vec_id long, dim int, norm double, vector binary"), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, n, largest = common
    rows = rows.where(F.col("dim") == dim).select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(3), "vector").alias("h2")).distinct()

    # Entries: each distinct vector with its smallest ids, named by the smallest.
    turn = Window.partitionBy("h1", "h2").orderBy("vec_id")
    firsts = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k + 1)
    entries = freeze(firsts.groupBy("h1", "h2").agg(
        F.min(F.struct("vec_id", "vector")).alias("m"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.xxhash64("h1", "h2").alias("key"), "h1", "h2", F.col("m.vector").alias("vector"), "ids",
                F.col("m.vec_id").alias("first")), "entries")
    asked = freeze(rows.where(is_query).select("vec_id", F.xxhash64("h1", "h2").alias("key")), "queries")
    queries = freeze(entries.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vector"), "query_vectors")

    draw = F.pmod(F.col("key"), F.lit(1_000_000)) < int(1e6 * min(1, 0.95 * sample / n))
    fitted = _matrix(entries.where(draw).select("vector").toArrow().column("vector"), dim, dtype)
    if not len(fitted):
        fitted = _matrix(entries.select("vector").limit(1).toArrow().column("vector"), dim, dtype)
    found = fit(fitted, largest, n // list_size)
    trial = fitted[np.random.default_rng(8).choice(len(fitted), min(len(fitted), TRIALS), replace=False)]
    tune(found, trial, _true_neighbours(entries, trial, dim, dtype, k), recall, replicas, spread)
    shared = spark.sparkContext.broadcast(found)

    posted = freeze(entries.select("key", "first", "vector").mapInArrow(
        _post(shared, dim, dtype, replicas, spread), "grp int, lists array<int>, key long, first long, vector binary"), "postings")
    nearest = _nearest(posted, queries, shared, dim, dtype, k, False)
    best = freeze(_ranked(nearest, entries, asked, k), "neighbours")
    if found.beam < len(found.points) or np.isfinite(found.ratio):
        counts = best.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("n"))
        few = asked.join(counts, (asked["vec_id"] == counts["query_id"]) & (asked["key"] == counts["key"]), "left").where(
            F.coalesce("n", F.lit(0)) < min(k, n - 1)).select(asked["vec_id"], asked["key"])
        few = freeze(few, "short_queries")
        if not few.isEmpty():
            again = queries.join(few.select("key").distinct(), "key", "left_semi")
            more = _ranked(_nearest(posted, again, shared, dim, dtype, k, True), entries, few, k)
            best = best.join(few.select(F.col("vec_id").alias("query_id"), "key"), ["query_id", "key"], "left_anti").unionByName(more)
    return best.select("query_id", "rank", "vec_id", "score")


def _nearest(posted: DataFrame, queries: DataFrame, shared, dim: int, dtype, k: int, whole: bool) -> DataFrame:
    """(query, key, first, score) of the k + 1 best entries of each query in the lists that it reads."""
    reads = freeze(queries.mapInArrow(_ask(shared, dim, dtype, whole), "turn int, grp int, lists array<int>, key long, vector binary"), "reads")
    near = _scored(posted, reads.where("turn = 0").withColumn("bound", F.lit(float("-inf"))), dim, dtype, k)
    near = freeze(_best(near, k), "nearest_lists")
    bounds = near.groupBy("query").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    rest = reads.where("turn = 1").join(bounds.select(F.col("query").alias("key"), "low"), "key", "left").withColumn(
        "bound", F.coalesce("low", F.lit(float("-inf")))).drop("low")
    return _best(near.unionByName(_scored(posted, rest, dim, dtype, k)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best entries of each query; an entry in lists of several groups comes from each of them, and counts once."""
    top = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    return found.distinct().withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")


def _scored(posted: DataFrame, reads: DataFrame, dim: int, dtype, k: int) -> DataFrame:
    """The best entries of each query from every piece of a group that it reads."""
    pieces = posted.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    parts = reads.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    cuts = freeze(pieces.join(parts, "grp"), "group_cuts")
    own = posted.join(cuts, "grp").select(
        "grp", "lists", "key", "first", "vector", F.pmod("key", "pieces").cast("int").alias("piece"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    ask = reads.join(cuts, "grp").select(
        "grp", "lists", "key", "vector", "bound", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
        F.pmod("key", "parts").cast("int").alias("part"))
    by = ("grp", "piece", "part")
    return own.groupBy(*by).cogroup(ask.groupBy(*by)).applyInArrow(_score(dim, dtype, k), FOUND)


def _ranked(found: DataFrame, entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each asked row: entries first (k + 1 of them are enough), then their ids."""
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rows = found.join(entries.select("key", "ids"), "key")
    rows = (rows.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1))
    rows = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    out = asked.withColumnRenamed("vec_id", "query_id").join(rows, asked["key"] == rows["query"])
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", "key", F.posexplode(own).alias("at", "x")).select(
        "query_id", "key", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
