"""N-gram Jaccard join by parity sketches.

A document's set of 5-word shingles is XOR-hashed into a sketch of m cells of 64 bits. A shingle that only one of two
documents has changes one cell, so the number of cells that differ (the Hamming distance of the sketches, cell by cell) never
exceeds the symmetric difference D of the sets, and D <= (|A| + |B|) / 7 is the same as a Jaccard similarity of 0.75 or more.
Size bands fix m. By the pigeonhole principle, of the first D + 1 + q filled cells two similar documents agree in 1 + q at
least; these cells are joined, and pairs are counted by cells. Cells are ranges of the hash, so a document sorts its shingles
once and reads off its cells.

A document takes part in the band of its own size and in the next one, if a partner may be in it. Dropping a fixed set of
shingles from all sketches keeps the bound, so shingles that very many documents share stay out of them (they'd fill cells
alone); a document left with fewer filled cells than the bound asks for also joins by a second sketch over all its
shingles, and by its smallest shingles if that is too short as well. If one of two partners has enough cells in a sketch, the
pair meets there, so nothing is lost. Which shingles are left out changes the plan, never the result.

Documents with equal sets are one vertex from the start. In a bucket of agreeing cells each document is first compared with
the smallest one only. After the components of these links are known, buckets are read as sets of components: two
components that share too few cells can't hold a link; for the others, the members of the smaller one are held against the
members of the larger one by a second, bit-wise parity sketch, whose Hamming distance bounds D as well, and only the pairs
within the bound are verified. Documents that meet in the second sketch (large groups of copies, and texts made of common
passages) are put into families by their buckets; a family is compared in blocks of texts, inside tasks, by the bit-wise sketch and
then the sets, and a block puts out only links that connect what wasn't connected yet. Links inside a component can't change
the classes, so no class is ever written as pairs. Every link is verified on the whole texts.

Defined results: a null text, or one without words, has an empty set and no links; with fewer than five words the whole
sequence is the one shingle; rows that share a doc_id are one vertex; a null doc_id is a vertex of its own (all such rows
together), with a null component_id unless it is linked; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarnwatch.llm import textkit as tk
from tarnwatch.llm.batches import small_batches
from tarnwatch.llm.exprs import components, partitions
from tarnwatch.llm.spread import lookup
from tarnwatch.plans.freeze import freeze

NO_ID = -(2**63)
HOT_SHINGLES = 400_000      # most shingles that are left out of sketches: 8 bytes each in every task
LEAST_HOT = 16              # documents that share a shingle before it may be left out, in small tables
HOT_PER = 250_000           # in larger ones, a document for every so many shingles of the table
CHUNK = 1_500_000           # cells a task holds before it hands them on
BLOCK = 400_000             # shingles of a block of a family
FILTER_WORDS = 1 << 20      # words of 63 bits in the filter that tells which texts candidates need


def _bands() -> list[int]:
    out = [1]
    while out[-1] < 2**40:
        out.append(out[-1] * 16 // 9 + 1)
    return out


BANDS = np.array(_bands())


def set_digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell one set from another."""
    a, b = tk.mixed(found), tk.mixed(found ^ np.uint64(0x5851F42D4C957F2D))
    return (int(a.sum().astype(np.int64)), int(b.sum().astype(np.int64))) if len(found) else (0, 0)


def margin(n: int) -> int:
    """Cells beyond the first that two similar documents share at least, if the smaller has n shingles."""
    return n // 16


def bits_of(found: np.ndarray) -> bytes:
    """Parity sketch of single bits, four or more a shingle (a power of two, so a longer one folds to a shorter one)."""
    if not len(found):
        return b""
    size = 1 << max(6, int(4 * len(found) - 1).bit_length())
    odd = np.bincount((tk.mixed(found ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def cells(found: np.ndarray, m: int, need: int, tag: int) -> tuple[np.ndarray, bool]:
    """Keys of the first `need` filled cells of the sketch of m cells, and whether there are as many."""
    if not len(found):
        return np.zeros(0, np.uint64), False
    cell = ((found >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    enough = len(starts) >= need
    parity = np.bitwise_xor.reduceat(tk.mixed(found), starts)[:need]
    return tk.mixed(parity ^ tk.mixed(cell[starts[:need]] + np.uint64(tag))), enough


def cell_keys(found: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key by which a document with this set of shingles meets its partners: of the first sketch, and of the others."""
    n, out, more = len(found), [], [np.zeros(0, np.uint64)]
    rare = found
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        rare = found[hot[at] != found]
    own = int(np.searchsorted(BANDS, n, "right")) - 1
    last = int(np.searchsorted(BANDS, n * 4 // 3, "right")) - 1
    for band in range(own, last + 1):
        largest = int(BANDS[band + 1]) - 1
        need = (n + min(n * 4 // 3, largest)) // 7 + 1 + margin(n)
        tag = band << 48
        got, enough = cells(rare, 2 * largest // 5 + 1, need, tag)
        out.append(got)
        if not enough:
            got, enough = cells(found, largest * 3 // 4 + 1, need, tag + (1 << 56))
            more.append(got)
        if not enough:
            more.append(tk.mixed(found[:need] + np.uint64(tag + (2 << 56))))
    return np.concatenate(out), np.concatenate(more)


FIRST_SCHEMA = "kind int, a long, b long, c long, d long"


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _rows(kind: int, *columns) -> pa.RecordBatch:
    columns = [np.asarray(c).astype(np.int64, copy=False) for c in columns]
    n = len(columns[0])
    columns += [np.zeros(n, np.int64)] * (4 - len(columns))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), *map(pa.array, columns)], ["kind", "a", "b", "c", "d"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: doc_id, size and digest of every document; kind 1: shingles that several documents of a chunk share."""
    held, held_n = [], 0
    for batch in batches:
        ids, sizes, digests = _ids(batch), np.zeros(len(batch), np.int64), np.zeros((len(batch), 2), np.int64)
        for row, found in tk.shingle_sets(batch.column("text")):
            sizes[row], digests[row] = len(found), set_digest(found)
            held.append(found)
            held_n += len(found)
            if held_n >= CHUNK * 2:
                yield _shared(held)
                held, held_n = [], 0
        yield _rows(0, ids, sizes, digests[:, 0], digests[:, 1])
    if held:
        yield _shared(held)


def _shared(held: list[np.ndarray]) -> pa.RecordBatch:
    found, counts = np.unique(np.concatenate(held), return_counts=True)
    keep = counts >= 3
    return _rows(1, found[keep].view(np.int64), counts[keep])


def _hot(described: DataFrame) -> np.ndarray:
    """The shingles found in most documents, HOT_SHINGLES of them at most, sorted.

    A shingle has to have its share of the table, so that every chunk of it shows the shingle. What a fixed number of copies share
    would be seen in small tables only, and there would be more of it than any list holds in large ones: it stays in sketches."""
    total = described.where("kind = 0").agg(F.sum("b")).first()[0] or 0
    counts = described.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= max(LEAST_HOT, total // HOT_PER))
    counts = freeze(counts, "frequent_shingles")
    levels = counts.groupBy(F.floor(F.log2("n") * 4).alias("level")).count().orderBy(F.desc("level")).collect()
    total, floor = 0, None
    for row in levels:
        total += row["count"]
        if total > HOT_SHINGLES:
            break
        floor = row["level"]
    if floor is None:
        return np.zeros(0, np.uint64)
    hot = counts.where(F.floor(F.log2("n") * 4) >= floor).select("a").toPandas()["a"]
    return np.sort(hot.to_numpy(np.int64).view(np.uint64))


def _emit(hot, groups: int):
    """Keys of every distinct set; those of the first sketch go to parts below `groups`, the others to an eighth as many behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), 0
        keys, ids = ([], []), ([], [])
        for batch in batches:
            own = _ids(batch)
            for row, found in tk.shingle_sets(batch.column("text")):
                if len(found) < 3 or (digest := set_digest(found)) in seen:     # smaller sets link with equal ones only
                    continue
                seen.add(digest)
                for k, got in enumerate(cell_keys(found, hot.value)):
                    keys[k].append(got)
                    ids[k].append(np.full(len(got), own[row]))
                    held += len(got)
                if held >= CHUNK:
                    yield from _both(keys, ids, groups)
                    keys, ids, held = ([], []), ([], []), 0
        if held:
            yield from _both(keys, ids, groups)
    return run


def _both(keys, ids, groups: int) -> Iterator[pa.RecordBatch]:
    for k, (first, count) in enumerate(((0, groups), (groups, max(1, groups // 8)))):
        if sum(map(len, keys[k])):
            yield _packed(keys[k], ids[k], first, count)


def _packed(keys: list[np.ndarray], ids: list[np.ndarray], first: int, groups: int) -> pa.RecordBatch:
    """One row per group of keys: 48 bits of every key, and the documents."""
    key, doc = np.concatenate(keys), np.concatenate(ids)
    group = ((key >> np.uint64(48)) % np.uint64(groups)).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    key, doc, group = key[order], doc[order], group[order]
    cuts = np.searchsorted(group, np.arange(groups + 1))
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    low = key.view(np.uint8).reshape(-1, 8)[:, :6]
    return pa.RecordBatch.from_arrays(
        [pa.array((full + first).astype(np.int32)), pa.array([low[cuts[g]:cuts[g + 1]].tobytes() for g in full], pa.binary()),
         pa.array([doc[cuts[g]:cuts[g + 1]].tobytes() for g in full], pa.binary())], ["part", "keys", "docs"])


def _meet(groups: int):
    return lambda table: _met(table, table.column("part")[0].as_py() >= groups)


def _met(table: pa.Table, second: bool) -> pa.Table:
    """kind 0: (a, b, cells) of a bucket's first document with each other one; kind 1: (bucket, document, cells, first document) of
    buckets of three or more; kind 2: as kind 0, of buckets of two. Buckets of equal documents are one, with the number of cells.
    kind 3: (a, b) of the second sketch: the smallest document of those that a part's buckets connect, with each other one."""
    low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("keys")]).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    key, doc = wide.view(np.uint64).ravel(), np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("docs")])
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    same = np.concatenate(([False], key[1:] == key[:-1], [False]))
    shared = same[1:] | same[:-1]
    key, doc = key[shared], doc[shared]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    if not len(key):
        return pa.Table.from_batches([_rows(0, np.zeros(0))])
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    name = np.add.reduceat(tk.mixed(doc.view(np.uint64)), starts) + sizes.astype(np.uint64)
    _, once, times = np.unique(name, return_index=True, return_counts=True)
    count = np.zeros(len(starts), np.int64)
    count[once] = times
    count[sizes < 2] = 0
    rows = np.repeat(count > 0, sizes)
    first, cells_, size = np.repeat(doc[starts], sizes), np.repeat(count, sizes), np.repeat(sizes, sizes)
    if second:
        return pa.Table.from_batches([_rows(3, *_under_least(first[rows], doc[rows]))])
    out = []
    for kind, chosen in ((0, rows & (first != doc) & (size > 2)), (2, rows & (first != doc) & (size == 2))):
        pair, number = np.unique(np.stack([first[chosen], doc[chosen]]), axis=1, return_inverse=True)
        out.append(_rows(kind, *pair, np.bincount(number.ravel(), cells_[chosen], pair.shape[1])))
    large = rows & (size > 2)
    out.append(_rows(1, np.repeat(name, sizes)[large].view(np.int64), doc[large], cells_[large], first[large]))
    return pa.Table.from_batches(out)


def _under_least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, other) for every id that the edges (a, b) connect with a smaller one: as many rows as ids at most."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    root, before = np.arange(len(ids)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(before[left], before[right])
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[other]], ids[other]


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_WORDS * 63))


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in pairs. A filter of fixed size (8 MB) leaves out most others before anything moves;
    those it lets through without need are dropped by the join with the pairs."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    bits = ids.select(_bit("id").alias("bit")).groupBy(F.floor(F.col("bit") / 63).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 as int))")).alias("bits")).toPandas()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            hit = (shared.value[bit // 63] >> (bit % 63)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select(["doc_id", "text"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows = rows.withColumn("bit", _bit("doc_id")).mapInArrow(wanted, "doc_id long, text string")
    return freeze(rows, "candidate_texts")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        right = {}
        keep = np.zeros(len(batch), bool)
        other = batch.column("text_b")
        lefts = tk.shingle_sets(batch.column("text_a"))
        for (row, a), (_, b) in zip(lefts, tk.shingle_sets(other)):
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[row] = both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b of doc_id) whose whole texts are similar."""
    pairs = freeze(pairs, "candidates")
    texts = _texts(docs, pairs)
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch at `size` bytes."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of docs (doc_id, text). n_links counts the verified links of
    the document's set; it is enough to connect its class, and zero only where there are no links to other sets.

    Rows of one doc_id are one document. A row without doc_id is one of its own, so unlike texts without doc_id are
    not connected through it; its class has the smallest doc_id there is, or none."""
    docs = docs.select("doc_id", "text")
    if docs.where("doc_id is null").isEmpty():
        return _classes(docs)
    rows = freeze(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "numbered_texts")
    found = _classes(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    found = freeze(rows.select("_row", "doc_id").join(found, "_row"), "row_classes")
    known = found.where("doc_id is not null")
    least = known.groupBy("doc_id").agg(F.min("component_id").alias("b"))
    merged = components(known.join(least, "doc_id").select(F.col("component_id").alias("a"), "b"), "classes_of_id")
    found = lookup(found, merged.select(F.col("node").alias("component_id"), F.col("component").alias("to")), ["component_id"], F.col("_row"))
    found = found.withColumn("component_id", F.coalesce("to", "component_id"))
    named = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return lookup(found, named, ["component_id"], F.col("_row")).select(
        "doc_id", "n_shingles", F.col("least").alias("component_id"), "n_links")


def _classes(docs: DataFrame) -> DataFrame:
    """The same, of rows that all have a doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    described = freeze(docs.mapInArrow(_describe, FIRST_SCHEMA), "shingle_sets")
    sets = described.where("kind = 0").select(
        F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("h1"), F.col("d").alias("h2"))
    firsts = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    reps = freeze(sets.where("n > 0").join(firsts, ["n", "h1", "h2"]).select("id", "rep", "n").distinct(), "set_classes")

    groups = min(4 * partitions(spark), 1 << 15)
    hot = spark.sparkContext.broadcast(_hot(described))
    packed = docs.mapInArrow(_emit(hot, groups), "part int, keys binary, docs binary")
    met = freeze(packed.groupBy("part").applyInArrow(_meet(groups), FIRST_SCHEMA), "met")

    stars = met.where("kind in (0, 2)").groupBy("a", "b").agg(F.sum("c").alias("cells"))
    stars = freeze(_of_sets(stars, reps), "stars")
    # Any pairs would do here: what this first round misses is found below.
    first = freeze(stars.where("8 * cells >= 1 + least(na, nb) div 16").select("a", "b"), "first_pairs")
    links = freeze(verified(docs, first), "first_links")
    same = reps.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    label = freeze(components(links.select("a", "b").unionByName(same)), "first_labels")

    edges = met.where("kind = 3").select("a", "b").unionByName(_across(met, reps, label))
    links = links.unionByName(freeze(_in_families(docs, edges, reps, label), "family_links")).select("a", "b").distinct()
    label = freeze(components(links.unionByName(same)), "labels")
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    counts = reps.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("id", "rep"), "rep").select("id", "links")
    counts = counts.groupBy("id").agg(F.max("links").alias("links"))
    out = (sets.join(label.select(F.col("node").alias("id"), "component"), "id", "left").join(counts, "id", "left")
           .select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                   F.coalesce("component", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links")))
    return out.withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id")))


def _in_families(docs: DataFrame, edges: DataFrame, reps: DataFrame, label: DataFrame) -> DataFrame:
    """Links among the documents that edges (a, b) connect: as many as connect their classes, (a, b)."""
    of = reps.select(F.col("id").alias("i"), F.col("rep").alias("r"))
    # A family has the same smallest document in most parts, so few rows are left of one member.
    edges = edges.distinct().join(of.withColumnRenamed("i", "a").withColumnRenamed("r", "ra"), "a").join(
        of.withColumnRenamed("i", "b").withColumnRenamed("r", "rb"), "b")
    family = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "families")
    members = family.select(F.col("component").alias("family"), F.col("node").alias("rep")).join(
        reps.groupBy("rep").agg(F.max("n").alias("n")), "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    members = members.select("family", "rep", "n", F.coalesce("component", "rep").alias("label"))
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("pieces"),
                                          F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    members = freeze(members.join(sizes.select("family", "pieces"), "family"), "family_members")
    texts = _texts(docs, members.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    piece = F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")
    rows = members.withColumn("piece", piece).join(texts.withColumnRenamed("doc_id", "rep"), "rep").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("family", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "piece", "rep", "label", "text")
    return rows.groupBy("family", "p", "q").applyInArrow(_block_links, "a long, b long")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between two pieces of a family, or within one, that connect labels which nothing before connects."""
    table = table.combine_chunks()
    sets = [found for _, found in tk.shingle_sets(table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string()))]
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[k] for k in order]
    size = np.array([len(x) for x in sets], np.int64)
    ids, root, piece = (table.column(n).to_numpy()[order].copy() for n in ("rep", "label", "piece"))
    apart = table.num_rows > 0 and table.column("p")[0].as_py() != table.column("q")[0].as_py()
    bits = [np.frombuffer(bits_of(x), np.uint8) for x in sets]
    widths: dict[int, np.ndarray] = {}
    a, b = [], []
    for k in range(1, len(sets)):
        lo = int(np.searchsorted(size, -(-3 * size[k] // 4)))
        if lo >= k or not size[k]:
            continue
        width = len(bits[lo])
        if width not in widths:
            widths[width] = np.stack([_fold(x, width) if len(x) >= width else np.zeros(width, np.uint8) for x in bits]).view(np.uint64)
        open_ = root[lo:k] != root[k]
        if apart:
            open_ &= piece[lo:k] != piece[k]
        near = np.flatnonzero(open_) + lo
        distance = np.bitwise_count(widths[width][near] ^ widths[width][k]).sum(1).astype(np.int64)
        within = 7 * distance <= size[near] + size[k]
        for j in near[within][np.argsort(distance[within], kind="stable")]:
            if root[j] == root[k]:
                continue
            both = len(np.intersect1d(sets[j], sets[k], assume_unique=True))
            if 100 * both >= 75 * (size[j] + size[k] - both):
                a.append(min(ids[j], ids[k]))
                b.append(max(ids[j], ids[k]))
                root[root == root[j]] = root[k]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _able(agreed: DataFrame, twos: DataFrame, named: DataFrame) -> DataFrame:
    """id of the documents that agree with all others together in as many cells of the first sketch as with one similar document
    alone: that one has three quarters of the smallest set's shingles at least. What agrees by chance in a few cells falls out."""
    agreed = agreed.select("id", "cells").unionByName(twos.select(F.explode(F.array("a", "b")).alias("id"), "cells"))
    agreed = agreed.groupBy("id").agg(F.sum("cells").alias("cells"))
    return agreed.join(named.groupBy("id").agg(F.min("n").alias("n")), "id").where("cells >= 1 + ceil(3 * n / 4) div 16").select("id")


# Cells beyond the first that a document of n shingles shares at least with a similar one, which has three quarters of n or more.
SPARE = "(ceil(3 * {n} / 4) div 16)"
ROUNDS = 2      # times that documents without enough cells are left out; each makes more buckets those of one component


def _spare(named: DataFrame) -> DataFrame:
    return named.groupBy("id").agg(F.min("n").alias("n")).select("id", F.expr(SPARE.format(n="n")).alias("spare"))


def _mixed(rows: DataFrame) -> DataFrame:
    """bucket, wide: the buckets with documents of several components, and of how many."""
    return rows.groupBy("bucket").agg(F.countDistinct("label").alias("wide")).where("wide > 1")


def _sharing(rows: DataFrame, twos: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (bucket, id, label, cells) and pairs (a, b, p, q, cells) of documents that agree with documents of other components
    in as many cells as with one similar document alone. Copies agree with each other in all cells: those don't count here."""
    spare = freeze(_spare(named), "spare_cells")
    for _ in range(ROUNDS):
        rows = freeze(rows.join(_mixed(rows), "bucket", "left_semi"), "shared_buckets")
        agreed = rows.select("id", "cells").unionByName(twos.select(F.explode(F.array("a", "b")).alias("id"), "cells"))
        able = freeze(agreed.groupBy("id").agg(F.sum("cells").alias("cells")).join(spare, "id").where("cells > spare").select("id"), "sharing_sets")
        rows = rows.join(able, "id", "left_semi")
        twos = freeze(twos.join(able.withColumnRenamed("id", "a"), "a", "left_semi").join(
            able.withColumnRenamed("id", "b"), "b", "left_semi"), "shared_twos")
    return freeze(rows, "sharing_rows"), twos


def _rarer(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Every document's rows without those of its most mixed buckets, up to its spare cells (a prefix filter).

    Buckets have one order for all documents. What two similar ones drop of their common buckets are the first of these in that order,
    the larger spare at most, and they have a cell more in common: a bucket is left to both."""
    rows = rows.join(_mixed(rows), "bucket").join(_spare(named), "id")
    order = Window.partitionBy("id").orderBy(F.desc("wide"), "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("cells").over(order)).where("upto > spare").select("bucket", "id", "label", "cells")


def _across(met: DataFrame, reps: DataFrame, label: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all documents of different components that may be similar: a row for every member of a bucket,
    however many components meet there."""
    named = reps.join(label, F.col("rep") == F.col("node"), "left").select(
        "id", "rep", "n", F.coalesce("component", "rep").alias("label"))
    named = freeze(named, "labelled_sets")

    # A pair's cells lie in as many rows of met as parts hold them: they are summed up before anything is joined.
    twos = freeze(met.where("kind = 2").groupBy("a", "b").agg(F.sum("c").alias("cells")), "buckets_of_two")
    agreed = freeze(met.where("kind = 1").groupBy(F.col("a").alias("bucket"), F.col("b").alias("id"), F.col("d").alias("first")).agg(
        F.sum("c").alias("cells")), "buckets")
    of = freeze(named.select("id", "label").distinct().join(_able(agreed, twos, named), "id", "left_semi"), "able_sets")
    # Only buckets with a document outside the first one's component matter; the first documents' pairs tell which. Most buckets are
    # of copies that are one component by now, and are gone before their members meet labels.
    pairs = agreed.where("id <> first").select("first", "id").distinct()
    apart = pairs.join(of, "id").join(named.select(F.col("id").alias("first"), F.col("label").alias("own")).distinct(), "first").where(
        "label <> own").select("first", "id").distinct()
    unlike = agreed.join(apart, ["first", "id"], "left_semi").select("bucket").distinct()
    rows = agreed.join(unlike, "bucket", "left_semi").join(of, "id").select("bucket", "id", "label", "cells")
    twos = twos.join(of.select(F.col("id").alias("a"), F.col("label").alias("p")), "a").join(
        of.select(F.col("id").alias("b"), F.col("label").alias("q")), "b").where("p <> q")
    rows, twos = _sharing(freeze(rows, "unlike_buckets"), freeze(twos, "unlike_twos"), named)
    rows = freeze(_rarer(rows, named), "rare_buckets")
    firsts = rows.groupBy("bucket").agg(F.min("id").alias("a"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    stars = rows.join(firsts.select("bucket", "a"), "bucket").where("id <> a").select("a", F.col("id").alias("b"))
    return stars.unionByName(twos.select("a", "b")).distinct()


def _of_sets(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs between the first documents of their sets, those whose sizes allow a link, each once, with their cells and sizes."""
    left = reps.select(F.col("id").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    rows = pairs.join(left, "a").join(right, "b").where("ra <> rb and 4 * least(na, nb) >= 3 * greatest(na, nb)")
    return rows.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(
        F.max("cells").alias("cells"), F.min(F.least("na", "nb")).alias("na"), F.min(F.least("na", "nb")).alias("nb"))


# For small tables: all pairs that share a shingle.
CLASSES_SQL = r"""
WITH RECURSIVE toks AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM toks),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 75 * (na + nb - both_)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
lows AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.low, s.doc_id) AS component_id FROM sets s LEFT JOIN lows l ON l.a = s.doc_id"""
