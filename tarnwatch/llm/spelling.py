"""Spelling variants of the words of a corpus: which frequent words differ by one letter, and which of them is the form meant.

Every word is a vector of letter counts. One inserted or deleted letter moves the vector by 1 in L1 distance, a replaced one by 2, so
per pair of lengths (l, l) and (l, l + 1) only the words within 2 and 1 have to be looked at. They are found by K-d trees: a node
halves its words at a count of one letter, and a search leaves out each half whose box is too far away. Words that
are near enough are then compared letter by letter.

The tree has two levels. Its upper part, per length, is fitted on SAMPLE words (all words are searched, whatever the sample
says about the cuts) and deals the words into cells; a word is sent to every cell of its own and the next length that its
box distance allows. Each cell is one unit of work with a tree of its own; a cell with many more words than CELL is dealt over
several units. No pair leaves a unit: it gives per word the number of near words and the best one, which Spark then combines.

Counts of letters beyond a-z share 64 places by their code point, and counts stop at 255: both can only make vectors nearer, so
no pair is lost. Defined results: null or empty texts have no words; a null doc_id counts as an empty string in the draw
of deleted letters; repeated rows count again. Two words never differ by nothing, so a word isn't near itself. Ties of frequency
go to the smaller word in code point order. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.llm.exprs import ascii_lower, partitions
from tarnwatch.plans.freeze import freeze

LETTER = "[A-Za-zÀ-ÿ]"
PLACES = 26 + 64
SAMPLE = 50_000
CELL = 20_000
LEAF = 192
CHUNK = 1 << 20


def written_words(docs: DataFrame, every: int = 199, least_letters: int = 1) -> DataFrame:
    """word of every maximal run of at least so many letters, A-Z lower-cased. Where `every` divides the CRC-32 of
    `<doc_id>:<run>`, the letter at that number modulo the length is missing."""
    run = ascii_lower(F.col("run"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{LETTER}{{{least_letters},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def frequent_words(docs: DataFrame, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """word, n of every word of at least so many letters and occurrences."""
    words = written_words(docs, least_letters=least_letters).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, row by row and padded with 0, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def counts(points: np.ndarray) -> np.ndarray:
    """Vector of letter counts of every row."""
    rows, columns = np.nonzero(points)
    value = points[rows, columns].astype(np.int64)
    place = np.where((value >= 97) & (value <= 122), value - 97, 26 + value % 64)
    total = np.bincount(rows * PLACES + place, minlength=len(points) * PLACES)
    return np.minimum(total, 255).astype(np.uint8).reshape(len(points), PLACES)


def parities(vectors: np.ndarray) -> np.ndarray:
    """Letter counts as bits: the k-th of one letter flips a bit of its own out of 128. Two vectors differ in at least as many
    counts as their bits do, so the leaves of a tree can be compared by bits before words are."""
    rows, places = np.nonzero(vectors)
    out = np.zeros((len(vectors), 128), np.uint8)
    for k in range(int(vectors.max(initial=0))):
        more = vectors[rows, places] > k
        rows, places = rows[more], places[more]
        np.bitwise_xor.at(out, (rows, (places + 53 * k) % 128), 1)
    return np.packbits(out, axis=1).view(np.uint64)


class Tree:
    """K-d tree over letter counts. Inner nodes: letter, highest count on the low side; leaves: numbers from 0 on."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.nodes: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        waiting = [(np.arange(len(vectors)), None, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            if parent is not None:
                self.nodes[parent][2 + side] = len(self.nodes)
            cut = self._cut(vectors[rows]) if len(rows) > leaf else None
            if cut is None:
                self.nodes.append([-1, len(self.leaves), 0, 0])
                self.leaves.append(rows)
                continue
            letter, low = cut
            here, above = len(self.nodes), vectors[rows, letter] > low
            self.nodes.append([letter, low, 0, 0])
            waiting += [(rows[~above], here, 0), (rows[above], here, 1)]

    @staticmethod
    def _cut(vectors: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that halve the words best; None if all vectors are equal."""
        if (vectors == vectors[0]).all():
            return None
        best, half, top = None, len(vectors), int(vectors.max())
        for low in range(top):
            above = np.count_nonzero(vectors > low, axis=0)
            off = np.where((above == 0) | (above == len(vectors)), len(vectors), np.abs(2 * above - len(vectors)))
            if off.min() < half:
                best, half = (int(off.argmin()), low), off.min()
            elif above.max() * 4 < len(vectors):
                break
        return best

    def search(self, vectors: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of the vectors whose distance from its box is at most `reach`). The distance is summed up on the way
        down: a row pays for a letter what it is beyond the cuts, once."""
        waiting = [(0, np.arange(len(vectors)), np.zeros(len(vectors), np.int16), {})]
        while waiting:
            node, rows, spent, box = waiting.pop()
            letter, low, left, right = self.nodes[node]
            if letter < 0:
                yield low, rows
                continue
            value = vectors[rows, letter].astype(np.int16)
            bottom, top = box.get(letter, (0, 1 << 14))
            before = np.maximum(np.maximum(bottom - value, value - top), 0)
            for child, (b, t) in ((left, (bottom, min(top, low))), (right, (max(bottom, low + 1), top))):
                now = spent - before + np.maximum(np.maximum(b - value, value - t), 0)
                near = now <= reach
                if near.any():
                    waiting.append((child, rows[near], now[near], {**box, letter: (b, t)}))

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        out = np.zeros(len(vectors), np.int64)
        for leaf, rows in self.search(vectors, 0):
            out[rows] = leaf
        return out


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points of one length differ in exactly one place."""
    return np.count_nonzero(a != b, axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the long row is the short one with one more letter somewhere."""
    n = short.shape[1]
    ahead, behind = short != long[:, :n], short != long[:, 1:n + 1]
    first = np.where(ahead.any(1), ahead.argmax(1), n)
    last = np.where(behind.any(1), n - behind[:, ::-1].argmax(1), 0)
    return last <= first


def near_pairs(tree: Tree, points: np.ndarray, vectors: np.ndarray, asked: np.ndarray, asked_vectors: np.ndarray,
               longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row asked, row found) of words of one length that are one letter from the words of the tree: of the same length, or
    (longer) one letter shorter than those."""
    out, reach = [], 1 if longer else 2
    bits, asked_bits = parities(vectors), parities(asked_vectors)
    for leaf, rows in tree.search(asked_vectors, reach):
        members = tree.leaves[leaf]
        step = max(1, CHUNK // len(members))
        for k in range(0, len(rows), step):
            some = rows[k:k + step]
            away = sum(np.bitwise_count(asked_bits[some, None, side] ^ bits[None, members, side]) for side in range(2))
            q, m = np.nonzero(away <= reach)
            a, b = some[q], members[m]
            for j in range(0, len(a), CHUNK // 16):
                x, y = a[j:j + CHUNK // 16], b[j:j + CHUNK // 16]
                good = one_inserted(asked[x], points[y]) if longer else one_replaced(asked[x], points[y])
                out.append((x[good], y[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def upper_trees(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Tree]:
    """Per length, the upper part of the tree, cut on the `sample` words of least hash so that a cell gets some `cell` words."""
    total = words.count()
    some = [row[0] for row in words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()]
    leaf = max(8, int(cell * min(1.0, sample / max(total, 1))))
    out = {}
    for length in {len(w) for w in some}:
        points, _ = letters([w for w in some if len(w) == length])
        tree = Tree(counts(points), leaf)
        tree.leaves = [None] * len(tree.leaves)
        if len(tree.leaves) > 1:
            out[length] = tree
    return out


FOUND = "word string, n_near long, form_n long, form string"


def _search_cell(rows: pa.Table) -> pa.Table:
    """Per word of a unit: how many words of the other side it is near to, and the best of these."""
    kind, n = rows["kind"].to_numpy(), rows["n"].to_numpy()
    words = rows["word"].to_pylist()
    encoded = sorted(range(len(words)), key=lambda k: (-n[k], words[k].encode("utf-8", "surrogatepass")))
    words, n, kind = [words[k] for k in encoded], n[encoded], kind[encoded]
    points, lengths = letters(words)
    out = {"word": [], "n_near": [], "form_n": [], "form": []}

    def put(rows_of: np.ndarray, others: np.ndarray):
        number, best = np.bincount(rows_of, minlength=len(words)), np.full(len(words), len(words))
        np.minimum.at(best, rows_of, others)
        for k in np.flatnonzero(number):
            out["word"].append(words[k])
            out["n_near"].append(int(number[k]))
            out["form_n"].append(int(n[best[k]]))
            out["form"].append(words[best[k]])

    members = np.flatnonzero(kind == 0)
    if len(members):
        length = int(lengths[members[0]])
        mine = points[members][:, :length]
        vectors = counts(mine)
        tree = Tree(vectors, LEAF)
        for which, size in ((1, length), (2, length - 1)):
            asked = np.flatnonzero(kind == which)
            if not len(asked):
                continue
            theirs = points[asked][:, :size]
            a, b = near_pairs(tree, mine, vectors, theirs, counts(theirs), which == 2)
            a, b = asked[a], members[b]
            put(a, b)
            if which == 2:
                put(b, a)
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                     "form_n": pa.array(out["form_n"], pa.int64()), "form": pa.array(out["form"], pa.string())})


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, n_near, form_n, form (the near word of largest n) of every word of `words` (word, n; distinct) that has a near one."""
    trees = upper_trees(words, sample, cell)
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(trees)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = sent.value
        for batch in batches:
            found, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            points, lengths = letters(found)
            place, kind, row, size = [], [], [], []
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                vectors = counts(points[at][:, :length])
                for which, trunk, reach in ((0, length, 0), (1, length, 2), (2, length + 1, 1)):
                    tree = upper.get(int(trunk))
                    for leaf, some in tree.search(vectors, reach) if tree else [(0, np.arange(len(at)))]:
                        place.append(np.full(len(some), leaf))
                        kind.append(np.full(len(some), which))
                        size.append(np.full(len(some), trunk))
                        row.append(at[some])
            if row:
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32)),
                     pa.array(np.concatenate(kind).astype(np.int32)), batch.column("word").take(pa.array(row)), pa.array(n[row])],
                    ["size", "cell", "kind", "word", "n"])

    rows = words.select("word", "n").repartition(partitions(spark), "word")
    rows = freeze(rows.mapInArrow(dealt, "size int, cell int, kind int, word string, n long"), "word_cells")
    pieces = F.ceil(F.count("*") / (2 * cell)).cast("int")
    sizes = rows.where("kind = 0").groupBy("size", "cell").agg(pieces.alias("pieces"))
    rows = rows.join(sizes, ["size", "cell"])
    rows = rows.select("*", F.explode(F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")))
                                      .otherwise(F.expr("sequence(0, pieces - 1)"))).alias("piece"))
    found = rows.select("size", "cell", "piece", "kind", "word", "n").groupBy("size", "cell", "piece").applyInArrow(_search_cell, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word on the way from word over form. A form is more frequent than its word, so no way is a circle, and
    each round doubles the steps: a handful of rounds for any corpus."""
    now = freeze(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = freeze(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return now
        now = new.select("word", "root")


def variants(words: DataFrame, times: int = 5, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word: its form is the near word of largest n, if that is `times` its own n."""
    known = freeze(words.select("word", "n"), "words")
    near = known.join(near_words(known, sample, cell), "word", "left")
    fits: Column = F.col("form_n") >= F.col("n") * times
    near = freeze(near.select("word", "n", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"),
                              F.coalesce("n_near", F.lit(0)).alias("n_near")), "near_words")
    found = near.join(roots(near.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
