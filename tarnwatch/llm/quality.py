"""Quality classifier by co-training of two views.

The text view sees which words and beginnings of words a document has; the metadata view sees its source, language, length and layout (line lengths,
shares of symbols, capitals and digits, repetition). Both are logistic models for two labels, quality and toxic. They are
fitted on a bounded sample of labelled documents; in each round each view labels the unlabelled sample, and what it is
confident of joins the other view's training set. At the end each view is calibrated on labelled documents that neither
has seen, and a logistic model of both calibrated views (fitted there too) scores every document of the table.

Only the fit is bounded (`labelled` and `unlabelled` documents, chosen by hash of doc_id); every whole text is scored.

Defined results: a null or empty text has no words and an empty layout; null source, language or length count as their own
values; n_chars is taken from the text, not from the column; labels that are null, or contradict each other for a document, are not used; without labels of
both kinds a model is a constant (the share of 1 among the labels; quality 1 and toxic 0 if there are none), so an unlabelled corpus is kept; equal rows get equal
scores; an empty table gives no rows. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tarnwatch.llm import textkit as tk
from tarnwatch.llm.batches import small_batches

BUCKETS = 1 << 18
STEMS = (4, 5)              # bytes of the word beginnings that are features too
SELECTED = 500              # features of the text view's model: those that tell the classes apart best
LAYOUT = 24
HASHED = 64                 # buckets each for source and language
META = LAYOUT + 2 * HASHED
HEADS = ("quality", "toxic")
_SYMBOL = np.array([k < 128 and not chr(k).isalnum() and not chr(k).isspace() and chr(k) not in ".,;:'\"-()!?" for k in range(256)])
_UPPER = np.array([65 <= k <= 90 for k in range(256)])
_DIGIT = np.array([48 <= k <= 57 for k in range(256)])
_STOP = np.array([chr(k) in ".!?" for k in range(256)])


def _codes(column: pa.Array) -> np.ndarray:
    """A bucket per value of a text column; null has its own."""
    values = column.cast(pa.large_string()).fill_null("\x00null")
    out = np.zeros(len(values), np.int64)
    for start, stop, data, offsets in tk.blocks(values):
        out[start:stop] = (tk.span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(HASHED)).astype(np.int64)
    return out


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the text view: (row, word bucket) of every word a document has; for the metadata view: one dense row each."""
    n = batch.num_rows
    rows, buckets, meta = [], [], np.zeros((n, META), np.float32)
    for start, stop, data, offsets in tk.blocks(batch.column("text")):
        count = stop - start
        lowered = tk.LOWER[data]
        starts, ends, firsts = tk.word_bounds(data, offsets, tk.PUNCTUATION)
        hashes = tk.span_hashes(lowered, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(count), np.diff(firsts))
        key = [np.unique(doc * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))]
        meta[start:stop, :LAYOUT] = _layout(data, offsets, hashes, firsts, doc, key[0] // BUCKETS)
        for k in STEMS:
            long = np.flatnonzero(ends - starts > k)
            stem = tk.span_hashes(lowered, starts[long], starts[long] + k) ^ np.uint64(k) if len(long) else np.zeros(0, np.uint64)
            key.append(doc[long] * BUCKETS + (tk.mixed(stem) % np.uint64(BUCKETS)).astype(np.int64))
        key = np.unique(np.concatenate(key))
        rows.append(key // BUCKETS + start)
        buckets.append(key % BUCKETS)
    for k, name in enumerate(("source", "lang")):
        meta[np.arange(n), LAYOUT + k * HASHED + _codes(batch.column(name))] = 1
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), meta
    return np.concatenate(rows), np.concatenate(buckets), meta


def _layout(data, offsets, hashes, firsts, doc, distinct) -> np.ndarray:
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(np.diff(firsts), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    tokens, token_firsts = tk.words(data, offsets)
    token_doc = np.repeat(np.arange(n), np.diff(token_firsts))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out = np.zeros((n, LAYOUT), np.float32)
    out[:, 0] = np.log1p(np.diff(offsets)) / 10
    out[:, 1] = np.log1p(np.diff(firsts)) / 10
    out[:, 2] = np.minimum(share(_SYMBOL[data]) * 10, 3)
    out[:, 3] = np.minimum(share(_UPPER[data]) * 5, 3)
    out[:, 4] = np.minimum(share(_DIGIT[data]) * 10, 3)
    out[:, 5] = np.minimum(share(_STOP[data]) * 20, 3)
    out[:, 6] = np.minimum(share(data == 10) * 50, 3)
    out[:, 7] = np.minimum(share(data == ord("!")) * 20, 3)
    out[:, 8] = np.minimum(share(data == ord("|")) * 20, 3)
    out[:, 9] = np.minimum(share(data > 127) * 5, 3)
    out[:, 10] = np.minimum(size / words / 10, 3)
    out[:, 11] = np.bincount(doc, same, n) / words
    out[:, 12] = np.bincount(distinct, minlength=n) / words
    out[:, 13] = np.abs(np.diff(token_firsts) - np.diff(firsts)) / words
    out[:, 14] = np.diff(firsts) == 0
    for k, border in enumerate((0.02, 0.05, 0.1, 0.2)):
        out[:, 15 + k] = share(_SYMBOL[data]) > border
    out[:, 19] = out[:, 11] > 0.1
    out[:, 20] = share(_UPPER[data]) > 0.3
    out[:, 21] = np.bincount(token_doc, minlength=n) < 10
    out[:, 22] = out[:, 12] < 0.3
    out[:, 23] = share(data == ord("|")) > 0.03
    return out


@dataclass
class Sparse:
    """Rows of 0/1 features, as (row, column) pairs sorted by row."""
    n: int
    row: np.ndarray
    column: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_words(x: Sparse, y: np.ndarray, weight: np.ndarray, penalty: float = 0.3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on the SELECTED features whose shares among the two classes differ most (by the z statistic) and that three
    documents have. Accelerated gradient steps; each feature's step comes from a bound of the curvature."""
    ones, zeros = max(weight @ y, 1e-9), max(weight @ (1 - y), 1e-9)
    a = np.bincount(x.column, (weight * y)[x.row], BUCKETS)
    b = np.bincount(x.column, (weight * (1 - y))[x.row], BUCKETS)
    share = (a + b) / (ones + zeros)
    z = np.abs(a / ones - b / zeros) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / zeros))
    z[a + b < 3] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:SELECTED])
    chosen = chosen[z[chosen] > 2]
    w, bias = np.zeros(BUCKETS), float(np.log(ones / zeros))
    if not len(chosen):
        return w, bias
    at = np.full(BUCKETS, -1)
    at[chosen] = np.arange(len(chosen))
    keep = (at[x.column] >= 0) & (weight[x.row] > 0)
    row, column, k = x.row[keep], at[x.column[keep]], len(chosen)
    length = np.bincount(row, minlength=x.n)
    scale = 1 / (0.25 * np.bincount(column, (weight * (length + 1))[row], k) + penalty)
    bias_scale = 1 / (0.25 * (weight @ (length + 1)) + 1e-9)
    v, old, old_bias = np.zeros(k), np.zeros(k), bias
    for step in range(steps):
        pull = step / (step + 3)
        ahead, ahead_bias = v + pull * (v - old), bias + pull * (bias - old_bias)
        g = weight * (sigmoid(np.bincount(row, ahead[column], x.n) + ahead_bias) - y)
        old, old_bias = v, bias
        v = ahead - scale * (np.bincount(column, g[row], k) + penalty * ahead)
        bias = ahead_bias - bias_scale * g.sum()
    w[chosen] = v
    return w, float(bias)


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, g)
    return w


@dataclass
class Head:
    """One label's model: the views, and how their logits combine."""
    words: np.ndarray
    bias: float
    meta: np.ndarray
    joint: np.ndarray                   # of the text logit, the metadata logit and 1
    views: np.ndarray = field(default_factory=lambda: np.array([[1.0, 0.0], [1.0, 0.0]]))   # Platt's slope and intercept

    def logits(self, x: Sparse, meta: np.ndarray) -> np.ndarray:
        raw = np.column_stack((x.dot(self.words) + self.bias, meta @ self.meta[:-1] + self.meta[-1]))
        return raw * self.views[:, 0] + self.views[:, 1]

    def score(self, x: Sparse, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(x, meta)
        return sigmoid(z @ self.joint[:2] + self.joint[2]), sigmoid(z)


def constant(share: float) -> Head:
    logit = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    return Head(np.zeros(BUCKETS, np.float32), logit, np.append(np.zeros(META), logit), np.array([1.0, 0.0, 0.0]))


def co_train(x: Sparse, meta: np.ndarray, label: np.ndarray, held: np.ndarray, rounds: int = 3, sure: float = 0.95) -> Head:
    """label: 0, 1 or -1 (unlabelled); held: labelled rows kept for calibration."""
    train = (label >= 0) & ~held
    if len(set(label[train])) < 2 or len(set(label[held & (label >= 0)])) < 2:
        known = label[label >= 0]
        return constant(float(known.mean()))
    given = [(np.where(train, label, 0).astype(float), train.astype(float)) for _ in range(2)]
    for k in range(rounds + 1):
        words, bias = fit_words(x, *given[0])
        dense = fit_dense(meta, *given[1])
        if k == rounds:
            break
        views = (sigmoid(x.dot(words) + bias), sigmoid(meta @ dense[:-1] + dense[-1]))
        for own, other in ((0, 1), (1, 0)):
            p, (y, weight) = views[own], given[other]
            new = (label < 0) & (weight == 0) & (np.abs(p - 0.5) >= sure - 0.5)
            y[new], weight[new] = p[new] > 0.5, 0.3
    head = Head(words.astype(np.float32), bias, dense, np.zeros(3))
    test = held & (label >= 0)
    y, ones = label[test].astype(float), np.ones(int(test.sum()))
    z = head.logits(x, meta)[test]
    head.views = np.array([fit_dense(z[:, [k]], y, ones, 0.1) for k in range(2)])
    z = head.logits(x, meta)[test]
    head.joint = fit_dense(z, y, ones, 0.1)
    return head


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, buckets, meta = features(batch)
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), batch.column("toxic"),
             pa.array([buckets[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
             pa.array([m.tobytes() for m in meta], pa.binary())], ["doc_id", "quality", "toxic", "words", "meta"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 6000, unlabelled: int = 2000) -> dict[str, Head]:
    """Heads for quality and toxic from a sample of about `labelled` and `unlabelled` documents at most."""
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    # Labels of one document that disagree are unknown.
    agreed = [F.when(F.min(h) == F.max(h), F.max(h)).cast("int").alias(h) for h in HEADS]
    clean = labels.where("doc_id is not null").groupBy("doc_id").agg(*agreed).where(
        "quality in (0, 1) or toxic in (0, 1)")
    n_labels, n_docs = clean.count(), docs.count()
    some = F.broadcast(clean.where(draw < int(1e6 * min(1, labelled / max(n_labels, 1)))))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    known = base.join(some, "doc_id")
    other = base.where(draw >= 1_000_000 - int(1e6 * min(1, unlabelled / max(n_docs, 1)))).join(
        F.broadcast(some.select("doc_id")), "doc_id", "left_anti")
    rows = known.unionByName(other.withColumns({h: F.lit(None).cast("int") for h in HEADS}))
    got = rows.select("doc_id", "text", "source", "lang", *HEADS).mapInArrow(
        _sampled, "doc_id long, quality int, toxic int, words binary, meta binary").toArrow()
    if not got.num_rows:
        return {"quality": constant(1.0), "toxic": constant(0.0)}
    words = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("words")]
    x = Sparse(len(words), np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words]), np.concatenate(words))
    meta = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in got.column("meta")]).astype(np.float64)
    ids = got.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
    held = tk.mixed(ids.view(np.uint64)) % np.uint64(4) == 0
    heads = {}
    for name, default in (("quality", 1.0), ("toxic", 0.0)):
        label = got.column(name).fill_null(-1).to_numpy().astype(np.int64)
        label[(label != 0) & (label != 1)] = -1
        heads[name] = co_train(x, meta, label, held) if (label >= 0).any() else constant(default)
    return heads


SCORES = ("p_quality", "p_toxic", "p_quality_text", "p_quality_meta", "p_toxic_text", "p_toxic_meta")


def score(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """All columns of docs, and the probabilities SCORES; columns of docs with these names give way to them."""
    docs = docs.drop(*SCORES)
    shared = docs.sparkSession.sparkContext.broadcast(heads)
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, buckets, meta = features(batch)
            x = Sparse(batch.num_rows, rows, buckets)
            (quality, q), (toxic, t) = (shared.value[h].score(x, meta) for h in HEADS)
            scores = (quality, toxic, q[:, 0], q[:, 1], t[:, 0], t[:, 1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(s, pa.float64()) for s in scores)], [*names, *SCORES])

    schema = T.StructType(list(docs.schema.fields) + [T.StructField(s, T.DoubleType()) for s in SCORES])
    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5, **sample: int) -> DataFrame:
    """All columns of docs, SCORES, score (quality and not toxic) and keep. docs needs doc_id, text, source and lang;
    its columns with names of results give way to those."""
    docs = docs.drop(*SCORES, "score", "keep")
    scored = score(docs, fit(docs, labels, **sample))
    return scored.withColumns({
        "score": F.col("p_quality") * (1 - F.col("p_toxic")),
        "keep": (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic)})
