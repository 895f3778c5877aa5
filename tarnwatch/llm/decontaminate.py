"""Benchmark decontamination: BM25 over an inverted index of the test items, searched with block-max bounds for every passage.

A document's words are cut into passages of twice the longest item's length, each overlapping the next by half, so every
item that a document quotes lies whole in a passage. Each passage is a query; an item is retrieved if it scores at least
`least_score` of what it scores for its own text. As in block-max WAND, terms are ordered by their largest share: those whose
shares together stay below the threshold can't bring an item over it, so only the other terms open blocks of items; a block
is read if the sum of its maxima reaches the threshold, and only then its items are scored. Bounds are computed for all
passages of a block of documents at once. What is retrieved is verified by the words themselves.

The index is broadcast. Its size is checked: items beyond `index_bytes` are searched in several passes, each with a part.

Items are question and answer: the last sentence is the answer, of a single sentence the second half. A passage leaks an item
if it holds `least_overlap` of the item's 5-word shingles (words in lower case, without punctuation), and half of the
question's and half of the answer's words.

Defined results: a null or empty text has no passages; null, empty or wordless items match nothing; items of fewer than five
words are one shingle; equal items are each reported; rows that share a doc_id are reported once per item, with the
best passage; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarnwatch.llm import textkit as tk
from tarnwatch.llm.batches import small_batches

K1, B = 1.2, 0.75
BLOCK = 4                   # items of an index block
TABLE = 1 << 24             # cells of the largest table of block maxima (float32)
SCHEMA = "doc_id long, item_id long, passage long, score double, question double, answer double, overlap double"


@dataclass
class Index:
    items: np.ndarray           # item_id
    terms: np.ndarray           # sorted word hashes
    starts: np.ndarray          # postings of term t: starts[t] to starts[t + 1]
    posted: np.ndarray          # item of a posting, ascending
    weight: np.ndarray          # BM25 of a posting
    share: np.ndarray           # the same as part of the item's score for its own text
    block_starts: np.ndarray    # blocks of term t
    block: np.ndarray
    block_share: np.ndarray     # largest share of the term in the block
    opens: np.ndarray           # whether the term can bring an item over the threshold
    closed: np.ndarray          # per block: most that terms which open nothing add
    maxima: np.ndarray | None   # terms by blocks, if that is a small table
    words: list                 # per item: word hashes, number of question words
    longest: int


def halves(text: str) -> tuple[str, str]:
    """Question and answer."""
    found = list(re.finditer(r"[.?!]\s+(?=\S)", text.strip()))
    if found:
        return text.strip()[:found[-1].end()], text.strip()[found[-1].end():]
    parts = text.split()
    return " ".join(parts[:(len(parts) + 1) // 2]), " ".join(parts[(len(parts) + 1) // 2:])


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in tk.blocks(pa.array(texts, pa.large_string())):
        hashes, firsts = tk.words(data, offsets, tk.PUNCTUATION)
        out += [hashes[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
    return out


def build_index(items: list[tuple[int, str]], least_score: float) -> Index | None:
    """Index of (item_id, text)."""
    pairs = [halves(text or "") for _, text in items]
    questions, answers = _words([q for q, _ in pairs]), _words([a for _, a in pairs])
    kept = [(items[k][0], np.concatenate((q, a)), len(q)) for k, (q, a) in enumerate(zip(questions, answers)) if len(q) + len(a)]
    if not kept:
        return None
    lengths = np.array([len(w) for _, w, _ in kept])
    counted = [np.unique(w, return_counts=True) for _, w, _ in kept]
    term = np.concatenate([t for t, _ in counted])
    item = np.repeat(np.arange(len(kept)), [len(t) for t, _ in counted])
    tf = np.concatenate([c for _, c in counted])
    order = np.lexsort((item, term))
    term, item, tf = term[order], item[order], tf[order]
    terms, starts, df = np.unique(term, return_index=True, return_counts=True)
    starts = np.append(starts, len(term))
    idf = np.log(1 + (len(kept) - df + 0.5) / (df + 0.5))
    weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / lengths.mean()))
    share = weight / np.bincount(item, weight, len(kept))[item]

    number = np.repeat(np.arange(len(terms)), df)
    key, first = np.unique(number * (len(kept) // BLOCK + 1) + item // BLOCK, return_index=True)
    block_share = np.maximum.reduceat(share, first)
    block, block_term = key % (len(kept) // BLOCK + 1), key // (len(kept) // BLOCK + 1)

    # Terms by their largest share, from the least: per block, as many stay closed as together stay below the threshold.
    top = np.maximum.reduceat(share, starts[:-1])
    rank = np.empty(len(terms), np.int64)
    rank[np.argsort(top, kind="stable")] = np.arange(len(terms))
    by_item = np.lexsort((rank[number], item))
    run = np.cumsum(share[by_item])
    before = np.concatenate(([0.0], run))[np.searchsorted(item[by_item], item[by_item])]
    stay = run - before < least_score - 1e-9
    opens = np.zeros(len(terms), bool)
    opens[number[by_item][~stay]] = True
    shut = ~opens[number]
    rest = np.bincount(item[shut], share[shut], len(kept))
    closed = np.array([rest[k:k + BLOCK].max() for k in range(0, len(kept), BLOCK)])
    maxima = None
    if len(terms) * len(closed) <= TABLE:
        maxima = np.zeros((len(terms), len(closed)), np.float32)
        maxima[block_term, block] = block_share
    return Index(np.array([i for i, _, _ in kept]), terms, starts, item, weight, share,
                 np.searchsorted(block_term, np.arange(len(terms) + 1)), block, block_share, opens, closed, maxima,
                 [(w, n) for _, w, n in kept], int(lengths.max()))


def _expand(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For CSR lists of `rows`: which of rows each entry belongs to, and the entry's position."""
    sizes = starts[rows + 1] - starts[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[rows], sizes)
    return owner, at


def retrieve(index: Index, hashes: np.ndarray, firsts: np.ndarray, least_score: float):
    """(document, first word, item, BM25 score) of all items over the threshold, for every passage of the documents."""
    step = index.longest
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[at] == hashes)
    term = at[hit]
    doc = np.searchsorted(firsts, hit, "right") - 1
    within = (hit - firsts[doc]) // step
    width = int(len(hashes) // step + 2)
    passage, words = doc * width + within, term
    earlier = within > 0
    passage = np.concatenate((passage, passage[earlier] - 1))
    words = np.concatenate((words, words[earlier]))
    once = np.unique(passage * len(index.terms) + words)
    passage, words = once // len(index.terms), once % len(index.terms)

    blocks = len(index.closed)
    if index.maxima is not None:
        # Blocks few enough for a table: the sum of maxima of every block, for runs of passages.
        starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1]))) if len(passage) else passage
        names, kept = passage[starts], []
        for k in range(0, len(starts), 512):
            lo, hi = starts[k], starts[k + 512] if k + 512 < len(starts) else len(words)
            bound = np.add.reduceat(index.maxima[words[lo:hi]], starts[k:k + 512] - lo, axis=0)
            row, block = np.nonzero(bound >= least_score - 1e-5)
            kept.append(names[k + row] * blocks + block)
        key = np.concatenate(kept) if kept else passage
    else:
        opening = index.opens[words]
        p, w = passage[opening], words[opening]
        owner, entry = _expand(index.block_starts, w)
        key, inverse = np.unique(p[owner] * blocks + index.block[entry], return_inverse=True)
        bound = np.bincount(inverse, index.block_share[entry], len(key)) + index.closed[key % blocks]
        key = key[bound >= least_score - 1e-9]

    found = []
    open_passages = np.unique(key // blocks)
    lists = np.searchsorted(passage, open_passages)
    ends = np.searchsorted(passage, open_passages, "right")
    for name, a, b in zip(open_passages, lists, ends):
        owner, entry = _expand(index.starts, words[a:b])
        score = np.bincount(index.posted[entry], index.weight[entry], len(index.items))
        part = np.bincount(index.posted[entry], index.share[entry], len(index.items))
        read = np.repeat(np.isin(np.arange(blocks), key[key // blocks == name] % blocks), BLOCK)[:len(index.items)]
        for item in np.flatnonzero(read & (part >= least_score - 1e-9)):
            found.append((int(name // width), int(name % width) * step, int(item), float(score[item])))
    return found


def overlaps(index: Index, passage: np.ndarray, item: int) -> tuple[float, float, float]:
    """Parts of the question's words, the answer's words and the item's shingles that the passage holds."""
    own, split = index.words[item]
    held = np.isin(own, passage)
    shingle = np.unique(tk.shingles(own))
    size = min(tk.SHINGLE, len(own))
    there = np.isin(shingle, tk.shingles(passage, size)) if len(passage) >= size else np.zeros(len(shingle), bool)
    question = held[:split].mean() if split else 1.0
    answer = held[split:].mean() if split < len(own) else 1.0
    return float(question), float(answer), float(there.mean())


def _search(shared, least_score: float, least_overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id").cast(pa.int64()), []
            for start, _, data, offsets in tk.blocks(batch.column("text")):
                hashes, firsts = tk.words(data, offsets, tk.PUNCTUATION)
                if not len(hashes):
                    continue
                for doc, first, item, score in retrieve(index, hashes, firsts, least_score):
                    own = hashes[firsts[doc]:firsts[doc + 1]][first:first + 2 * index.longest]
                    question, answer, overlap = overlaps(index, own, item)
                    if overlap >= least_overlap and question >= 0.5 and answer >= 0.5:
                        rows.append((ids[start + doc].as_py(), int(index.items[item]), first, score, question, answer, overlap))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.float64()] * 4)],
                    ["doc_id", "item_id", "passage", "score", "question", "answer", "overlap"])
    return run


def leaks(docs: DataFrame, items: DataFrame, least_score: float = 0.5, least_overlap: float = 0.75,
          index_bytes: int = 32 << 20) -> DataFrame:
    """One row per document and leaked item, with the best passage (its first word counted from 0)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, out = int(total // index_bytes) + 1, None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        index = build_index(list(zip(own.column(0).to_pylist(), own.column(1).to_pylist())), least_score)
        if index is None:
            continue
        found = docs.select("doc_id", "text").mapInArrow(
            _search(spark.sparkContext.broadcast(index), least_score, least_overlap), SCHEMA)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], SCHEMA)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("overlap"), F.desc("score"), "passage")
    return out.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
