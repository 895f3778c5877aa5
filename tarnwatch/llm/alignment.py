"""Alignment of the tokens that two tokenizers cut one text into.

Each text goes through both tokenizers; the byte offsets where tokens end go into one dictionary per tokenizer (end to index).
The ends that both dictionaries hold, sorted, cut both lists of ids into groups that cover the same bytes. The tokens whose
byte ranges end together, the last ones of each group, are linked; how often two ids are linked is counted over all texts.

Tokenizer A is a byte-level BPE file (JSON) and gets a space before the text, B a sentencepiece model that adds the space itself.
Both files are read once, by the driver, and go out as they are: their size does not depend on the texts.

Neither tokenizer has a token that goes on from a visible sign to a space or a line break, or from a letter to a punctuation mark
(checked when the files are loaded). So a text is aligned unit by unit, a unit being what stands between two such
places, and a worker remembers the units it met lately.

Defined results: a text that is null or empty, or that either tokenizer doesn't give back byte for byte, has no tokens and
empty lists. Strings of special tokens are plain text. Rows are kept one by one, whatever their doc_id: null, or repeated. Other
columns are ignored. An empty table gives an empty result. Ends are looked up WINDOW bytes at a time, so that the
dictionaries of a very long text stay small; its ids and the tokenizer's own state grow with that one text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarnwatch.llm.batches import small_batches
from tarnwatch.plans.freeze import freeze

WINDOW = 1 << 20
# Units that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 250_000, 64
ALIGNED = "doc_id {id}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
LINKED = ("doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>, times array<bigint>")
SUMMARY = ("doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
           "groups_sha256 string")
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
units = re.compile(rf"(?<=\S)(?=[ \n])|(?<={LETTER})(?=[.,;:!?])").split
ACROSS = re.compile(rf"[^\s▁][▁ \n]|\n|{LETTER}[.,;:!?]").search


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its Latin-1 sign if that is visible, the others as signs from U+0100 on, in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: ids of a text, and the bytes of every id."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer
        described, signs = json.loads(file), byte_of_sign()
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        entries = described["model"]["vocab"]
        self.bytes = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, number in entries.items():
            self.bytes[number] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        before = described.get("pre_tokenizer") or {}
        self.cuts = (described.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                     and not before.get("add_prefix_space", True))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: ids of a text without the space that the model adds, and the bytes of every id. No piece holds a line break, so
    one put before the text keeps it apart from the added space; the ids of both are left out again."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_proto=file)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode()
                      for k, name in enumerate(names)]
        self.cuts = not any(ACROSS(name) for name in names) and self.model.encode("\n") == [
            self.model.piece_to_id("▁"), self.model.piece_to_id("<0x0A>")]

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.cuts:
            return [found[2:] for found in self.model.encode([f"\n{text}" for text in texts], num_threads=1)]
        return self.model.encode([text[1:] for text in texts], num_threads=1)


def _shared(ends_a: list[int], ends_b: list[int], a: int, b: int) -> tuple[list[int], list[int]]:
    index_a, index_b = dict(zip(ends_a, range(a + 1, a + len(ends_a) + 1))), dict(zip(ends_b, range(b + 1, b + len(ends_b) + 1)))
    shared = sorted(index_a.keys() & index_b.keys())
    return [index_a[end] for end in shared], [index_b[end] for end in shared]


def common_ends(ends_a: list[int], ends_b: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For every offset in both ascending lists of ends: how many tokens of A and of B end there or before."""
    last = min(ends_a[-1], ends_b[-1]) if ends_a and ends_b else -1
    if last < window:
        return _shared(ends_a, ends_b, 0, 0)
    cuts_a, cuts_b, a0, b0 = [], [], 0, 0
    for low in range(0, last + 1, window):
        a1, b1 = bisect_left(ends_a, low + window, a0), bisect_left(ends_b, low + window, b0)
        for cuts, new in zip((cuts_a, cuts_b), _shared(ends_a[a0:a1], ends_b[b0:b1], a0, b0)):
            cuts += new
        a0, b0 = a1, b1
    return cuts_a, cuts_b


class Aligned(NamedTuple):
    """Numbers of ids of both tokenizers, their groups as `a1,a2|b1;a3|b2,b3`, and linked ids as a << 32 | b. Only numbers and one
    text, so that remembered ones are cheap to keep."""
    n_a: int
    n_b: int
    groups: str
    links: tuple[int, ...]


class Aligner:
    """Aligns texts; a text that doesn't come back from both tokenizers is None."""

    def __init__(self, file_a: bytes, file_b: bytes):
        self.sides = ByteLevel(file_a), Pieces(file_b)
        self.tables = [(side.bytes, [str(k) for k in range(len(side.bytes))]) for side in self.sides]
        self.cuts = all(side.cuts for side in self.sides)
        self.met: dict[str, Aligned | None] = {}

    def aligned(self, wholes: list[str]) -> list[Aligned | None]:
        """Some units at once: their bytes stand one behind the other, so that one dictionary of ends per tokenizer serves them all."""
        a_lists, b_lists = (side.ids(wholes) for side in self.sides)
        found = self._aligned([whole.encode() for whole in wholes], a_lists, b_lists)
        if found is None:                       # one of them doesn't come back: each by itself
            found = [(self._aligned([whole.encode()], [a], [b]) or [None])[0] for whole, a, b in zip(wholes, a_lists, b_lists)]
        return found

    def _aligned(self, encoded: list[bytes], a_lists: list[list[int]], b_lists: list[list[int]]) -> list[Aligned] | None:
        unit_ends, ids, ends = list(accumulate(map(len, encoded))), [], []
        for (bytes_of, _), lists in zip(self.tables, (a_lists, b_lists)):
            flat = list(chain.from_iterable(lists))
            parts = [bytes_of[k] for k in flat]
            stops = list(accumulate(map(len, parts)))
            if b"".join(parts) != b"".join(encoded) or [stops[k - 1] for k in accumulate(map(len, lists))] != unit_ends:
                return None
            ids.append(flat)
            ends.append(stops)
        (a_ids, b_ids), (a_cuts, b_cuts) = ids, common_ends(*ends)
        (_, names_a), (_, names_b) = self.tables
        groups, a, b = [], 0, 0
        for to_a, to_b in zip(a_cuts, b_cuts):
            of_a = names_a[a_ids[a]] if to_a - a == 1 else ",".join([names_a[k] for k in a_ids[a:to_a]])
            of_b = names_b[b_ids[b]] if to_b - b == 1 else ",".join([names_b[k] for k in b_ids[b:to_b]])
            groups.append(f"{of_a}|{of_b}")
            a, b = to_a, to_b
        links = [a_ids[x - 1] << 32 | b_ids[y - 1] for x, y in zip(a_cuts, b_cuts)]
        last = {a_cut: k for k, a_cut in enumerate(a_cuts, 1)}
        out, start = [], 0
        for n_a, n_b, stop in zip(map(len, a_lists), map(len, b_lists), accumulate(map(len, a_lists))):
            end = last[stop]
            out.append(Aligned(n_a, n_b, ";".join(groups[start:end]), tuple(links[start:end])))
            start = end
        return out

    def texts(self, texts: list[str | None]) -> list[list[Aligned] | None]:
        """The aligned units of some texts; none of a text that is null or empty."""
        cut = [(units(f" {text}") if self.cuts else [f" {text}"]) if text else [] for text in texts]
        met = self.met
        if len(met) > REMEMBERED:
            met.clear()
        new = list(set().union(*cut).difference(met))
        for some in (new[k:k + 1000] for k in range(0, len(new), 1000)):
            met.update(zip(some, self.aligned(some)))
        out = [[met[unit] for unit in part] for part in cut]
        for unit in new:
            if len(unit) > LONGEST:
                del met[unit]
        return [None if None in part else part for part in out]


@functools.lru_cache(maxsize=2)
def aligner(file_a: bytes, file_b: bytes) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(file_a, file_b)


def group_lists(found: list[Aligned] | None) -> tuple[list[int], list[int], list[int], list[int]]:
    """Ids of A and of B, and how many of each the groups hold."""
    out: tuple = [], [], [], []
    for group in chain.from_iterable(unit.groups.split(";") for unit in found or () if unit.groups):
        for k, side in enumerate(group.split("|")):
            ids = side.split(",")
            out[k].extend(map(int, ids))
            out[k + 2].append(len(ids))
    return out


def _sent(docs: DataFrame, *paths: str) -> list:
    files = []
    for path in paths:
        with open(path, "rb") as file:
            files.append(docs.sparkSession.sparkContext.broadcast(file.read()))
    return files


def align(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """doc_id, a_ids, b_ids, a_sizes, b_sizes: the k-th group is the next a_sizes[k] ids of A and the next b_sizes[k] of B."""
    small_batches(docs.sparkSession, 250)
    sent = _sent(docs, vocabulary_a, vocabulary_b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(*(x.value for x in sent)).texts
        for batch in batches:
            rows = list(map(group_lists, aligned(batch.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([row[k] for row in rows], pa.list_(pa.int32())) for k in range(4))],
                ["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(work, ALIGNED.format(id=kept.schema["doc_id"].dataType.simpleString()))


def link(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """Per text its numbers of tokens and groups, a digest of the groups, and its distinct linked pairs of ids (a << 32 | b) with
    the number of times each is linked. The digest is of `a1,a2|b1;a3|b2,b3`, the ids of the groups in order."""
    small_batches(docs.sparkSession, 250)
    sent = _sent(docs, vocabulary_a, vocabulary_b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(*(x.value for x in sent)).texts
        for batch in batches:
            sizes, digests, links, times = [], [], [], []
            for found in aligned(batch.column("text").to_pylist()):
                found = found or []
                pairs, number = np.unique(np.fromiter(chain.from_iterable(x.links for x in found), np.int64), return_counts=True)
                sizes.append((sum(x.n_a for x in found), sum(x.n_b for x in found), int(number.sum())))
                digests.append(hashlib.sha256(";".join(x.groups for x in found).encode()).hexdigest() if found else "")
                links.append(pairs)
                times.append(number)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([row[k] for row in sizes], pa.int64()) for k in range(3)),
                 pa.array(digests, pa.string()), pa.array(links, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(work, LINKED.format(id=kept.schema["doc_id"].dataType.simpleString()))


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, n: how often the ids a and b are linked in all texts; best: whether no id of A is linked with b more often.

    Of two linked tokens the bytes of one end with those of the other. So the number of rows is bounded by the
    vocabularies: at most one for each ending of each entry (twice as many where bytes have entries of their own).
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("links", "times"))
            codes, place = np.unique(np.concatenate((codes, new)), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, place, np.concatenate((counts, times)))
            counts = total
        for k in range(0, len(codes), 1 << 16):
            part = codes[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((part >> 32).astype(np.int32)), pa.array((part & 0xFFFFFFFF).astype(np.int32)),
                                              pa.array(counts[k:k + (1 << 16)])], ["a", "b", "n"])

    counted = linked.select("links", "times").mapInArrow(work, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def summary(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """Per text: numbers of tokens, groups and links, links whose pair is the best of its id of B, the sum of the pairs' counts
    over the links, and the digest of the groups. counts is as large as the vocabularies allow, whatever the texts, and goes to all tasks."""
    table = counts.select("a", "b", "n", "best").toArrow()
    codes = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy().astype(np.int64)
    order = np.argsort(codes)
    sent = linked.sparkSession.sparkContext.broadcast(
        (codes[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order].astype(np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            offsets = np.concatenate(([0], np.cumsum(batch.column("links").value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            links, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("links", "times"))
            at = np.searchsorted(known, links)
            best_links, sums = (np.diff(np.concatenate(([0], np.cumsum(x[at] * times)))[offsets]) for x in (best, n))
            groups = batch.column("n_groups")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_a"), batch.column("n_b"), groups, groups, pa.array(best_links), pa.array(sums),
                 batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return linked.mapInArrow(work, SUMMARY.format(id=linked.schema["doc_id"].dataType.simpleString()))


def alignment_summary(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """The summary of all texts. Texts are tokenized once: their links are written and read twice."""
    linked = freeze(link(docs, vocabulary_a, vocabulary_b), "linked")
    return summary(linked, freeze(pair_counts(linked), "token_pairs"))
