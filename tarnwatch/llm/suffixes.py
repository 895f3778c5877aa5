"""Exact repeats of documents by a distributed enhanced suffix array, and their removal.

A string of `least` bytes always holds an anchor: the place whose hash of GRAM bytes is the least of all in it. Where it
repeats, so does the anchor, at the same distance. So (1) anchors of all texts meet by hash, and those found in one
document only are dropped; (2) each place that a string may start at belongs to one anchor, and the places of an anchor,
with all bytes that strings starting there need, are a context; (3) contexts meet by anchor. Each part sorts the suffixes at
its places into a suffix array with common-prefix lengths. One scan with a stack walks the tree of common-prefix intervals
and puts out each interval that is at least `least` long and whose suffixes have different bytes to the left (or begin
their context): the maximal repeats, with all their occurrences. An occurrence in a document that isn't the first (least
doc_id) of its group is removed.

Copies cost little. Of documents with equal texts only the one with the least doc_id takes part, the others are removed whole;
anchors that several documents of a task share, and equal contexts of a task, are sent once, the later ones are
known as removed at once. So what meets under a key is bounded by the number of tasks, not by the size of a group.

Defined results: a null or empty text has no bytes; texts shorter than `least` lose nothing; strings never cross texts; rows
that share a doc_id don't remove each other's bytes; a null doc_id comes after all others; bytes are judged on the input;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tarnwatch.llm import textkit as tk
from tarnwatch.llm.batches import small_batches
from tarnwatch.llm.exprs import partitions
from tarnwatch.plans.freeze import freeze

GRAM = 20
TEXTS_OF_ID = 1 << 23
NO_ID = 2**63 - 1
NONE = -(2**63)             # stands for several documents
CHUNK = 500_000           # anchors a task holds before it hands them on
FILTER_WORDS, SLICES = 1 << 20, 64
SUFFIXES = 250_000          # suffixes that are sorted at once
PLACE = (1 << 40) - 1       # lower bits of a place: the byte; upper bits: which of the rows of a doc_id


def _minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    up, down = tk.powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(tk.BYTE_CODE[data] * up[:len(data)], out=sums[1:])
    return tk.mixed((sums[GRAM:] - sums[:-GRAM]) * down[:len(data) - GRAM + 1])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that are the least of some `width` neighbouring hashes (all of equal ones)."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _minimum(hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(hashes == ~_minimum(~np.concatenate((edge, least, edge)), width))


def owners(hashes: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every anchor (all places of its hash must be given) the first start whose strings it owns, and how many it owns.

    A start is owned by the last place of its least hash. All starts around an anchor that aren't cut off by a smaller hash have the
    anchor's as their least; they are one run of equal least hashes, cut where a later place of the hash comes in."""
    least, key = _minimum(hashes, width), hashes[places]
    runs = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    ends = np.append(runs[1:], len(least)) - 1
    known = np.unique(key)
    number = np.minimum(np.searchsorted(known, least[runs]), len(known) - 1)
    mine = known[number] == least[runs]
    runs, ends, number = runs[mine], ends[mine], number[mine]
    order = np.argsort(number, kind="stable")
    runs, ends, number = runs[order], ends[order], number[order]
    own = np.searchsorted(known, key)
    at = np.searchsorted((number << 40) + runs, (own << 40) + places, "right") - 1
    good = (at >= 0) & (number[at] == own)
    order = np.lexsort((places, own))
    later = np.full(len(places), 1 << 40)
    same = own[order][1:] == own[order][:-1]
    later[order[:-1][same]] = places[order[1:][same]]
    begin = np.maximum(runs[at], places - width + 1)
    last = np.minimum(np.minimum(ends[at], places), later - width)
    return begin, np.where(good & (last >= begin), last - begin + 1, 0)


# --- anchors that several documents have --------------------------------------------------------------------------------

MET = "bucket int, docs binary, places binary, keys binary"


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "row", "digest"))


def _emit(least: int, parts: int):
    width = least - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[int, int] = {}
        keys, docs, places, held, turn = [], [], [], 0, 0
        for batch in batches:
            ids, rows, digests = _rows_of(batch)
            for start, stop, data, offsets in tk.blocks(batch.column("text")):
                for k in range(start, stop):
                    text = data[offsets[k - start]:offsets[k - start + 1]]
                    if len(text) < least or firsts.get(int(digests[k]), NO_ID + 1) <= ids[k]:
                        continue
                    firsts[int(digests[k])] = int(ids[k])
                    hashes = gram_hashes(text)
                    at = anchors(hashes, width)
                    keys.append(hashes[at])
                    docs.append(np.full(len(at), ids[k]))
                    places.append(at + (int(rows[k]) << 40))
                    held += len(at)
                    if held >= CHUNK:
                        yield _packed(keys, docs, places, parts, turn)
                        keys, docs, places, held, turn = [], [], [], 0, turn + 1
        if held:
            yield _packed(keys, docs, places, parts, turn)
    return run


def _short(keys: np.ndarray) -> bytes:
    """48 bits of every key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(values: list) -> np.ndarray:
    low = np.concatenate([np.frombuffer(v.as_buffer(), np.uint8) for v in values]).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view(np.uint64).ravel()


LOW = np.uint64((1 << 48) - 1)


def _packed(keys, docs, places, parts: int, turn: int) -> pa.RecordBatch:
    """kind 0: anchors to compare with other tasks, by part; kind 1: anchors that documents of this chunk share, dealt evenly.
    For each of the latter one goes with kind 0, under NONE, so other tasks learn of it."""
    key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    size = np.diff(np.append(starts, len(key)))
    mixed = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
    shared = np.zeros(len(key), bool)
    shared[order] = np.repeat(mixed, size)
    one = order[starts[mixed]]
    lone = np.concatenate((np.flatnonzero(~shared), one))
    known = np.flatnonzero(shared)
    part = ((key[lone] >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16)
    lone_doc = np.concatenate((doc[~shared], np.full(len(one), NONE)))
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[p]:cuts[p + 1]]
        out.append((int(p), 0, _short(key[lone[own]]), lone_doc[own].tobytes(), place[lone[own]].tobytes()))
    for k in range(0, len(known), 1 << 15):
        own = known[k:k + (1 << 15)]
        p = int(tk.mixed(key[own[:1]] + np.uint64(turn))[0] % np.uint64(parts))
        out.append((p, 1, _short(key[own]), doc[own].tobytes(), place[own].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
        ["part", "kind", "keys", "docs", "places"])


def _bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mixed(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _meet(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Anchors of a part that more than one document has, by bucket of documents."""
        table = table.combine_chunks()
        kind, part = table.column("kind").to_numpy(), table.column("part")[0].as_py()
        got = []
        for k in (0, 1):
            own = table.filter(pa.array(kind == k))
            if not own.num_rows:
                continue
            key = _long(list(own.column("keys")))
            doc, place = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in own.column(n)]) for n in ("docs", "places"))
            if k == 0:
                order = np.argsort(key, kind="stable")
                key, doc, place = key[order], doc[order], place[order]
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                many = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
                keep = np.repeat(many, np.diff(np.append(starts, len(key)))) & (doc != NONE)
                key, doc, place = key[keep], doc[keep], place[keep]
            got.append((key, doc, place))
        key, doc, place = (np.concatenate(x) for x in zip(*got))
        bucket = _bucket_of(doc, buckets)
        order = np.lexsort((place, doc, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(int(b), order[cuts[b]:cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts))]
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), *(
            pa.array([x[o].tobytes() for _, o in rows], pa.binary()) for x in (doc, place)),
            pa.array([_short(key[o]) for _, o in rows], pa.binary())], names=["bucket", "docs", "places", "keys"])
    return run


# --- contexts -----------------------------------------------------------------------------------------------------------

CONTEXTS = "part int, kind int, keys binary, docs binary, places binary, sizes binary, texts binary"


def _cut(least: int, parts: int):
    width = least - GRAM + 1

    def run(key, met: pa.Table, texts: pa.Table) -> pa.Table:
        """Contexts of a bucket's anchors; of equal ones only that of the first document, the others are spans (kind 1)."""
        out = _contexts(met, texts) if met.num_rows and texts.num_rows else None
        if out is None:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 5)],
                            names=["part", "kind", "keys", "docs", "places", "sizes", "texts"])
        return out

    def _contexts(met: pa.Table, texts: pa.Table) -> pa.Table | None:
        met, texts = met.combine_chunks(), texts.combine_chunks()
        doc, place = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in met.column(n)]) for n in ("docs", "places"))
        anchor = _long(list(met.column("keys")))
        row = place >> 40
        order = np.lexsort((place, row, doc))
        doc, place, row, anchor = doc[order], place[order] & PLACE, row[order], anchor[order]
        edges = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]), [True])))
        where = {(int(doc[a]), int(row[a])): (a, b) for a, b in zip(edges[:-1], edges[1:])}
        keys, docs, begins, sizes, digests, bodies = [], [], [], [], [], []
        ids, rows = texts.column("doc_id").to_numpy(), texts.column("row").to_numpy()
        done = set()
        for start, stop, data, offsets in tk.blocks(texts.column("text")):
            for k in range(start, stop):
                name = (int(ids[k]), int(rows[k]))
                if name not in where or name in done:
                    continue
                done.add(name)
                a, b = where[name]
                text = data[offsets[k - start]:offsets[k - start + 1]]
                if place[b - 1] + GRAM > len(text):
                    continue
                hashes = gram_hashes(text)
                begin, size = owners(hashes, place[a:b], width)
                own = np.flatnonzero(size)
                begin, size = begin[own], size[own]
                length = size + least - 1
                keys.append(anchor[a:b][own])
                docs.append(np.full(len(own), ids[k]))
                begins.append(begin + (int(rows[k]) << 40))
                sizes.append(size)
                digests.append(tk.span_hashes(text, begin, begin + length))
                at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                bodies.append(text[at])
        if not keys or not sum(map(len, keys)):
            return None
        key, doc, begin, size, digest = (np.concatenate(x) for x in (keys, docs, begins, sizes, digests))
        body = np.concatenate(bodies)
        ends = np.cumsum(size + least - 1)
        name = tk.mixed(digest ^ tk.mixed(key))
        order = np.lexsort((begin, doc, name))
        new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
        first = doc[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
        # Within the first document every copy of a context stays: each is an occurrence of its own.
        send, covered = order[doc[order] == first], order[doc[order] != first]
        part = (tk.mixed(key[send]) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(cuts)):
            own = send[by[cuts[p]:cuts[p + 1]]]
            length = size[own] + least - 1
            at = np.repeat(ends[own] - length - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            out.append((int(p), 0, _short(key[own]), doc[own].tobytes(), begin[own].tobytes(), size[own].astype(np.uint16).tobytes(),
                        body[at].tobytes()))
        for k in range(0, len(covered), 1 << 15):
            own = covered[k:k + (1 << 15)]
            out.append((int(name[own[0]] % np.uint64(parts)), 1, b"", doc[own].tobytes(), begin[own].tobytes(),
                        size[own].astype(np.uint16).tobytes(), b""))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 5))],
                        names=["part", "kind", "keys", "docs", "places", "sizes", "texts"])

    return run


# --- the suffix array of a part -----------------------------------------------------------------------------------------

def suffix_array(body: np.ndarray, at: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the suffixes at `at` (each up to `end`) that share `least` bytes with another one, sorted; and the common prefix
    of each with the one before (0 at a new beginning).

    Suffixes with equal first `least` bytes are brought together by a hash of these; the rest of each is sorted by words of
    eight bytes, and only where there are still equal ones."""
    head = tk.span_hashes(body, at, at + least)
    order = np.argsort(head, kind="stable")
    new = np.concatenate(([True], head[order][1:] != head[order][:-1]))
    alone = new & np.concatenate((new[1:], [True]))
    order = order[~alone]
    if not len(order):
        return order, np.zeros(0, np.int64)
    head = head[order]
    group = np.cumsum(np.concatenate(([True], head[1:] != head[:-1]))) - 1
    rest, length = at[order] + least, end[order] - at[order]
    common = np.zeros(len(order), np.int64)
    common[1:][group[1:] == group[:-1]] = least
    padded = np.concatenate((body, np.zeros(8, np.uint8)))
    index = np.arange(len(order))                  # positions whose group isn't sorted out yet
    depth = 0
    while len(index):
        left = np.clip(end[order[index]] - rest[index] - depth, 0, 8)
        word = np.zeros((len(index), 8), np.uint8)
        for k in range(8):
            word[:, k] = np.where(k < left, padded[np.minimum(rest[index] + depth + k, len(padded) - 1)], 0)
        word = word.view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((left, word, group[index]))
        order[index], rest[index], word, left = order[index][by], rest[index][by], word[by], left[by]
        own = group[index]
        inner = np.concatenate(([False], own[1:] == own[:-1]))
        differ = np.zeros(len(index), np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        common[index[inner]] = least + depth + _equal_bytes(differ)[inner]
        parted = inner & ((differ > 0) | (np.concatenate(([8], left[:-1])) < 8) | (left < 8))
        cut = ~inner | parted
        number = np.cumsum(cut) - 1
        stay = np.bincount(number)[number] > 1
        group[index] = number
        index, depth = index[stay], depth + 8
    shorter = np.minimum(end[order] - at[order], np.concatenate(([0], (end[order] - at[order])[:-1])))
    return order, np.minimum(common, shorter)


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of words."""
    out = np.zeros(len(differ), np.int64)
    top = differ.copy()
    live = np.ones(len(differ), bool)
    for _ in range(8):
        live &= (top >> np.uint64(56)) == 0
        out += live
        top <<= np.uint64(8)
    return out


def maximal_repeats(common: np.ndarray, left: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, behind the last, length, least document) of the intervals of the suffix array whose common prefix is at least
    `least` long and whose suffixes have different left bytes (left < 0: none to compare, so different from all).

    An interval is on the stack from its first suffix until the common prefix falls below its length; it then hands
    its left bytes and least document to the interval around it."""
    stack: list[list] = []                          # length, first suffix, left byte (-1: several), least document
    commons, lefts, docs = common.tolist(), left.tolist(), doc.tolist()
    commons.append(0)
    for k in range(1, len(commons)):
        length, first, side, lowest = commons[k], k - 1, lefts[k - 1], docs[k - 1]
        while stack and stack[-1][0] > length:
            top = stack.pop()
            if top[3] > lowest:
                top[3] = lowest
            if top[2] != side:
                top[2] = -1
            if top[2] < 0:
                yield top[1], k, top[0], top[3]
            first, side, lowest = top[1], top[2], top[3]
        if length < least:
            continue
        if stack and stack[-1][0] == length:
            top = stack[-1]
            if top[3] > lowest:
                top[3] = lowest
            if top[2] != side:
                top[2] = -1
        else:
            stack.append([length, first, side, lowest])


SPANS = "bucket int, docs binary, starts binary, lengths binary"


def _find(least: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Spans of a part's contexts that an earlier document holds too, by bucket of documents."""
        table = table.combine_chunks()
        kind = table.column("kind").to_numpy()
        docs, starts, lengths = [], [], []
        known = table.filter(pa.array(kind == 1))
        if known.num_rows:
            doc, begin = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in known.column(n)]) for n in ("docs", "places"))
            size = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in known.column("sizes")]).astype(np.int64)
            docs.append(doc), starts.append(begin), lengths.append(size + least - 1)
        own = table.filter(pa.array(kind == 0))
        if own.num_rows:
            for part in _repeats(own, least):
                docs.append(part[0]), starts.append(part[1]), lengths.append(part[2])
        if not docs or not sum(map(len, docs)):
            return pa.table([pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 3)], names=["bucket", "docs", "starts", "lengths"])
        doc, start, length = (np.concatenate(x) for x in (docs, starts, lengths))
        bucket = _bucket_of(doc, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(int(b), order[cuts[b]:cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts))]
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), *(
            pa.array([x[o].tobytes() for _, o in rows], pa.binary()) for x in (doc, start, length.astype(np.int32)))],
            names=["bucket", "docs", "starts", "lengths"])
    return run


def _repeats(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spans of the contexts of one part, some anchors at a time: only suffixes of one anchor can share `least` bytes."""
    key = _long(list(table.column("keys")))
    doc, begin = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(n)]) for n in ("docs", "places"))
    size = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("sizes")]).astype(np.int64)
    body = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("texts")])
    length = size + least - 1
    first = np.cumsum(length) - length
    turns = int(size.sum()) // SUFFIXES + 1
    turn = tk.mixed(key + np.uint64(1)) % np.uint64(turns)
    for k in range(turns):
        own = np.flatnonzero(turn == k)
        if len(own):
            n = length[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield from _anchors_repeats(key[own], doc[own], begin[own], size[own], body[at], least)


def _anchors_repeats(key, doc, begin, size, body, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    length = size + least - 1
    ends = np.cumsum(length)
    digest = tk.mixed(tk.span_hashes(body, ends - length, ends) ^ tk.mixed(key))
    order = np.lexsort((begin, doc, digest))
    new = np.concatenate(([True], digest[order][1:] != digest[order][:-1]))
    first = doc[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    again = order[doc[order] != first]
    yield doc[again], begin[again], length[again]
    # One context of each kind stands for all its copies in the first document: what covers it covers them.
    stand = order[new]
    copies = order[(doc[order] == first) & ~new]
    copy_of = (np.cumsum(new) - 1)[(doc[order] == first) & ~new]
    at = np.repeat(ends[stand] - length[stand] - (np.cumsum(size[stand]) - size[stand]), size[stand]) + np.arange(int(size[stand].sum()))
    context = np.repeat(np.arange(len(stand)), size[stand])
    step = np.arange(len(at)) - np.repeat(np.cumsum(size[stand]) - size[stand], size[stand])
    found, common = suffix_array(body, at, ends[stand][context], least)
    if not len(found):
        return
    owner = context[found]
    # Left byte of a suffix; at the beginning of a context there is nothing to extend to in this part.
    left = np.where(step[found] > 0, body[at[found] - 1].astype(np.int64), -1)
    groups = np.array(list(maximal_repeats(common, left, doc[stand][owner], least)), np.int64).reshape(-1, 4)
    if not len(groups):
        return
    members = groups[:, 1] - groups[:, 0]
    where = np.repeat(groups[:, 0] - (np.cumsum(members) - members), members) + np.arange(int(members.sum()))
    long, lowest = np.repeat(groups[:, 2], members), np.repeat(groups[:, 3], members)
    later = doc[stand][owner[where]] > lowest
    where, long = where[later], long[later]
    place = begin[stand][owner[where]] + step[found[where]]
    yield doc[stand][owner[where]], place, long
    if len(copies):     # further copies in the same document
        by = np.argsort(owner[where], kind="stable")
        lo, hi = np.searchsorted(owner[where][by], copy_of), np.searchsorted(owner[where][by], copy_of, "right")
        n = hi - lo
        pick = by[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        copy = np.repeat(copies, n)
        yield doc[copy], begin[copy] + step[found[where[pick]]], long[pick]


# --- documents ----------------------------------------------------------------------------------------------------------

def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as maximal runs: where each begins and ends."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(starts[order] + lengths[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _strip(key, spans: pa.Table, texts: pa.Table) -> pa.Table:
    """The kept bytes of each document of a bucket that loses some."""
    out = []
    if spans.num_rows and texts.num_rows:
        doc, start = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in spans.column(n)]) for n in ("docs", "starts"))
        length = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in spans.column("lengths")]).astype(np.int64)
        order = np.lexsort((start, doc))
        doc, start, length = doc[order], start[order], length[order]
        edges = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] >> 40 != start[:-1] >> 40), [True])))
        where = {(int(doc[a]), int(start[a] >> 40)): (a, b) for a, b in zip(edges[:-1], edges[1:])}
        done = set()
        for doc_id, row, text in zip(texts.column("doc_id").to_pylist(), texts.column("row").to_pylist(), texts.column("text")):
            if (doc_id, row) not in where or (doc_id, row) in done:
                continue
            done.add((doc_id, row))
            a, b = where[doc_id, row]
            begins, ends = merged(start[a:b] & PLACE, length[a:b])
            data = np.frombuffer(text.as_buffer(), np.uint8)
            gone = np.zeros(len(data) + 1, np.int64)
            gone[begins], gone[ends] = 1, -1
            kept = data[np.cumsum(gone)[:-1] == 0]
            out.append((doc_id, row, int((ends - begins).sum()), len(begins), kept.tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (
        pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "row", "n_removed", "n_spans", "kept"])


def _bit(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    return tk.mixed(doc.view(np.uint64) ^ tk.mixed(row.view(np.uint64) + np.uint64(1))) % np.uint64(FILTER_WORDS * 64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that a task's anchors lie in, as a filter of fixed size (8 MB) in slices."""
    words = np.zeros(FILTER_WORDS, np.uint64)
    for batch in batches:
        for docs, places in zip(batch.column("docs"), batch.column("places")):
            doc, row = np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(places.as_buffer(), np.int64) >> 40
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
            bit = _bit(doc[new], row[new])
            np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    yield _slices(words)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of (doc_id, row), as such a filter."""
    words = np.zeros(FILTER_WORDS, np.uint64)
    for batch in batches:
        doc, row = (np.ascontiguousarray(batch.column(n).to_numpy(zero_copy_only=False)) for n in ("doc_id", "row"))
        bit = _bit(doc, row)
        np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    yield _slices(words)


def _slices(words: np.ndarray) -> pa.RecordBatch:
    slices = words.reshape(SLICES, -1)
    used = np.flatnonzero(slices.any(1))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([slices[k].tobytes() for k in used], pa.binary())], ["slice", "bits"])


def _either(table: pa.Table) -> pa.Table:
    bits = None
    for value in table.column("bits"):
        own = np.frombuffer(value.as_buffer(), np.uint64)
        bits = own if bits is None else bits | own
    return pa.table([table.column("slice")[:1], pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])


def _filter(rows: DataFrame, marks) -> np.ndarray:
    got = rows.mapInArrow(marks, "slice int, bits binary").groupBy("slice").applyInArrow(_either, "slice int, bits binary").toArrow()
    words = np.zeros((SLICES, FILTER_WORDS // SLICES), np.uint64)
    for k, bits in zip(got.column("slice").to_pylist(), got.column("bits")):
        words[k] = np.frombuffer(bits.as_buffer(), np.uint64)
    return words.ravel()


def _wanted(shared, buckets: int):
    """Texts that the filter lets through, with their bucket. Those it lets through without need are left out by the join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = (np.ascontiguousarray(batch.column(n).to_numpy(zero_copy_only=False)) for n in ("doc_id", "row"))
            bit = _bit(doc, row)
            hit = (shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
            bucket = pa.array(_bucket_of(doc, buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bucket, *batch.columns], ["bucket", *batch.schema.names]).filter(pa.array(hit.astype(bool)))
    return run


def _numbers(keys: DataFrame) -> DataFrame:
    """(doc_id, digest, digest2, number) of the texts of every doc_id that has several: 0, 1, 2, ... within the doc_id.

    The texts of one doc_id (all rows without one, say) are numbered part by part, so no task holds them all. A place in a
    text has room for 2 ** 23 texts of one doc_id; more are refused, never mixed up."""
    placed = keys.withColumn("part", F.pmod("digest", F.lit(partitions(keys.sparkSession))))
    sizes = placed.groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("doc_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                          F.sum("n").over(Window.partitionBy("doc_id")).alias("texts")).where("texts > 1")
    number = F.col("start") + F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("digest", "digest2")) - 1
    found = placed.join(starts, ["doc_id", "part"]).select("doc_id", "digest", "digest2", number.alias("number"))
    return found.withColumn("number", F.when(F.col("number") >= TEXTS_OF_ID, F.raise_error(
        F.lit("more texts of one doc_id than can be told apart"))).otherwise(F.col("number")))


def dedup(docs: DataFrame, least: int = 50, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes, or their SHA-256 in hex) of every row of docs (doc_id, text): without
    the bytes that a string of `least` bytes covers which also starts in a document with a smaller doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    parts, buckets = min(partitions(spark), 1 << 15), min(2 * partitions(spark), 1 << 15)
    text = F.coalesce("text", F.lit(""))
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text).alias("digest"), F.xxhash64(F.lit(5), text).alias("digest2"), text.alias("text"))
    keys = freeze(named.select("doc_id", "digest", "digest2").distinct(), "text_keys")
    numbers = freeze(_numbers(keys), "text_numbers")
    name, row = ["doc_id", "digest", "digest2"], F.coalesce("number", F.lit(0)).cast("long").alias("row")
    owned = freeze(keys.join(numbers, name, "left").groupBy("digest", "digest2").agg(F.min(F.struct("doc_id", row)).alias("one")).select(
        "digest", "digest2", F.col("one.doc_id").alias("first"), F.col("one.row").alias("row")), "texts_by_digest")
    if numbers.isEmpty():
        named = named.withColumn("row", F.lit(0).cast("long"))
    else:
        named = named.join(numbers, name, "left").select(*named.columns, row)

    packed = named.select("doc_id", "row", "digest", "text").mapInArrow(
        _emit(least, parts), "part int, kind int, keys binary, docs binary, places binary")
    met = freeze(packed.groupBy("part").applyInArrow(_meet(buckets), MET), "shared_anchors")

    # Texts with anchors to follow, and of equal texts the first one: both filters let through a few more.
    firsts = owned.select(F.col("first").alias("doc_id"), "row")
    shared = spark.sparkContext.broadcast(_filter(met.select("docs", "places"), _marks) & _filter(firsts, _first_rows))
    texts = named.select("doc_id", "row", "text").mapInArrow(_wanted(shared, buckets), "bucket int, doc_id long, row long, text string")

    contexts = met.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_cut(least, parts), CONTEXTS)
    spans = contexts.groupBy("part").applyInArrow(_find(least, buckets), SPANS)
    cut = spans.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(
        _strip, "doc_id long, row long, n_removed long, n_spans long, kept binary")

    whole = text.cast("binary") if keep_bytes else F.sha2("text", 256)
    n = F.octet_length("text").cast("long")
    rows = named.select("doc_id", "row", "digest", "digest2", n.alias("n_bytes"), whole.alias("whole"))
    rows = rows.join(owned.drop("row"), ["digest", "digest2"]).withColumn(
        "copy", (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= least))
    cut = cut.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "n_removed", "n_spans",
                     (F.col("kept") if keep_bytes else F.sha2("kept", 256)).alias("kept"))
    rows = rows.join(cut, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")) & ~F.col("copy"), "left")
    nothing = F.lit(b"") if keep_bytes else F.sha2(F.lit(b""), 256)
    return rows.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept", "whole")).alias("kept"))
