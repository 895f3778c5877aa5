"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes, without a Python object per word.

Everything here works on one block of a record batch (a few hundred documents, or one long one), so memory is bounded by the
longest document. All hashes are fixed functions of the bytes: a repeated task gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240917))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
# Separators of plain words: all of ASCII but letters and digits.
PUNCTUATION = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])
SHINGLE = 5
_SHINGLE_CODES = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit of x moves every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverses for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers[0], _powers[1]


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of runs of rows of up to `limit` bytes, or one longer row. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, stop, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
        start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes that are no white space), and each document's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~white[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = inside[0]
    edge[1:n] = inside[1:] != inside[:-1]
    edge[n] = inside[-1]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero((edge[:n] | first[:n]) & inside)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    ends = np.flatnonzero((edge | first) & before)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span, by prefix sums of a polynomial."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODE[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and each document's first word."""
    starts, ends, firsts = word_bounds(data, offsets, white)
    return (span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)), firsts


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of `size` words; of the whole sequence, if it is shorter."""
    k = min(size, len(hashes))
    if not k:
        return hashes
    out = np.full(len(hashes) - k + 1, np.uint64(k))
    for j in range(k):
        out += hashes[j:len(hashes) - k + 1 + j] * _SHINGLE_CODES[j]
    return mixed(out)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every document."""
    for start, stop, data, offsets in blocks(column):
        hashes, firsts = words(data, offsets)
        for row in range(start, stop):
            yield row, np.unique(shingles(hashes[firsts[row - start]:firsts[row - start + 1]]))
