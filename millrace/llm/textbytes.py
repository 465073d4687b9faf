"""Numpy views of Arrow text columns and rolling hashes over them.

A hash of bytes is a polynomial in a fixed odd multiplier, modulo 2**64, over random values of the bytes; a prefix
sum gives the hash of any slice.  All functions work on a block of whole texts that lie end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
SHINGLE_FACTORS = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SECOND_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, _INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over the 64 bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and len(column) + 1 offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `limit` bytes of text, and one row at least, so that memory follows the longest text."""
    data, offsets = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums P of the polynomial: slice_hash(P, s, e) is the hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes outside 0x20, 0x09-0x0D) and the number of the first word of each text."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles of lower-cased texts (A-Z only), text after text, and their offsets.

    A text of fewer words has one shingle, the whole sequence; a text without words has none.
    """
    starts, ends, first = word_bounds(data, offsets)
    words = slice_hash(prefix_hash(data, LOWER_VALUES), starts, ends)
    n_words = np.diff(first)
    n_out = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out_offsets = np.concatenate(([0], np.cumsum(n_out)))
    head = np.repeat(first[:-1] - out_offsets[:-1], n_out) + np.arange(out_offsets[-1])
    size = np.repeat(np.minimum(n_words, width), n_out)
    total = size.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    for i in range(width):
        total = total + np.where(size > i, padded[head + i], np.uint64(0)) * SHINGLE_FACTORS[i]
    return mix(total), out_offsets
