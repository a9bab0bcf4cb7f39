"""Vectorised words and word hashes over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Hashes are 64-bit: a polynomial over
random byte codes, taken from prefix sums, then mixed. Everything is NumPy over whole batches, no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20
_U = np.uint64


def _codes() -> np.ndarray:
    codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


_CODES = _codes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every bit of the hash depends on every bit of ``x``."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them, starting at 0."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return flat, at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, rows)
        start = min(end, rows)


def spans(flat: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of all words in order, and the offsets of the rows in them. ``offsets`` starts at 0;
    ``between`` tells for each byte whether it parts words."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    solid = ~between[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)  # a row ends before this byte
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    size = max(CHUNK_BYTES, 1 << int(len(flat) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_CODES[flat] * up[: len(flat)], dtype=np.uint64, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of the rows in them."""
    hashes, _, _, at = spans(flat, offsets)
    return hashes, at


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of each row, with repeats; a row of fewer words (but one at least) has its
    whole sequence as one. Also the offsets of the rows in them."""
    counts = np.diff(offsets)
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.zeros(int(each.sum()), dtype=np.uint64)
    at = np.concatenate([[0], np.cumsum(each)])
    row = np.repeat(np.arange(len(counts)), each)
    start = offsets[:-1][row] + np.arange(len(out)) - at[:-1][row]
    length = np.minimum(counts, n)[row]
    factor = _U(0x9FB21C651E98DF25)
    for i in range(n):
        here = i < length
        if here.all():
            out = mix(out * factor + hashes[start + i] + _U(1))
        else:
            out[here] = mix(out[here] * factor + hashes[(start + i)[here]] + _U(1))
    return out, at


def sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and the offsets of the rows in them."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(offsets)))
