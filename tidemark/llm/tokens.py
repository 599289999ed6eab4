"""Words and word hashes of whole texts, computed on the bytes of an Arrow column.

Texts are handled in pieces of about a megabyte (one longer text is its own piece), so
memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) per piece; a null text has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    offs = np.frombuffer(offsets, np.int64, count=n + 1 + at)[at:] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word (A-Z lower-cased), in text order."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e
    solid = ~_BLANK[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    some = offs[1:] > offs[:-1]
    heads, tails = offs[:-1][some], offs[1:][some] - 1
    first[heads] = solid[heads]
    last[tails] = solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    inside = np.arange(int(size.sum())) - np.repeat(at, size)
    value = (_LOWER[data[solid]].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[inside]
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64)), start, end


def word_bounds(start: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Word index at which each text begins, and the total: len(offs) entries."""
    return np.searchsorted(start, offs, "left")


_STEP = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring words; the length is part of the hash."""
    out = np.full(max(0, len(h) - k + 1), np.uint64(k), np.uint64)
    for i in range(k):
        out = out * _STEP[0] + h[i : len(h) - k + 1 + i]
        out = out ^ (out >> np.uint64(29))
    return mix(out)
