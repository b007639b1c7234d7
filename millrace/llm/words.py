"""Word scanning over whole Arrow string columns with numpy.

Texts are handled as UTF-8 bytes. Both word classes are unions of ASCII bytes and of all bytes
of multi-byte characters, so byte runs and character runs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text scanned at once; a single longer text is scanned alone.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def _class(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text in lower case.
ALNUM = _class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers for a slice; those for a single longer text are made for it and not kept."""
    return _powers(_BASE, SLICE_BYTES + 1), _powers(_BASE_INV, SLICE_BYTES + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Hashes:
    """64-bit hashes of parts of some bytes: a polynomial, mixed with the length."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n <= SLICE_BYTES:
            power, self.inverse = _kept_powers()
        else:
            power, self.inverse = _powers(_BASE, n + 1), _powers(_BASE_INV, n + 1)
        self.total = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[start]) * self.inverse[start]
        return mixed(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of some rows: word w is ``data[start[w]:end[w]]``; row r has the words
    ``ptr[r]:ptr[r + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return Hashes(self.data).of(self.start, self.end) if len(self.start) else np.empty(0, dtype=U64)


def scan(data: np.ndarray, offsets: np.ndarray, word_class: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = word_class[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False  # no word runs on from the row before
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of about ``size`` bytes; every row in one piece, whole."""
    _, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last - first
        first = last


def scans(column: pa.Array, word_class: np.ndarray, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """(first row, words) for each piece of the column."""
    for first, n in slices(column):
        yield first, scan(*text_bytes(column.slice(first, n)), word_class, lower)


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values; entry i covers i to i + width - 1."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(width):
        out *= U64(base)
        out += h[j : j + n]
    return mixed(out)
