"""Vectorised text features over Arrow string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes, case-folded over ASCII and
Latin-1. Words never cross rows. Hashes are 64-bit and the same in every process. Null rows count
as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_GRAM = U(0xD6E8FEB86659FD93)
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

#: Bytes of text handled at a time: bounds the memory of a Python worker.
SLICE_BYTES = 1 << 19

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case of UTF-8 bytes, over ASCII and the Latin-1 letters."""
    b = LOW[raw]
    if len(b) > 1:
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        v = b[second]
        b[second] = np.where((v >= 0x80) & (v <= 0x9E) & (v != 0x97), v + 0x20, v)
    return b


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the offsets of the rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of some rows: hashes, byte spans in `data`, and the range of words of each row."""

    data: np.ndarray
    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(raw: np.ndarray, off: np.ndarray) -> Words:
    """off: of the rows in raw, beginning with 0."""
    n = len(raw)
    if n == 0:
        return Words(raw, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    b = fold(raw)
    w = WORD[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    edge = off[:-1][off[:-1] < n]
    before[edge] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(w & ~after) + 1
    up, down = _tables(n + 1)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[b] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    return Words(b, h, start, end, np.searchsorted(start, off))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; k - 1 fewer than words. Grams may cross rows: see `inside`."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    x = np.zeros(n, U)
    for i in range(k):
        x *= _GRAM
        x += h[i : i + n]
    return mix(x)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n grams of k words lie in one row."""
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    return left >= k


def as_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from flat values."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
