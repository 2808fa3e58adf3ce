"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of characters other than space, \\t, \\n, \\v, \\f and \\r.
All of these are single bytes in UTF-8, so words are found on the raw bytes without
decoding. Every function treats a null text as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  absent from other C libraries
except (OSError, AttributeError):
    _LIBC = None

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at once; one longer text is a chunk of its own.
CHUNK = 1 << 20


def relax() -> None:
    """Give memory that a batch has freed back to the system: workers live on, beside others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length rows + 1) of a string column; nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def chunks(ends: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes (or one row)."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for k, base in (("up", _ODD), ("down", _INVERSE)):
            p = np.full(max(n, CHUNK + 4096), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, ends: np.ndarray, i: int, j: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows i..j: 64-bit hashes, starts and ends (relative to ends[i]), and row pointers of length j - i + 1."""
    lo, hi = int(ends[i]), int(ends[j])
    b = data[lo:hi]
    if lower:
        b = _LOWER[b]
    n = len(b)
    inside = ~_SPACE[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[i + 1 : j] - lo  # a word never runs from one row into the next
    cuts = cuts[(cuts > 0) & (cuts < n)]
    if len(cuts):
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[b] * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, ends[i : j + 1] - lo)


def shingles(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width`-word shingles of each row, and row pointers; a row with fewer words has its whole sequence as one shingle, one without words none."""
    n = np.diff(at)
    k = len(h) - width + 1
    out = np.zeros(max(k, 0), np.uint64)
    if k > 0:
        for d in range(width):
            out = mix(out * _ODD + h[d : d + k] + _U(d + 1))
    # positions whose shingle stays inside its row
    starts = np.repeat(at[:-1], np.maximum(n - width + 1, 0))
    counts = np.maximum(n - width + 1, 0)
    ptr = np.concatenate(([0], np.cumsum(np.where((n > 0) & (n < width), 1, counts))))
    full = np.concatenate(([0], np.cumsum(counts)))
    pos = starts + (np.arange(full[-1]) - np.repeat(full[:-1], counts))
    values = out[pos] if len(pos) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if not len(short):
        return values, ptr
    result = np.empty(ptr[-1], np.uint64)
    mask = np.ones(ptr[-1], bool)
    mask[ptr[short]] = False
    result[mask] = values
    for r in short:
        x = np.zeros(1, np.uint64)
        for d in range(int(n[r])):
            x = mix(x * _ODD + h[at[r] + d] + _U(d + 1))
        result[ptr[r]] = mix(x + _U(0xA5A5A5A5 + int(n[r])))[0]
    return result, ptr
