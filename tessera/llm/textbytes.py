"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Texts are handled in slices of a bounded number of bytes (or one text, if it is longer), so memory
does not grow with the number of rows in an Arrow batch.  Words and windows get 64-bit hashes from
prefix sums: one pass over the bytes, no Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64; kept for the usual sizes."""
    size = max(1 << 12, 1 << (n - 1).bit_length()) if n else 1 << 12
    key = (int(base), size)
    if key not in _powers:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        if size > 1 << 22:
            return np.multiply.accumulate(p)[:n]
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of values[start:end]; the same values give the same hash wherever they stand."""
    back = powers(inverse(base), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _ODD2)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(_BYTE[buf], _ODD), starts, ends, _ODD)


def window_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    base = _ODD2 if not salt else np.uint64(0xD6E8FEB86659FD93)
    seen = words if not salt else mix(words + np.uint64(salt))
    prefix = prefix_hash(seen, base)
    starts = np.arange(len(words) - k + 1)
    return range_hash(prefix, starts, starts + k, base)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls, with no copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs, buf


def slices(column, limit: int = SLICE_BYTES):
    """Yield (first row, offsets from 0, bytes) for runs of rows with at most ``limit`` bytes."""
    if not len(column):
        return
    offs, buf = column_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, offs[lo : hi + 1] - offs[lo], buf[offs[lo] : offs[hi]]
        lo = hi


def word_spans(offs: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word and, per text, the index of its first word (length rows + 1)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~_IS_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][np.diff(offs) > 0]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[at[1:] - 1] = inside[at[1:] - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)
