"""Word and shingle hashing over UTF-8 bytes, and Arrow batch helpers.

A word is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D`` (none of these bytes
occurs inside a multi-byte UTF-8 character).  Words get 64-bit hashes from a prefix sum of
``table[byte] * P**position`` (mod 2**64), so a whole text is hashed by a few numpy passes.
Long texts are hashed in blocks that end at white space; memory follows the block, not the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
_BLOCK = 1 << 20
_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of every word."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(b) + 1, np.int8)
    inside = ~_IS_SPACE[b]
    edge[1:-1] = np.diff(inside.view(np.int8))
    edge[0], edge[-1] = inside[0], -int(inside[-1])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word span; equal bytes (after A-Z lower-casing if asked) hash equal."""
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        at = int(starts[lo])
        hi = len(starts) if len(b) - at <= _BLOCK else max(lo + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        part = b[at:int(ends[hi - 1])]
        v = _TABLE[_LOWER[part] if lower else part]
        p, inv = _power_tables(len(part) + 1)
        acc = np.zeros(len(part) + 1, _U)
        np.cumsum(v * p[:len(part)], dtype=_U, out=acc[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = (acc[e] - acc[s]) * inv[s] + (e - s).astype(_U)
        lo = hi
    return mix(out)


def shingle_hashes(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of ``n`` word hashes; of the whole sequence when there are fewer words."""
    n = min(n, len(words))
    if not n:
        return words[:0]
    m = len(words) - n + 1
    acc = np.full(m, n, _U)
    for j in range(n):
        acc = acc * _U(0xA0761D6478BD642F) + words[j:j + m]
        acc ^= acc >> _U(29)
    return mix(acc)


def text_shingles(b: np.ndarray, lower: bool = True) -> np.ndarray:
    s, e = word_spans(b)
    return shingle_hashes(word_hashes(b, s, e, lower))


def byte_rows(col: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each value of a string column, without copying; null gives no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            return [x for c in col.chunks for x in byte_rows(c)]
    if not len(col):
        return []
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset:col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(col.is_valid()) if col.null_count else None
    empty = np.zeros(0, np.uint8)
    return [empty if valid is not None and not valid[i] else d[o[i]:o[i + 1]] for i in range(len(col))]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that what a task builds stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U, copy=False).view(np.int64)
