"""Numpy helpers over Arrow string columns, shared by the operators.

A batch column is viewed as one byte array plus document offsets.  Words,
lines and rolling hashes are computed for all documents of a slice at once.
Slices hold about ``SLICE_BYTES`` of text (a longer document is a slice of its
own), so the working memory of a task depends on the longest document and not
on the batch.  Null text counts as empty everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_GRAM = np.uint64(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: separators ``[\x20\x09-\x0D]`` and everything but ``[0-9a-z]`` and bytes from 0x80 on (after lower-casing)
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, 9, 10, 11, 12, 13]] = True
ALNUM_SEP = np.ones(256, bool)
ALNUM_SEP[0x30:0x3A] = False
ALNUM_SEP[0x41:0x5B] = False
ALNUM_SEP[0x61:0x7B] = False
ALNUM_SEP[0x80:] = False

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, SLICE_BYTES + 1)
        a = np.full(m, _BASE, np.uint64)
        b = np.full(m, _BASE_INV, np.uint64)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): every output bit depends on every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (i, j) of about ``limit`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def cut(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return data[off[i]:off[j]], off[i:j + 1] - off[i]


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of True; runs stop at document ends."""
    n = len(member)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(member & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray):
    """(start, end, document) of every word; ``sep`` tells the separator bytes."""
    return runs(~sep[data], off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    code = _BYTE_CODE[LOWER] if lower else _BYTE_CODE
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * p[:-1], dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _GRAM)


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, hash) of every window of k consecutive items in one document."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out += h[j:j + n] * np.uint64(pow(0xD1342543DE82EF95, j, 2**64))
    ok = np.flatnonzero(doc[:n] == doc[k - 1:])
    return ok, mix(out[ok])


def first_of(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Index of the first item of each document (items sorted by document), plus the end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def per_doc(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count or sum of items by document."""
    if weights is None:
        return np.bincount(doc, minlength=n_docs).astype(np.int64)
    total = np.zeros(len(weights) + 1, np.int64)
    np.cumsum(weights, out=total[1:])
    f = first_of(doc, n_docs)
    return total[f[1:]] - total[f[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as the int64 that Spark stores."""
    return h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
