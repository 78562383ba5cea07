"""Vectorised text kernels over Arrow string columns.

An Arrow string column is one contiguous UTF-8 buffer plus offsets, so words of
a whole batch of documents are found and hashed by array operations instead of
a Python loop per word.  A word is a maximal run of bytes other than 0x20 and
0x09-0x0D.  Its 64-bit hash is a polynomial over per-byte random values,
``sum(value[b_j] * P**j) * P**-start (mod 2**64)``, followed by a bijective
mixer; it depends on the word's bytes only, never on its place.

Every function takes and returns plain numpy arrays, holds no state besides
the cached power tables and is deterministic across processes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
CHUNK_BYTES = 1 << 19


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed)
        return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """Bijective finaliser; spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def byte_values(lower: bool, keep: np.ndarray | None = None) -> np.ndarray:
    """Random value per byte; A-Z share the values of a-z when ``lower``.

    Bytes outside ``keep`` (a boolean table) get 0 and so do not count.
    """
    v = _splitmix(256, 7) | U64(1)
    if lower:
        v[65:91] = v[97:123]
    if keep is not None:
        v = np.where(keep, v, U64(0))
    return v


PLAIN, LOWER = byte_values(False), byte_values(True)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES * 2, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_P, _P_INV):
            t = np.ones(size, U64)
            k = 1
            with np.errstate(over="ignore"):
                while k < size:
                    m = min(k, size - k)
                    t[k : k + m] = t[:m] * U64(pow(base, k, 1 << 64))
                    k += m
            out.append(t)
        _powers[size] = (out[0], out[1])
    return _powers[size]


@dataclass
class Words:
    """Words of some documents: ``doc`` is an index into the chunk's documents."""

    raw: np.ndarray  # uint8, the chunk's bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each document's first word; one entry more than documents
    bounds: np.ndarray  # byte offsets of the documents in raw

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def split_words(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Words:
    """Words of documents ``lo`` to ``hi`` (exclusive)."""
    a, b = int(offsets[lo]), int(offsets[hi])
    part = raw[a:b]
    bounds = offsets[lo : hi + 1] - a
    solid = np.empty(len(part) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[part], out=solid[1:-1])
    cut = solid[1:-1] & solid[:-2]  # inside a word
    inner = bounds[(bounds > 0) & (bounds < len(part))]
    cut[inner] = False
    begin = solid[1:-1] & ~cut
    start = np.flatnonzero(begin)
    last = solid[1:-1].copy()
    if len(part):
        last[:-1] &= ~cut[1:]
    end = np.flatnonzero(last) + 1
    first = np.searchsorted(start, bounds, "left")
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(part, start, end, doc, first, bounds)


def byte_sums(raw: np.ndarray, values: np.ndarray = PLAIN) -> np.ndarray:
    """Running sums from which the hash of any span of bytes follows."""
    total = np.zeros(len(raw) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values[raw] * _power_tables(len(raw) + 1)[0][: len(raw)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray, origin: np.ndarray | None = None) -> np.ndarray:
    """Hash of each span; ``origin`` says where its counted bytes begin, by default at ``start``."""
    inverse = _power_tables(len(total))[1]
    with np.errstate(over="ignore"):
        return mix64((total[end] - total[start]) * inverse[start if origin is None else origin])


def word_hashes(w: Words, values: np.ndarray = PLAIN) -> np.ndarray:
    """Hash of each word's bytes."""
    return span_hashes(byte_sums(w.raw, values), w.start, w.end)


_GRAM = U64(0xD6E8FEB86659FD93)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; entry i covers words i to i+n-1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out *= _GRAM
            out += h[k : k + m]
    return mix64(out)


def windows_inside(w: Words, n: int) -> np.ndarray:
    """Indices of words at which a run of ``n`` words of the same document starts."""
    m = len(w.doc) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])


def group_spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(keys)])))
