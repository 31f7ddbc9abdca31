"""Vectorised text kernels that run inside Arrow tasks: byte spans of words, their hashes, and shingle sets.

Texts are read straight from Arrow's string buffers. All hashes are 64-bit polynomials over whole words, computed
from one prefix array per block, so the cost is a few passes over the bytes and no Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, row after the last, bytes, offsets from 0."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_LIBC: list = []


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers live on, and the next stage's tasks run beside them."""
    pa.default_memory_pool().release_unused()
    if not _LIBC:
        try:
            _LIBC.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _LIBC.append(lambda _: 0)
    _LIBC[0](0)


def edge_flags(n: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the first and of the last byte of every non-empty row."""
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    return first, last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no white space), and the words before each row."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = WHITE[data]
    first, last = edge_flags(len(data), offsets)
    first[1:] |= white[:-1]
    last[:-1] |= white[1:]
    starts = np.flatnonzero(first & ~white)
    ends = np.flatnonzero(last & ~white) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from one prefix array of the block."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_ORDER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted set of k-word shingle hashes of every row, of the lower-cased (A-Z) text.

    A row with fewer than k words has one shingle, the whole sequence; a row without words has none.
    """
    low = LOWER[data]
    starts, ends, before = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    if len(words) >= k:
        run = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            run += words[j : len(words) - k + 1 + j] * _ORDER[j]
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(run[lo : hi - k + 1])
        elif hi > lo:
            own = words[lo:hi]
            yield mix((own * _ORDER[k : k + hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
        else:
            yield run[:0]
