"""Text columns as flat NumPy buffers, shared by the operators that run in Python.

A batch of rows is cut into chunks of about ``CHUNK`` bytes of whole texts, so the memory of a task does not depend
on the number of rows that Arrow puts in a batch. A single text longer than that is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
ROWS_PER_BATCH = 1000


def short_batches(spark) -> None:
    """Texts are long: 10,000 of them in one Arrow batch take tens of MB, several times over, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def give_back() -> None:
    """Memory that is free goes back to the system, which the allocators of Arrow and C else keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(run: Callable) -> Callable:
    """A task's function that gives freed memory back when it begins (a group may have left some) and ends: Spark keeps the
    worker for the next task."""

    @wraps(run)
    def wrapped(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def texts_of(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, last row + 1, bytes, offsets)``; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = 1 << 16


@lru_cache(maxsize=2)
def _powers(base: int, blocks: int) -> np.ndarray:
    p = np.full(blocks * _STEP + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, for hashes of windows of up to some hundred bytes at every place."""
    blocks = 1
    while blocks * _STEP < n:
        blocks *= 2
    return _powers(_BASE, blocks), _powers(pow(_BASE, -1, 1 << 64), blocks)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FOLDS = 64  # words of eight bytes that are folded for all spans at once; longer spans are hashed one by one


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; what lies behind the end is 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` (bytes) of many spans at once.

    Words of eight bytes are folded in turn, each by a bijection that is not linear, so no structure of a text makes
    collisions; the length goes in first. Where equality must be certain, ``equal_spans`` compares the bytes.
    """
    left = (ends - starts).astype(np.int64)
    h = mix64(left.astype(np.uint64) + np.uint64(_BASE))
    eights, open_, at = _eights(data), np.arange(len(left)), starts
    for _ in range(_FOLDS):
        if not len(open_):
            return h
        x = (h[open_] ^ (eights[at] & _MASKS[np.minimum(left, 8)])) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        h[open_] = x ^ (x >> np.uint64(29))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for k, a, n in zip(open_.tolist(), at.tolist(), left.tolist(), strict=True):
        h[k] ^= np.uint64(xxhash.xxh3_64_intdigest(data[a : a + n].data, seed=int(h[k])))
    return mix64(h) if len(open_) else h


def equal_spans(data: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the bytes of two spans each, ``data[a:a + a_size]`` and ``data[b:b + b_size]``, are the same."""
    out = a_size == b_size
    open_ = np.flatnonzero(out & (a != b))
    a, b, left = a[open_], b[open_], a_size[open_]
    eights = _eights(data)
    for _ in range(_FOLDS):
        if not len(open_):
            return out
        same = ((eights[a] ^ eights[b]) & _MASKS[np.minimum(left, 8)]) == 0
        out[open_[~same]] = False
        more = same & (left > 8)
        open_, a, b, left = open_[more], a[more] + 8, b[more] + 8, left[more] - 8
    for k, i, j, n in zip(open_.tolist(), a.tolist(), b.tolist(), left.tolist(), strict=True):
        out[k] = bool((data[i : i + n] == data[j : j + n]).all())
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A span of each distinct content, and the number of its content for every span. Hashes sort, bytes decide."""
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, rep = ends - starts, first[number]
    odd = np.flatnonzero(~equal_spans(data, starts, size, starts[rep], size[rep]))
    own: dict[bytes, int] = {}
    more: list[int] = []
    for k in odd.tolist():
        key = data[starts[k] : ends[k]].tobytes()
        if key not in own:
            own[key] = len(first) + len(more)
            more.append(k)
        number[k] = own[key]
    return (np.append(first, more) if more else first), number


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as ``(start, end, words before each text)``; UTF-8 keeps these bytes to themselves."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    black = ~_WHITE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = black.copy()
    begins[1:] &= ~black[:-1] | first[1:n]
    stops = np.zeros(n + 1, bool)
    stops[1:] = black
    stops[1:n] &= ~black[1:] | first[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive entries (order counts), without regard to text boundaries."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    m = np.uint64(0xA24BAED4963EE407)
    for k in range(size):
        out *= m
        out += h[k : k + n]
    return mix64(out)
