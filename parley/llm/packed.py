"""Packed blocks: many small records as one binary value a block, so that JVM rows are few and NumPy does the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 29  # of bitmaps of documents; false hits cost only work


def dealt(rows: np.ndarray, by: np.ndarray, blocks: int) -> pa.RecordBatch:
    """``(block, rows)``: structured rows packed into one binary value for each block that has any."""
    order = np.argsort(by, kind="stable")
    rows, by = rows[order], by[order]
    at = np.searchsorted(by, np.arange(blocks + 1))
    some = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[at[b] : at[b + 1]].tobytes() for b in some.tolist()], pa.binary())], names=["block", "rows"])


def unpacked(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``data[start:start + length]`` of many spans, laid end to end."""
    before = np.cumsum(lengths) - lengths
    return data[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]


def stand_in(column: Column) -> Column:
    """A number from 2**62 on that stands for a null id, from a hash of the row's content."""
    return F.lit(1 << 62) + F.pmod(F.xxhash64(column), F.lit(1 << 62))


def spot(column: str | Column) -> Column:
    """The hash by which a bitmap has an id."""
    return F.xxhash64(column)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed ids. It has 32 places an id, between ``LEAST_BITS`` and ``MOST_BITS`` bits of a place's number; at
    most 2**MOST_BITS / 64 words come to the driver, however many ids there are."""
    n = df.count()
    bits = min(max(LEAST_BITS, (32 * n).bit_length()), MOST_BITS)
    at = F.pmod(spot(column), F.lit(1 << bits))
    found = df.select(at.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def has(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
