"""Near-duplicates among embeddings by an epsilon grid order join.

Unit vectors are projected onto leading principal directions (fitted on a bounded sample; they steer pruning only),
sorted by the grid cells of width epsilon that they fall in, and cut into blocks, which are intervals of that order.
Cosine >= c is distance <= epsilon = sqrt(2 - 2 c), so two blocks whose boxes of projections are further apart hold no
links. The blocks left are joined recursively: intervals are halved, halves that are provably distant are skipped, and
small ones are compared in full. Cosines are taken in single precision and, within rounding of the threshold, in double.

Vectors of single precision are kept as they are, all others as double.

Equal vectors are one class with a weight: they are counted, not paired. A task sends back the number of links of each
of its classes and a spanning forest of the links, never the links.

Defined cases: null and zero vectors and those with null or non-finite components link with nothing, whatever their
length; vectors of other lengths than the most frequent one link only among their own length; repeated rows are copies;
a vector id that occurs twice gives two rows with the same id; rows with null ids and equal vectors are like one id that
occurs often, at a number from 2**62 on by the vector's hash, so they are kept where no smaller id links with them, and a
component whose least number is such a one has a null ``component_id``; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components, forest
from parley.llm.packed import stand_in
from parley.llm.scratch import written
from parley.llm.textio import released

SAMPLE = 10_000  # vectors that the principal directions are fitted on
DIRECTIONS = 8
BLOCK = 4096
LEAF = 512
MARGIN = 1e-4


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else the squares of very large or small numbers are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(classes: DataFrame, size: int, kind: str, sample: int = SAMPLE) -> np.ndarray:
    rows = classes.filter(F.length("raw") == np.dtype(kind).itemsize * size).orderBy(F.xxhash64("raw"), "raw").limit(sample).select("raw").toArrow()
    if not rows.num_rows:
        return np.zeros((size, min(DIRECTIONS, size)))
    x = unit(np.frombuffer(b"".join(rows.column(0).to_pylist()), kind).reshape(-1, size))
    _, vectors = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(axis=0), x.mean(axis=0)))
    return vectors[:, ::-1][:, :DIRECTIONS].copy()


def join_blocks(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, least: float):
    """Yield ``(rows of x, rows of y)`` of the links; of a block with itself each once."""
    epsilon = np.sqrt(2 - 2 * least) + 1e-9
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(axis=0) - py[c:d].max(axis=0), py[c:d].min(axis=0) - px[a:b].max(axis=0)))
        if (gap * gap).sum() > epsilon * epsilon:
            continue
        if max(b - a, d - c) > LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            firsts = [(a, m), (m, b)] if b - a > LEAF else [(a, b)]
            seconds = [(c, n), (n, d)] if d - c > LEAF else [(c, d)]
            todo += [(*f, *s) for f in firsts for s in seconds]
            continue
        cos = x32[a:b] @ y32[c:d].T
        if cos.max() < least - MARGIN:
            continue
        i, j = np.nonzero(cos >= least - MARGIN)
        near = np.abs(cos[i, j] - least) <= MARGIN
        i, j = i + a, j + c
        good = ~near
        at = np.flatnonzero(near)
        good[at] = np.einsum("ij,ij->i", x[i[at]], y[j[at]]) >= least
        if same:
            good &= i < j
        yield i[good], j[good]


def near_duplicates(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row."""
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))
    marked = df.select(F.col(id_col).cast("bigint").alias("i"), F.when(sound, vector).alias("vector"))

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.fill_null(0).to_numpy().astype(kind) + np.dtype(kind).type(0)  # -0.0 is 0.0
            raw = [flat[ends[k] : ends[k + 1]].tobytes() if lists[k].is_valid else None for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["i", "raw"])

    rows = written(marked.mapInArrow(pack, "i bigint, raw binary"), "vectors")
    classes = written(rows.filter("raw IS NOT NULL").groupBy("raw").agg(F.coalesce(F.min("i"), stand_in(F.col("raw"))).alias("rep"), F.count("*").alias("weight"), F.min("i").isNull().alias("nameless")), "vector-classes")
    sizes = [r.n // np.dtype(kind).itemsize for r in classes.groupBy(F.length("raw").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()]
    if not sizes:
        return rows.select(F.col("i").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("i").alias("component_id"), F.lit(True).alias("kept"))
    axes = directions(classes, sizes[0], kind)
    blocks = written(_blocks(classes, axes, np.sqrt(2 - 2 * least), kind), "vector-blocks")
    found = written(_joined(blocks, axes, least, kind), "vector-links")

    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("b IS NOT NULL"))
    known = (
        classes.join(links, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("raw", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("least"), F.when(F.col("nameless"), F.col("rep")).alias("own"))
    )
    named = F.col("least")
    nameless = classes.filter("nameless").select(F.col("rep").alias("least"), F.lit(True).alias("unnamed"))
    if not nameless.isEmpty():
        known = known.join(nameless, "least", "left")
        named = F.when(F.col("unnamed").isNull(), F.col("least"))
    # Without a sound vector a row is alone; a null id stands at its class's number where no id does.
    alone = F.col("least").isNull()
    return rows.join(known, "raw", "left").select(
        F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(alone, F.col("i")).otherwise(named).alias("component_id"),
        (alone | F.coalesce(F.coalesce("i", "own") == F.col("least"), F.lit(False))).alias("kept"),
    )


def _blocks(classes: DataFrame, axes: np.ndarray, epsilon: float, kind: str) -> DataFrame:
    """The classes in epsilon grid order, cut into blocks with the box of their projections."""
    size, k = axes.shape
    nbytes_of_size = np.dtype(kind).itemsize * size

    @released
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            own = [len(r) == nbytes_of_size for r in raw]
            p = np.zeros((len(raw), k))
            if any(own):
                p[own] = unit(np.frombuffer(b"".join(r for r, o in zip(raw, own, strict=True) if o), kind).reshape(-1, size)) @ axes
            cells = np.floor(p / epsilon).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), k).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(r) for r in raw], pa.int32()), lists], names=["rep", "weight", "raw", "bytes", "cells"])

    placed = classes.select("rep", "weight", "raw").mapInArrow(project, "rep bigint, weight bigint, raw binary, bytes int, cells array<int>")
    order = ["bytes", "cells", "rep"]
    # Pairs of blocks grow with the square of their number, so there are no more parts than full blocks.
    parts = max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // BLOCK)))

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, held = TaskContext.get().partitionId() << 24, 0, []

        def block(rows: list) -> pa.RecordBatch:
            nonlocal number
            reps, weights, raw = (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), b"".join(r[2] for r in rows))
            nbytes = len(rows[0][2])
            p = unit(np.frombuffer(raw, kind).reshape(len(rows), -1)) @ axes if nbytes == nbytes_of_size else np.zeros((len(rows), k))
            lo, hi = p.min(axis=0), p.max(axis=0)
            number += 1
            values = [base + number - 1, nbytes, int(np.floor(lo[0] / epsilon)), int(np.floor(hi[0] / epsilon)), lo.tolist(), hi.tolist(), reps.tobytes(), weights.tobytes(), raw]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "bytes", "first", "last", "lo", "hi", "reps", "weights", "raw"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and (len(held) == BLOCK or len(held[0][2]) != len(row[2])):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(cut, "block bigint, bytes int, first int, last int, lo array<double>, hi array<double>, reps binary, weights binary, raw binary")


def _joined(blocks: DataFrame, axes: np.ndarray, least: float, kind: str) -> DataFrame:
    """Rows ``(a, null, links of a)`` and forest links ``(a, b, null)`` of every pair of blocks that may hold links."""
    epsilon = float(np.sqrt(2 - 2 * least)) + 1e-9
    box = blocks.select("block", "bytes", "first", "last", "lo", "hi")
    left = box.select(*(F.col(c).alias(f"l_{c}") for c in box.columns)).withColumn("cell", F.explode(F.sequence("l_first", F.col("l_last") + 1)))
    right = box.withColumn("cell", F.col("first"))
    gaps = F.zip_with(F.zip_with("l_lo", "hi", lambda x, y: x - y), F.zip_with("lo", "l_hi", lambda x, y: x - y), lambda g, h: F.greatest(g, h, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= epsilon * epsilon
    later = (F.col("first") > F.col("l_first")) | ((F.col("first") == F.col("l_first")) & (F.col("block") >= F.col("l_block")))
    pairs = left.join(right, "cell").filter((F.col("l_bytes") == F.col("bytes")) & later & near).select(F.col("l_block").alias("x"), F.col("block").alias("y"))
    # Each side of a pair fetches its block, and the two meet once: a block's bytes move once a pair.
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    data = blocks.select("block", "reps", "weights", "raw")
    parts = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = sides.join(data, "block").repartition(parts, "x", "y").sortWithinPartitions("x", "y", "block")
    size = axes.shape[0]

    def compare(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        reps, weights, vectors = [], [], []
        same = len(rows) == 1
        for row in (rows[0], rows[-1]):
            reps.append(np.frombuffer(row["reps"], np.int64))
            weights.append(np.frombuffer(row["weights"], np.int64))
            vectors.append(unit(np.frombuffer(row["raw"], kind).reshape(len(reps[-1]), -1)))
        project = axes if vectors[0].shape[1] == size else np.zeros((vectors[0].shape[1], 1))
        counts = [np.zeros(len(r), np.int64) for r in reps]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in join_blocks(vectors[0], vectors[0] @ project, vectors[1], vectors[1] @ project, same, least):
            counts[0] += np.bincount(i, weights[1][j], len(reps[0])).astype(np.int64)
            counts[1] += np.bincount(j, weights[0][i], len(reps[1])).astype(np.int64)
            a, b = np.concatenate([a, reps[0][i]]), np.concatenate([b, reps[1][j]])
            if len(a) > 500_000:
                a, b = forest(a, b)
        a, b = forest(a, b)
        for r, c in zip(reps, counts, strict=True):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.nulls(len(at), pa.int64()), pa.array(c[at])], names=["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["x"], held[0]["y"]) != (row["x"], row["y"]):
                    yield from compare(held)
                    held = []
                held.append(row)
        if held:
            yield from compare(held)

    return work.mapInArrow(run, "a bigint, b bigint, n bigint")

