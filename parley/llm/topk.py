"""Exact top-k search by inner product over KD-trees, one a shard.

Components become ``floor(scale * x)``, so scores are integers. Rows are packed into shards of at most ``SHARD`` vectors as
they are read. A shard's KD-tree halves the rows at the median of the widest dimension, down to leaves of ``LEAF``, with a
tight bounding box on every node. No vector in a box scores more than the sum, over dimensions, of the larger of the
query's component times the box's low or high end. A query goes through a tree best bound first and stops where the best
bound left is below its k-th score so far.

Queries meet shards in blocks: groups of about ``GROUP`` queries, and buckets of about ``PER_TASK`` shards, are joined on the
pair's key. In a task, a query carries its k-th score from shard to shard. The first bucket is searched before the others, and
the k-th scores that it gives go along with the queries to all others; so these send back only what may still count.

Defined cases: vectors that are null or hold null or non-finite components neither ask nor answer; vectors of different
length are compared as if the shorter one ended in zeros; a query's own rows are those with its id; rows that share another
id are answers each; of query rows that share an id, the one whose numbers come first as bytes asks; a null id asks never,
and as an answer comes after all others of its score; scores beyond 64 bits become the largest or smallest long; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.scratch import written
from parley.llm.textio import released

SHARD = 1 << 14
LEAF = 128
GROUP = 4096
PER_TASK = 4
EXACT = 2.0**53  # sums of products of whole numbers below this are exact in double precision
NONE = np.iinfo(np.int64).max  # stands for a null id
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class Tree:
    """A KD-tree over the rows of ``x``, which hold whole numbers as doubles."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        self.parts, self.children = [(0, len(x))], [None]
        lows, highs, todo = [], [], 0
        while todo < len(self.parts):
            a, b = self.parts[todo]
            own = x[order[a:b]]
            lows.append(own.min(axis=0))
            highs.append(own.max(axis=0))
            if b - a > leaf:
                spread = highs[-1] - lows[-1]
                if spread.any():
                    m = (b - a) // 2
                    order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], m)]
                    self.children[todo] = len(self.parts)
                    self.parts += [(a, a + m), (a + m, b)]
                    self.children += [None, None]
            todo += 1
        self.x, self.ids = x[order], ids[order]
        self.low, self.high = np.array(lows), np.array(highs)
        self.most = float(np.abs(x).max(initial=0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score that a box may hold, for each query and node."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of what is known (``scores``, ``ids``) and this tree, as far as they reach ``least``."""
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < (least if len(scores) < k else max(least, scores[-1])):
                break
            child = self.children[node]
            if child is not None:
                for c in (child, child + 1):
                    heapq.heappush(heap, (-bounds[c], c))
                continue
            a, b = self.parts[node]
            found = self.x[a:b] @ query
            good = (self.ids[a:b] != own) & (found >= (least if len(scores) < k else max(least, scores[-1])))
            if good.any():
                scores, ids = np.concatenate([scores, found[good].astype(scores.dtype)]), np.concatenate([ids, self.ids[a:b][good]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
        return scores, ids


def whole(x: np.ndarray, dim: int, exact: bool) -> np.ndarray:
    """Rows filled up with zeros; as Python's whole numbers where doubles would not be exact."""
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    return x if exact else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _shards(df: DataFrame, vector: Column, identity: Column, scale: float) -> DataFrame:
    """``(shard, n, dim, ids, x)``: rows packed as they are read."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = df.select(identity.cast("bigint").alias("i"), vector.cast("array<double>").alias("v")).filter(finite)

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def shard() -> pa.RecordBatch:
            nonlocal number, held, n
            dim = max(x.shape[1] for _, x in held)
            ids, x = np.concatenate([i for i, _ in held]), np.concatenate([np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for _, x in held])
            kind = next((t for t in ("<i2", "<i4") if not x.size or np.abs(x).max() <= np.iinfo(t).max), "<f8")
            values, kinds = [number, len(ids), dim, kind, ids.tobytes(), x.astype(kind).tobytes()], (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
            number, held, n = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["shard", "n", "dim", "kind", "ids", "x"])

        for batch in batches:
            ids, lists = batch.column(0).fill_null(NONE).to_numpy(), batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), np.floor(lists.values.to_numpy(zero_copy_only=False) * scale) + 0.0
            size = np.diff(offsets)
            for dim in np.unique(size).tolist():  # rows of one length at a time
                rows = np.flatnonzero(size == dim)
                x = flat[offsets[rows][:, None] + np.arange(dim)]
                for a in range(0, len(rows), SHARD):
                    if n and n + min(SHARD, len(rows) - a) > SHARD:
                        yield shard()
                    held.append((ids[rows[a : a + SHARD]], x[a : a + SHARD]))
                    n += len(held[-1][0])
        if n:
            yield shard()

    return sound.mapInArrow(pack, "shard bigint, n int, dim int, kind string, ids binary, x binary")


def _asking(shards: DataFrame, every: int) -> DataFrame:
    """``(query, x)`` of the rows whose id ``every`` divides, each id once; ``x`` without zeros at its end."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], r["kind"]).reshape(r["n"], r["dim"]).astype("<f8")
                rows = np.flatnonzero((ids % every == 0) & (ids != NONE))
                size = [int(np.flatnonzero(v).max(initial=-1)) + 1 for v in x[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([v[:s].tobytes() for v, s in zip(x[rows], size, strict=True)], pa.binary())], names=["query", "x"])

    return shards.mapInArrow(pick, "query bigint, x binary").groupBy("query").agg(F.min("x").alias("x"))


def _search(cells: DataFrame, k: int) -> DataFrame:
    """``(query, vec, score)``; a partition holds rows by cell, in each the queries first, then one shard after the other."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, kept = None, [], []

        def results() -> pa.RecordBatch:
            q = np.repeat(np.array([a[0] for a in asked], np.int64), [len(s) for s, _ in kept])
            score = [min(max(int(v), LOWEST), HIGHEST) for s, _ in kept for v in s.tolist()]
            vec = np.concatenate([np.zeros(0, np.int64), *(i for _, i in kept)])
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(vec, mask=vec == NONE), pa.array(score, pa.int64())], names=["query", "vec", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if cell != (r["g"], r["s"]):
                    if asked:
                        yield results()
                    cell, asked, kept = (r["g"], r["s"]), [], []
                if r["queries"] is not None:
                    asked = [(a["query"], np.frombuffer(a["x"], "<f8"), LOWEST if a["least"] is None else a["least"]) for a in r["queries"]]
                    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
                elif asked:
                    kept = _through(r, asked, kept, k)
        if asked:
            yield results()

    return cells.mapInArrow(run, "query bigint, vec bigint, score bigint")


def _through(shard: dict, asked: list, kept: list, k: int) -> list:
    """What the queries know after a shard."""
    dim = max(shard["dim"], *(len(a[1]) for a in asked))
    x = np.frombuffer(shard["x"], shard["kind"]).reshape(shard["n"], shard["dim"]).astype(np.float64)
    q = np.array([np.pad(a[1], (0, dim - len(a[1]))) for a in asked]).reshape(len(asked), dim)
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dim, 1) < EXACT
    x, q = whole(x, dim, exact), whole(q, dim, exact)
    tree = Tree(x, np.frombuffer(shard["ids"], np.int64))
    out = []
    for a in range(0, len(asked), 1024):
        bounds = tree.bounds(q[a : a + 1024])
        for j, row in enumerate(bounds, a):
            scores, ids = kept[j]
            scores = scores if exact else scores.astype(object)
            out.append(tree.search(q[j], asked[j][0], row.tolist(), k, scores, ids, asked[j][2]))
    return out


def search(df: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows for each row whose id ``every`` divides."""
    spark = df.sparkSession
    shards = written(_shards(df, F.col(vector_col), F.col(id_col), scale), "top-k-shards")
    queries = written(_asking(shards, every), "top-k-queries")
    groups, buckets = max(1, -(-queries.count() // GROUP)), max(1, -(-shards.count() // PER_TASK))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), groups * buckets // 64)
    spread = shards.withColumn("s", F.pmod(F.xxhash64("shard"), F.lit(buckets))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def found(asking: DataFrame, first: bool) -> DataFrame:
        blocks = asking.groupBy(F.pmod(F.xxhash64("query"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("query", "x", "least")).alias("queries"))
        blocks = blocks.select(F.col("g").cast("int"), F.explode(F.sequence(F.lit(0 if first else 1).cast("bigint"), F.lit(0 if first else buckets - 1).cast("bigint"))).alias("s"), "queries")
        cells = blocks.unionByName(spread.filter(F.col("s") == 0 if first else F.col("s") > 0), allowMissingColumns=True)
        dealt = cells.repartition(parts, "g", "s").sortWithinPartitions("g", "s", F.col("queries").isNull(), "shard")
        return written(_search(dealt, k), "top-k-found")

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec"))
    near = found(queries.withColumn("least", F.lit(None).cast("bigint")), True)
    if buckets > 1:
        least = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
        near = near.unionByName(found(queries.join(least, "query", "left"), False))
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
