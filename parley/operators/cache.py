"""Response cache: similarity of prompts, safety of a hit, eviction; replay of a log of gets and sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that turn a prompt's meaning around.
POLARITY = {"not": -1, "no": -1, "never": -1, "without": -1, "disable": -1, "remove": -1, "enable": 1, "add": 1, "allow": 1, "with": 1}
THRESHOLD = 0.92
CLOSE = 1e-10  # far above the rounding errors of a cosine in double precision
AT_ONCE = 128  # queries whose scores with a block are held together


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _blocks(df: DataFrame, names: list[str], rows: int, name: str) -> DataFrame:
    """Ids and vectors as lists of about ``rows`` each, in no more parts than lists: parts meet parts, empty ones too."""
    n = max(1, -(-df.count() // rows))
    pair = F.struct(F.col(names[0]).cast("bigint").alias("id"), F.col(names[1]).cast("array<double>").alias("x"))
    return df.filter(F.col(names[0]).isNotNull()).groupBy(F.pmod(F.xxhash64(*names), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(pair).alias(name)).select(name).coalesce(n)


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors filled up with zeros, and lengths (-1: null, or with a null inside)."""
    ids, lists = rows.flatten()
    offsets, flat = lists.offsets.to_numpy(), lists.values
    values, holes = flat.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    size = np.diff(offsets)
    size = np.where(lists.is_null().to_numpy(zero_copy_only=False) | (holes[offsets[1:]] > holes[offsets[:-1]]), -1, size)
    x = np.zeros((len(ids), max(int(size.max(initial=0)), 0)))
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        x[own, :n] = values[offsets[own][:, None] + np.arange(n)]
    return ids.to_numpy(), x, size


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``dot`` of rows, added in its order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out = out + a[:, d] * b[:, d]
    return out


def _possible(q: tuple, v: tuple, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of queries and vectors, whether they can't be compared, and cosines, of all that the ``k`` nearest of a
    block may hold. Products of matrices come within ``CLOSE`` of a cosine, so its millionths lie between two whole
    numbers; a vector is out where the larger comes after the smaller one of ``k`` others.
    """
    (q_ids, q_x, q_size), (v_ids, v_x, v_size) = q, v
    dim = max(q_x.shape[1], v_x.shape[1])
    q_x, v_x = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q_x, v_x))
    order = np.argsort(v_ids, kind="stable")
    v_ids, v_x, v_size = v_ids[order], v_x[order], v_size[order]
    with np.errstate(all="ignore"):
        q_norm, v_norm = np.sqrt(_summed(q_x, q_x)), np.sqrt(_summed(v_x, v_x))
        for a in range(0, len(q_ids), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            near = (q_x[part] @ v_x.T) / (q_norm[part, None] * v_norm)
            near = np.where(np.isnan(near), 4.0, near)  # NaN comes first, as in an ORDER BY
            none = (q_size[part, None] != v_size) | (q_size[part, None] < 0)
            near[none] = -4.0
            low, high = np.floor((near - CLOSE) * 1e6 + 0.5), np.floor((near + CLOSE) * 1e6 + 0.5)
            own = q_ids[part, None] == v_ids
            low[own], high[own] = -np.inf, -np.inf
            if len(v_ids) > k:
                least = np.partition(low, len(v_ids) - k, axis=1)[:, len(v_ids) - k, None]
                tied = np.cumsum(low == least, axis=1)  # ids ascend
                last = k - (low > least).sum(axis=1, keepdims=True)
                keep = (high > least) | ((high == least) & (tied - (low == least) < last))
            else:
                keep = np.ones(low.shape, bool)
            i, j = np.nonzero(keep & ~own)
            cosine = _summed(q_x[part][i], v_x[j]) / (q_norm[part][i] * v_norm[j])
            yield q_ids[part][i], v_ids[j], none[i, j], cosine


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest vectors of each of any number of queries ``(query_id, query)``.

    Blocks of vectors meet blocks of queries as matrices, and of each pair of blocks only what may be among the ``k`` stays.
    Spark sends the queries to every task only where they are small (``spark.sql.autoBroadcastJoinThreshold``); otherwise
    each task pairs one partition of vectors with one of queries. A null vector, or one of another length than the query,
    comes last; where a vector is zero, its cosine is NaN, which comes first, as in DuckDB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                v, q = (_matrix(batch.column(c)[r].values) for c in (0, 1))
                for query, vec, none, value in _possible(q, v, k):
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(value, mask=none)], names=["query_id", "vec_id", "cosine"])

    pairs = _blocks(vectors, ["vec_id", "embedding"], 2048, "vectors").crossJoin(_blocks(queries, ["query_id", "query"], 1024, "queries"))
    scored = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, cosine double").select("query_id", "vec_id", F.round("cosine", 6).alias("similarity"))
    near = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    # A window limit below its own filter is a partial top-k per task (WindowGroupLimit).
    return scored.withColumn("rank", near).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "similarity")


def hits(vectors: DataFrame, queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    best = nearest(vectors, queries, 1)
    return best.select("query_id", F.col("vec_id").alias("best_id"), "similarity", (F.col("similarity") >= threshold).alias("hit"))


def blended(vectors: DataFrame, queries: DataFrame, labels: DataFrame, weight: float = 0.4, k: int = 4, top: int = 10) -> DataFrame:
    """The ``top`` rows of each query by keyword score, its best ``k`` by similarity raised: ``weight * similarity / best``.

    No row that is not raised can come before the ``top`` best by keywords, so only these and the raised ones meet a query.
    """
    near = nearest(vectors, queries, k)
    most = F.max("similarity").over(W.partitionBy("query_id"))
    raised = near.select("query_id", "vec_id", F.round(weight * F.col("similarity") / most, 6).alias("raise")).join(labels, "vec_id")
    raised = raised.select("query_id", "vec_id", F.round(F.col("score") + F.col("raise"), 6).alias("score"), F.lit(1).alias("raised"))
    first = labels.orderBy(F.desc("score"), "vec_id").limit(top + k)
    known = first.agg(F.collect_list(F.struct("vec_id", "score")).alias("first")).scalar()
    plain = queries.select("query_id", F.explode(known).alias("f")).select("query_id", "f.vec_id", "f.score", F.lit(0).alias("raised"))
    # A raised row stands for its plain one; looking for the nearest again would cost as much as all the rest.
    most_raised = F.max("raised").over(W.partitionBy("query_id", "vec_id"))
    both = raised.unionByName(plain).withColumn("most", most_raised).filter("raised = most").select("query_id", "vec_id", "score")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= top)


def decisive_profile(text: Column) -> list[Column]:
    """Net polarity, and the literals (numbers and quoted strings) that must agree for a similar prompt's answer to serve."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    weight = F.create_map(*(F.lit(x) for pair in POLARITY.items() for x in pair))
    net = F.aggregate(parts, F.lit(0), lambda s, w: s + F.coalesce(F.try_element_at(weight, w), F.lit(0)))
    literals = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))))
    return [net.cast("bigint").alias("polarity"), F.size(literals).cast("bigint").alias("n_literals"), F.md5(F.array_join(literals, ",")).alias("literals_md5")]


def cache_key(scope: Column, context: Column, prompt: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", scope, context, prompt), 256), 1, 24)


def evict(entries: DataFrame, scope: str, order: list[Column], size: str, most: int) -> DataFrame:
    """The newest entries of each scope whose bytes together fit."""
    w = W.partitionBy(scope).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return entries.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= most)


def stats(entries: DataFrame, scope: str, size: str, ttl_us: int, now: int) -> DataFrame:
    fresh = F.col("ts_us") >= now - ttl_us
    return entries.groupBy(scope).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"), F.count_if(~fresh).alias("expired"))


def replay(log: DataFrame, ttl_us: int, most: int = 50) -> DataFrame:
    """Hits and misses of a log of requests ``(session_id, ts_us, request_id, prompt)``: each miss sets, entries expire, the
    least recently used goes beyond ``most``. A session's cache is a state that every request changes, so it is folded.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        hit = []
        pdf = pdf.sort_values(["ts_us", "request_id"])
        for at, prompt in zip(pdf["ts_us"], pdf["prompt"], strict=True):
            made = held.pop(prompt, None)
            fresh = made is not None and at - made <= ttl_us
            hit.append(fresh)
            held[prompt] = made if fresh else at
            if len(held) > most:
                held.pop(next(iter(held)))
        return pd.DataFrame({"session_id": pdf["session_id"], "request_id": pdf["request_id"], "hit": hit})

    return log.groupBy("session_id").applyInPandas(fold, "session_id bigint, request_id bigint, hit boolean")
