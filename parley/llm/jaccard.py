"""N-gram Jaccard join by T-occurrence search.

A document's set is its distinct shingles of five lower-cased words. Two documents link when
``100 * |intersection| >= PERCENT * |union|``, so one of ``n`` shingles needs an overlap ``T >= PERCENT/100 * n``. Within
a cell of documents each set is a query against the inverted lists of the others: the ``L`` longest lists are put aside,
the rest are merged by a heap that skips what can't reach ``T - L`` (MergeSkip), and the candidates are looked up in the
long ones by binary search (DivideSkip). Pairs that are connected already are not looked at again.

How documents come into one cell:

1. Equal sets are one class; only its smallest document goes on.
2. Documents that agree in a pair of min-hashes share a cell, hot cells in chunks that share a leader. This joins dense
   groups of copies without forming their pairs.
3. Every pair that may still link has a shingle in common among the first ``n - T + 1`` of both sets, in a global order
   that puts frequent shingles last. Postings of these prefixes are dealt out by shingle as packed blocks; lists give
   pairs of different components and compatible sizes, with the number of shared prefix shingles, and pairs that can't
   reach ``T`` any more are dropped. What is left is verified in cells, too.

Step 3 is complete whatever step 2 found, and every link is verified on the whole sets. Which shingles are frequent
(at most ``FREQUENT``, found by local counts) only decides the order and thereby the cost.

Pairs of a list that would be many are dealt out to tasks of their own, a part of the documents that ask with the whole
list; the list itself (38 bytes a document) is in one task.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing; fewer words than a
shingle's are one shingle; texts of any length are used whole; rows with equal ids are one document (they are expected
to be distinct); rows with null ids are documents, too, and ``component_id`` is the smallest id that there is, null where
a component has none (inside they stand at numbers from 2**62 on, so ids must be smaller); an empty table gives no rows;
other columns are left alone.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.packed import bitmap, dealt, has, spot, stand_in, unpacked
from parley.llm.scratch import settled, written
from parley.llm.textio import lower_ascii, mix64, released, span_hashes, texts_of, window_hashes, words

SIZE = 5
PERCENT = 80
FREQUENT = 1 << 17  # frequent shingles that go last in the order; a bound of what is broadcast
LOCAL_WINDOW, LOCAL_COUNT = 2_000_000, 3  # a shingle is frequent if that many documents of a window have it
BANDS = 4  # pairs of min-hashes
CELL = 200
MU = 0.0085  # weight of the long lists in DivideSkip
BLOCK_POSTINGS = 500_000  # postings that a block has on average, at most
MANY_PAIRS = 4_000_000  # pairs that one task makes of one list; what is above is dealt out
CHUNK = 2048  # postings of a long list that are dealt out together
NAMELESS = 1 << 62  # stand-ins for null ids begin here
_TOP = np.uint64(1 << 63)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and the number before each text."""
    data = lower_ascii()[data]
    starts, ends, before = words(data, offsets)
    h = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    count = np.diff(before)
    owner = np.repeat(np.arange(n), count)
    w = window_hashes(h, size)
    inside = owner[: len(w)] == owner[size - 1 :] if len(w) else np.zeros(0, bool)
    values, of = [w[inside]], [owner[: len(w)][inside]]
    for k in range(1, size):  # short texts
        at = np.flatnonzero(count == k)
        if len(at):
            values.append(mix64(window_hashes(h, k)[before[at]] + np.uint64(k)))
            of.append(at)
    value, of = np.concatenate(values), np.concatenate(of)
    by = np.lexsort((value, of))
    value, of = value[by], of[by]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[first], of[first]
    return value, np.searchsorted(of, np.arange(n + 1))


def number_of(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), stand_in(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def links(overlap, n, m, percent: int = PERCENT):
    return 100 * overlap >= percent * (n + m - overlap)


def frequent(df: DataFrame, text_col: str) -> np.ndarray:
    """At most ``FREQUENT`` hashes, the most frequent first."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            at = count >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), pa.array(count[at].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for _, _, data, offsets in texts_of(batch.column(0)):
                value, _ = shingles(data, offsets)
                held.append(value)
                size += len(value)
                if size >= LOCAL_WINDOW:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = df.select(F.col(text_col)).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return top.column("h").to_numpy().view(np.uint64)


def sets(df: DataFrame, last: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``(doc, n, key, bands, prefix, ends)`` of each row. ``prefix`` holds ordered keys of the shingles; ``ends`` is the
    top of the last one's key."""
    known = np.sort(last)
    rank = (len(last) - 1 - np.argsort(last, kind="stable")).astype(np.uint64)  # the most frequent is last of all
    shared = df.sparkSession.sparkContext.broadcast((known, rank))
    odd = [np.uint64(2 * int(x) + 1) for x in mix64(np.arange(1, 2 * BANDS + 1, dtype=np.uint64)) >> np.uint64(1)]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            for lo, hi, data, offsets in texts_of(batch.column(1)):
                value, before = shingles(data, offsets)
                n = np.diff(before)
                some = np.flatnonzero(n)
                keys, bands, prefixes, ends = [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo), np.zeros(hi - lo, np.int32)
                if len(some):
                    at = before[some]
                    one, two = np.add.reduceat(value, at), np.add.reduceat(mix64(value), at)
                    low = [np.minimum.reduceat(value * m, at) for m in odd]
                    pairs = np.stack([mix64(low[2 * k] ^ mix64(low[2 * k + 1] + np.uint64(k))).view(np.int64) for k in range(BANDS)], axis=1)
                    order = value >> np.uint64(1)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                        hot = known[place] == value
                        order[hot] = _TOP | rank[place[hot]]
                    for k, i in enumerate(some.tolist()):
                        own = order[before[i] : before[i + 1]]
                        size = n[i] - needed(int(n[i])) + 1
                        first = np.sort(np.partition(own, size - 1)[:size])
                        keys[i] = one[k].tobytes() + two[k].tobytes()
                        bands[i] = pairs[k].tolist()
                        prefixes[i] = first.tobytes()
                        ends[i] = int(first[-1] >> np.uint64(48))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prefixes, pa.binary()), pa.array(ends)],
                    names=["doc", "n", "key", "bands", "prefix", "ends"],
                )

    return df.select(number_of(id_col, text_col).alias("doc"), F.col(text_col)).mapInArrow(run, "doc bigint, n bigint, key binary, bands array<bigint>, prefix binary, ends int")


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """``(document, count)`` of those in at least ``least`` of the ascending lists: a heap that jumps over the others."""
    if least <= 0:
        raise ValueError("least must be positive")
    heap = [(own[0], k, 0) for k, own in enumerate(lists) if own]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        doc = heap[0][0]
        popped = []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out.append((doc, len(popped)))
            target = doc + 1
        else:
            # Documents before the next but ``least`` - 1 - popped heads can't be in enough lists.
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(heap[0][0], doc + 1)
        for _, k, at in popped:
            at = bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return out


def t_occurrences(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """DivideSkip: ``(document, count)`` of those in at least ``least`` of the lists."""
    if len(lists) < least:
        return []
    lists = sorted(lists, key=len)
    apart = min(least - 1, int(least / (MU * log2(max(2, len(lists[-1]))) + 1)))
    short, long_ = lists[: len(lists) - apart], lists[len(lists) - apart :]
    out = []
    for doc, count in merge_skip(short, least - apart):
        for k, own in enumerate(long_):
            if count + len(long_) - k < least:
                break
            at = bisect_left(own, doc)
            count += at < len(own) and own[at] == doc
        if count >= least:
            out.append((doc, count))
    return out


def cell_links(owned: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect a cell's sets as all their links do; pairs already connected are left out."""
    k = len(owned)
    size = [len(s) for s in owned]
    value = np.concatenate(owned)
    doc = np.repeat(np.arange(k), size)
    by = np.lexsort((doc, value))
    value, doc = value[by], doc[by]
    starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    ends = np.append(starts[1:], len(value))
    several = ends - starts > 1
    starts, ends = starts[several], ends[several]
    if k == 2:
        return [(0, 1)] if links(len(starts), size[0], size[1], percent) else []
    inverted = [doc[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    of: list[list[int]] = [[] for _ in range(k)]
    for number, members in enumerate(inverted):
        for d in members:
            of[d].append(number)
    parent, weight, unasked = list(range(k)), [1] * k, [1] * k
    left, biggest, out = k, 0, []

    def root(d: int) -> int:
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    def ask(query: int) -> None:
        nonlocal left, biggest
        unasked[root(query)] -= 1
        left -= 1
        for other, overlap in t_occurrences([inverted[i] for i in of[query]], needed(size[query], percent)):
            a, b = root(query), root(other)
            if a != b and links(overlap, size[query], size[other], percent):
                out.append((query, other))
                parent[b] = a
                weight[a] += weight[b]
                unasked[a] += unasked[b]
        if weight[root(query)] > weight[root(biggest)]:
            biggest = root(query)

    # One side of a pair must ask: members of the largest component wait, and most need not ask in the end.
    waiting = []
    for query in range(k):
        if weight[root(query)] > 1 and root(query) == root(biggest):
            waiting.append(query)
        else:
            ask(query)
    for query in waiting:
        if left > unasked[root(query)]:
            ask(query)
    return out


def verified(df: DataFrame, cells: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links ``(a, b)`` within cells ``(cell, doc)``."""
    spark = df.sparkSession
    bits = bitmap(cells, "doc")
    shared = spark.sparkContext.broadcast(bits)

    @released
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            yield batch.filter(pa.array(has(bits, batch.column(2).to_numpy())))

    texts = df.select(number_of(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    sifted = texts.withColumn("s", spot("doc")).mapInArrow(sift, "doc bigint, text string, s bigint").drop("s")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shipped = cells.join(sifted, "doc").select("cell", "doc", "text").repartition(parts, "cell").sortWithinPartitions("cell", "doc")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, docs, owned = None, [], []

        def flush() -> pa.RecordBatch:
            found = cell_links(owned) if len(owned) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in found], pa.int64()), pa.array([docs[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            cells_, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offsets in texts_of(batch.column(2)):
                value, before = shingles(data, offsets)
                for i in range(lo, hi):
                    if cells_[i] != cell:
                        if owned:
                            yield flush()
                        cell, docs, owned = cells_[i], [], []
                    own = value[before[i - lo] : before[i - lo + 1]].copy()
                    if len(own) and (not docs or docs[-1] != ids[i]):
                        docs.append(ids[i])
                        owned.append(own)
        if owned:
            yield flush()

    return shipped.mapInArrow(run, "a bigint, b bigint")


def _chunked(members: DataFrame) -> DataFrame:
    """Cells of ``CELL`` documents or so from groups ``(g, doc)``; the chunks of a group share its smallest document."""
    groups = members.groupBy("g").agg(F.count("*").alias("size"), F.min("doc").alias("leader")).filter("size > 1")
    groups = groups.withColumn("chunks", F.ceil(F.col("size") / CELL))
    cell = F.xxhash64("g", "chunk")
    own = members.join(groups, "g").withColumn("chunk", F.pmod(F.xxhash64("doc", "g"), F.col("chunks"))).select(cell.alias("cell"), "doc")
    led = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select(cell.alias("cell"), F.col("leader").alias("doc"))
    return own.unionAll(led).distinct()


POSTING = np.dtype([("key", "<u8"), ("doc", "<i8"), ("part", "<i8"), ("n", "<u4"), ("ends", "<u2")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("c", "<u4"), ("na", "<u4"), ("nb", "<u4"), ("ea", "<u2"), ("eb", "<u2")])


@dataclass
class Lists:
    """The inverted lists of a block of postings, sorted by key and component; ``asks`` are paired with their lists.

    Of each list, only postings outside its most frequent component ask, so a list whose documents are all connected
    costs nothing.
    """

    rows: np.ndarray
    group: np.ndarray  # (key, component) of each posting
    is_main: np.ndarray  # whether that is the list's main one
    asks: np.ndarray
    start: np.ndarray  # of each asking posting, the list
    width: np.ndarray

    @classmethod
    def of(cls, p: np.ndarray) -> Lists:
        p = p[np.lexsort((p["part"], p["key"]))]
        new_key = np.append(True, p["key"][1:] != p["key"][:-1]) if len(p) else np.zeros(0, bool)
        new_part = new_key | np.append(True, p["part"][1:] != p["part"][:-1]) if len(p) else new_key
        runs, groups = np.flatnonzero(new_key), np.flatnonzero(new_part)
        ends = np.append(runs[1:], len(p))
        run_of, group_of = np.cumsum(new_key) - 1, np.cumsum(new_part) - 1
        sizes = np.diff(np.append(groups, len(p)))
        largest = np.zeros(len(runs), np.int64)
        np.maximum.at(largest, run_of[groups], sizes)
        # Of groups of equal size the first one is the main one.
        at_most = np.flatnonzero(sizes == largest[run_of[groups]])
        main = np.full(len(runs), len(groups))
        np.minimum.at(main, run_of[groups[at_most]], at_most)
        is_main = group_of == main[run_of] if len(p) else np.zeros(0, bool)
        asks = np.flatnonzero(~is_main)
        return cls(p, group_of, is_main, asks, runs[run_of[asks]], (ends - runs)[run_of[asks]])


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of postings, row by row, whose sizes can link."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    fit = PERCENT * np.maximum(n, m) <= 100 * np.minimum(n, m)
    x, y = x[fit], y[fit]
    swap = x["doc"] > y["doc"]
    out = np.empty(len(x), PAIR)
    out["c"] = 1
    for name, of in (("a", "doc"), ("na", "n"), ("ea", "ends")):
        out[name] = np.where(swap, y[of], x[of])
    for name, of in (("b", "doc"), ("nb", "n"), ("eb", "ends")):
        out[name] = np.where(swap, x[of], y[of])
    return out


def list_pairs(lists: Lists, own: np.ndarray, chunk: int = 1_000_000) -> Iterator[np.ndarray]:
    """Pairs of the ``own`` among the asking postings: different components, sizes that can link."""
    done = 0
    asks, start, width = lists.asks[own], lists.start[own], lists.width[own]
    total = np.cumsum(width)
    while done < len(asks):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + chunk, "right")))
        w = width[done:stop]
        i = np.repeat(asks[done:stop], w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[done:stop], w)
        # Two that both ask are taken once.
        once = (lists.group[i] != lists.group[j]) & (lists.is_main[j] | (i < j))
        yield paired(lists.rows[i[once]], lists.rows[j[once]])
        done = stop


def apart(lists: Lists, many: int, size: int) -> tuple[np.ndarray, list[tuple[int, int, int, bytes]]]:
    """The asking postings to pair at once, and chunks of the long lists: ``(key, number, chunks that it meets, postings)``.

    Chunks of asking postings come first and meet each other and all the rest; the others meet only those. Each is written
    once, however many it meets.
    """
    here, out = np.ones(len(lists.asks), bool), []
    if len(lists.asks):
        for a in np.flatnonzero(np.append(True, lists.start[1:] != lists.start[:-1])).tolist():
            start, width = int(lists.start[a]), int(lists.width[a])
            b = int(np.searchsorted(lists.start, start, "right"))
            if (b - a) * width > many:
                here[a:b] = False
                rows, main = lists.rows[start : start + width], lists.is_main[start : start + width]
                asking, rest = ([own[k : k + size] for k in range(0, len(own), size)] for own in (rows[~main], rows[main]))
                key, n = int(rows["key"][:1].view(np.int64)[0]), len(asking) + len(rest)
                out += [(key, k, n if k < len(asking) else len(asking), x.tobytes()) for k, x in enumerate(asking + rest)]
    return np.flatnonzero(here), out


def chunk_pairs(x: np.ndarray, y: np.ndarray | None, rows: int = 256) -> Iterator[np.ndarray]:
    """Pairs of two chunks of a list, or of one with itself, across components."""
    for a in range(0, len(x), rows):
        own = x[a : a + rows]
        other = x[a:] if y is None else y
        i, j = np.nonzero(own["part"][:, None] != other["part"][None, :])
        if y is None:
            i, j = i[i < j], j[i < j]
        yield paired(own[i], other[j])


def summed(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    starts = np.flatnonzero(np.append(True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1]))) if len(pairs) else np.zeros(0, int)
    out = pairs[starts].copy()
    if len(pairs):
        out["c"] = np.add.reduceat(pairs["c"], starts)
    return out


def reachable(p: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the shared prefix shingles and all that follows the prefix that ends first could make a link.

    All common shingles up to the end of that prefix are in both prefixes, so they are counted in ``c``.
    """
    na, nb, c = (p[k].astype(np.int64) for k in ("na", "nb", "c"))
    least = -(-percent * (na + nb) // (100 + percent))
    rest = lambda n: -(-percent * n // 100) - 1  # noqa: E731  what follows the prefix
    after = np.where(p["ea"] < p["eb"], rest(na), np.where(p["eb"] < p["ea"], rest(nb), np.maximum(rest(na), rest(nb))))
    return c + after >= least


def candidates(prefixes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` from ``(doc, n, prefix, ends, part)`` that may link across components."""
    spark = prefixes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    postings = prefixes.agg(F.sum(size).cast("bigint")).first()[0] or 0
    blocks = max(8, 4 * parts, -(-postings // BLOCK_POSTINGS))

    @released
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            return dealt(rows, (mix64(rows["key"]) % np.uint64(blocks)).astype(np.int64), blocks)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for doc, n, prefix, ends, part in zip(*columns, strict=True):
                keys = np.frombuffer(prefix, "<u8")
                rows = np.empty(len(keys), POSTING)
                rows["key"], rows["doc"], rows["part"], rows["n"], rows["ends"] = keys, doc, part, n, ends
                held.append(rows)
                size += len(rows)
                if size >= 500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def packed_pairs(found: Iterator[np.ndarray]) -> pa.RecordBatch:
        held, size = [], 0
        for rows in found:
            held.append(rows)
            size += len(rows)
            if size >= 2_000_000:
                held = [summed(np.concatenate(held))]
                size = len(held[0])
        rows = summed(np.concatenate(held)) if held else np.zeros(0, PAIR)
        return dealt(rows, (mix64(rows["a"].view(np.uint64) * np.uint64(31) + rows["b"].view(np.uint64)) % np.uint64(blocks)).astype(np.int64), blocks)

    many, chunk = MANY_PAIRS, CHUNK

    def pair(table: pa.Table) -> pa.Table:
        lists = Lists.of(unpacked(table.column("rows"), POSTING))
        own, long_ = apart(lists, many, chunk)
        made = packed_pairs(list_pairs(lists, own))
        columns = [pa.array([x[k] for x in long_], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
        sent = pa.RecordBatch.from_arrays([pa.nulls(len(long_), pa.int32()), columns[3], *columns[:3]], schema=schema)
        none = [pa.nulls(len(made), t) for t in (pa.int64(), pa.int32(), pa.int32())]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*made.columns, *none], schema=schema), sent])

    def cross(table: pa.Table) -> pa.Table:
        """Two chunks of a list that meet, or one that meets itself."""
        chunks = [np.frombuffer(x, POSTING) for x in table.sort_by("chunk").column("rows").to_pylist()]
        return pa.Table.from_batches([packed_pairs(chunk_pairs(chunks[0], chunks[1] if len(chunks) > 1 else None))])

    def decide(table: pa.Table) -> pa.Table:
        p = summed(unpacked(table.column("rows"), PAIR))
        p = p[reachable(p)]
        return pa.table({"a": pa.array(p["a"]), "b": pa.array(p["b"])})

    schema = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("key", pa.int64()), ("chunk", pa.int32()), ("meets", pa.int32())])
    posted = prefixes.select("doc", "n", "prefix", "ends", "part").mapInArrow(post, "block int, rows binary")
    short = written(posted.groupBy("block").applyInArrow(pair, "block int, rows binary, key bigint, chunk int, meets int"), "shingle-pairs")
    met = short.filter("chunk IS NOT NULL").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    met = met.groupBy("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")).applyInArrow(cross, "block int, rows binary")
    return short.filter("chunk IS NULL").select("block", "rows").unionAll(met).groupBy("block").applyInArrow(decide, "a bigint, b bigint")


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, n, component)`` of each row, null ids by their numbers."""
    all_sets = written(sets(df, frequent(df, text_col), id_col, text_col), "shingle-sets")
    classes = written(all_sets.filter("n > 0").groupBy("key").agg(F.min("doc").alias("rep")), "shingle-classes")
    own = all_sets.filter("n > 0").join(classes.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")

    banded = own.select("doc", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("g"), "doc").distinct()
    first = settled(verified(df, settled(_chunked(banded)), id_col, text_col))
    parts = components(first)

    prefixes = own.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("component", "doc"))
    pairs = candidates(prefixes)
    second = settled(verified(df, settled(_chunked(pairs.select(F.col("a").alias("g"), F.col("b").alias("doc")).unionAll(pairs.select(F.col("a").alias("g"), F.col("a").alias("doc"))).distinct())), id_col, text_col))
    whole = components(first.unionAll(second))

    reps = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = all_sets.select("doc", "n", "key").join(reps, "key", "left")
    return out.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    return _numbered(df, id_col, text_col).select(named("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), named("component").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` but for those linked with a smaller id; of rows without ids that have one text, one stays."""
    gone = _numbered(df, id_col, text_col).filter("doc <> component").select("doc").distinct()
    rows = df.select(number_of(id_col, text_col).alias("doc"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    named = rows.filter(F.col(f"row.`{id_col}`").isNotNull()).join(gone, "doc", "left_anti")
    nameless = rows.filter(F.col(f"row.`{id_col}`").isNull()).join(gone, "doc", "left_anti").dropDuplicates(["doc"])
    return named.unionAll(nameless).select("row.*")
