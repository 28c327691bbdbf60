"""A Merkle manifest of a dataset: a tree for each group, a tree over the groups' roots, and a proof for every row.

Leaves are digests of rows, made by Spark's own functions. They are range-partitioned by (group, row id), so a partition
holds an interval of leaves, of a few trees that reach over its ends and of others that it holds whole. The sizes of trees
and the intervals follow from one short row a partition; so every run of siblings has a known arity.

A forest is a set of unresolved nodes keyed by (tree, level, index). Two forests merge by uniting them and replacing each
run of siblings that is now complete by its parent, upwards as far as that goes: an associative operation, whose neutral
element is the empty forest. A partition's forest has at most four nodes a level; ``treeReduce`` merges them to the root. What a
merge replaces is kept as packed records (49 bytes), the seams: at most four a level and partition, never one a row. They
are broadcast as arrays, and a partition picks those beside its own interval. So siblings of a proof come from the
partition's own levels or from the seams.

Defined cases: a null value is ``-``, any other its length in UTF-8 bytes, ``:`` and itself; null groups and null ids come
first; rows with equal group and id are ordered by their leaf, and equal rows are leaves of their own; a lone leaf is its
tree's root; a run of one becomes the digest of it; an empty table gives no rows; groups of any size and any number of
groups are cut into partitions of about ``PER_PART`` leaves; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import settled, written
from parley.llm.textio import released

ARITY = 3
PER_PART = 1 << 20
LEAST = 1 << 12  # leaves that are worth a task
TOP = -1  # the tree over the groups' roots; others are numbered in their order
RECORD = "<qbq32s"  # tree, level, index, digest
_SEAM = np.dtype([("tree", "<i8"), ("level", "i1"), ("index", "<i8"), ("digest", "V32")])


def leaf(*values: Column) -> Column:
    """The digest of a row's values, 32 bytes."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256))


def parent(children: bytes) -> bytes:
    """The digest of digests that are laid end to end, taken as lowercase hex."""
    return hashlib.sha256(children.hex().encode()).digest()


def width(size: int, level: int) -> int:
    """How many nodes a tree of ``size`` leaves has at a level."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


class Forest:
    """Unresolved nodes and the seams of merges so far. ``sizes`` has the leaves of each tree that any of them is of."""

    def __init__(self, nodes: dict[tuple[int, int, int], bytes], seams: bytes = b""):
        self.nodes, self.seams = nodes, seams

    def merged(self, other: Forest, sizes: dict[int, int]) -> Forest:
        """Both forests hold no complete run, so one that is complete now has a node of either."""
        nodes, gone = self.nodes | other.nodes, []
        todo = list(other.nodes if len(other.nodes) < len(self.nodes) else self.nodes)
        while todo:
            tree, level, index = key = todo.pop()
            if key not in nodes:
                continue
            n = width(sizes[tree], level)
            if n == 1:
                if tree != TOP:
                    todo.append((TOP, 0, tree))
                    nodes[TOP, 0, tree] = nodes.pop(key)
                continue
            first = index - index % ARITY
            run = [(tree, level, k) for k in range(first, min(first + ARITY, n))]
            if all(k in nodes for k in run):
                found = [nodes.pop(k) for k in run]
                gone += [struct.pack(RECORD, *k, d) for k, d in zip(run, found, strict=True)]
                up = (tree, level + 1, index // ARITY)
                nodes[up] = parent(b"".join(found))
                todo.append(up)
        return Forest(nodes, b"".join([self.seams, other.seams, *gone]))


@dataclass
class Span:
    """Levels of one tree over an interval of its leaves: ``(first index, digests)`` each, as far up as runs are whole."""

    tree: int
    size: int
    levels: list[tuple[int, bytes]]

    @classmethod
    def over(cls, tree: int, size: int, first: int, leaves: bytes) -> Span:
        levels, n = [(first, leaves)], size
        while n > 1:
            low, data = levels[-1]
            high = low + len(data) // 32
            start, stop = -(-low // ARITY), -(-n // ARITY) if high == n else high // ARITY
            if stop <= start:
                break
            at = [(k * ARITY - low) * 32 for k in range(start, stop)]
            levels.append((start, b"".join([parent(data[a : a + ARITY * 32]) for a in at])))
            n = -(-n // ARITY)
        return cls(tree, size, levels)

    def node(self, level: int, index: int) -> bytes | None:
        if level < len(self.levels):
            low, data = self.levels[level]
            at = (index - low) * 32
            if 0 <= at < len(data):
                return data[at : at + 32]
        return None

    @property
    def root(self) -> bytes | None:
        return self.levels[-1][1] if width(self.size, len(self.levels) - 1) == 1 else None

    def unresolved(self) -> Iterator[tuple[int, int, int, bytes]]:
        for level, (low, data) in enumerate(self.levels):
            high, n = low + len(data) // 32, width(self.size, level)
            above = self.levels[level + 1] if level + 1 < len(self.levels) else (0, b"")
            done = range(above[0] * ARITY, (above[0] + len(above[1]) // 32) * ARITY)
            some = range(low, high) if not done else [*range(low, done.start), *range(min(done.stop, n), high)]
            for k in some:
                yield self.tree, level, k, self.node(level, k)


@dataclass
class Place:
    """Where a partition stands: the first tree's number, its leaves before, and the sizes of trees reaching over its ends."""

    tree: int
    before: int
    sizes: dict[int, int]
    top: int


def _runs(groups: pa.Array | pa.ChunkedArray) -> list[int]:
    """How many rows each run of equal groups has; the column is sorted."""
    column = groups.combine_chunks() if isinstance(groups, pa.ChunkedArray) else groups
    if not len(column):
        return []
    ends = pc.run_end_encode(column).run_ends.to_numpy()
    return np.diff(ends, prepend=0).tolist()


def _places(rows: list) -> tuple[dict[int, Place], dict[int, int]]:
    """A place for each partition that has rows, and the sizes of trees in more than one of them and of the top."""
    rows = sorted(rows, key=lambda r: r.part)
    starts, tree, last = [], -1, None
    counts: dict[int, int] = {}
    spread: set[int] = set()
    for r in rows:
        joined = last == r.first
        tree += not joined
        starts.append((tree, counts.get(tree, 0)))
        if joined:
            spread.add(tree)
        counts[tree] = counts.get(tree, 0) + r.n_first
        if r.groups > 1:
            tree += r.groups - 1
            counts[tree] = r.n_last
        last = r.last
    sizes = {t: counts[t] for t in spread} | {TOP: tree + 1}
    places = {}
    for r, (first, before) in zip(rows, starts, strict=True):
        places[r.part] = Place(first, before, {t: counts[t] for t in (first, first + r.groups - 1)}, tree + 1)
    return places, sizes


def _spans(place: Place, runs: list[int], leaves: bytes) -> tuple[list[Span], Span]:
    """The trees of a partition, and the tree over them as far as the partition knows it."""
    spans, at = [], 0
    for k, n in enumerate(runs):
        tree, data = place.tree + k, leaves[at * 32 : (at + n) * 32]
        spans.append(Span.over(tree, place.sizes.get(tree, n), 0 if k else place.before, data))
        at += n
    whole = [s for s in spans if s.root is not None and len(s.levels[0][1]) == 32 * s.size]
    top = Span.over(TOP, place.top, whole[0].tree, b"".join(s.root for s in whole)) if whole else Span(TOP, place.top, [(0, b"")])
    return spans, top


class Manifest:
    """The trees over ``leaves``: columns ``grp``, ``id``, ``leaf`` and, where rows are to be audited, ``claimed``."""

    def __init__(self, leaves: DataFrame):
        spark = leaves.sparkSession
        self.id_type = leaves.schema["id"].dataType
        if "claimed" not in leaves.columns:
            leaves = leaves.withColumn("claimed", F.lit(None).cast("binary"))
        # The last key tells equal rows apart, so that no number of copies has to stay in one partition.
        rows = written(leaves.select("grp", "id", "leaf", "claimed", F.monotonically_increasing_id().alias("nr")), "merkle-leaves")
        n, some = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, -(-n // PER_PART), min(some, -(-n // LEAST)))
        order = ["grp", "id", "leaf", "nr"]
        self.rows = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("nr"))
        self.spark = spark
        self.places, sizes = _places(self.rows.select("grp").mapInArrow(_counted, "part int, groups bigint, first string, n_first bigint, last string, n_last bigint").collect())
        places = spark.sparkContext.broadcast(self.places)

        @released
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = _table(batches, ["grp", "leaf"])
            if held is None:
                return
            spans, top = _spans(places.value[TaskContext.get().partitionId()], _runs(held.column("grp")), _digests(held.column("leaf")))
            own = [s for s in spans if s.root is None or len(s.levels[0][1]) < 32 * s.size]
            found = [x for s in (*own, top) for x in s.unresolved()]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(struct.pack(RECORD, *x) for x in found)], pa.binary())], names=["nodes"])

        def of_rows(rows: Iterable) -> Iterator[Forest]:
            for r in rows:
                yield Forest({x[:3]: x[3] for x in struct.iter_unpack(RECORD, r.nodes)})

        whole = Forest({})
        if self.places:
            forests = self.rows.select("grp", "leaf").mapInArrow(fold, "nodes binary").rdd.mapPartitions(of_rows)
            whole = forests.treeReduce(lambda a, b: a.merged(b, sizes))
        if self.places and len(whole.nodes) != 1:
            raise AssertionError(f"{len(whole.nodes)} nodes are left unresolved")
        self.root = next(iter(whole.nodes.values())).hex() if self.places else None
        self.n_leaves, self.seams = n, whole.seams

    def _each(self, run, schema: str) -> DataFrame:
        """``run(held, spans)`` of every partition; ``held`` has its rows, ``spans`` a ``Proofs`` for each run of a group."""
        places, seams, root = self.spark.sparkContext.broadcast(self.places), self.spark.sparkContext.broadcast(self.seams), bytes.fromhex(self.root or "")

        @released
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = _table(batches, ["grp", "id", "leaf", "claimed"])
            if held is None:
                return
            spans, top = _spans(places.value[TaskContext.get().partitionId()], _runs(held.column("grp")), _digests(held.column("leaf")))
            yield from run(held, _proofs(spans, top, seams.value, root))

        return self.rows.mapInArrow(mapped, schema)

    def proofs(self) -> DataFrame:
        """``(id, leaf, subroot, root, proof)``; ``proof`` has a row's siblings by level, those before and those after it."""
        item = pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
        kind = "array<struct<before:array<string>,after:array<string>>>"

        def run(held: pa.Table, proofs: Iterator[tuple[bytes, bytes, bytes, list]]) -> Iterator[pa.RecordBatch]:
            hexes = lambda d: [d[k : k + 32].hex() for k in range(0, len(d), 32)]
            for batch in held.to_batches(max_chunksize=1000):
                leaves, subs, roots, out = [], [], [], []
                for _ in range(len(batch)):
                    own, sub, root, path = next(proofs)
                    leaves.append(own.hex())
                    subs.append(sub.hex())
                    roots.append(root.hex())
                    out.append([{"before": hexes(a), "after": hexes(b)} for a, b in path])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(leaves), pa.array(subs), pa.array(roots), pa.array(out, pa.list_(item))], names=["id", "leaf", "subroot", "root", "proof"])

        return self._each(run, f"id {self.id_type.simpleString()}, leaf string, subroot string, root string, proof {kind}")

    def audited(self) -> DataFrame:
        """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``: the root that the claimed leaf (else the own) leads to."""

        def run(held: pa.Table, proofs: Iterator[tuple[bytes, bytes, bytes, list]]) -> Iterator[pa.RecordBatch]:
            for batch in held.to_batches(max_chunksize=1 << 14):
                out: list[list] = [[], [], [], [], [], []]
                for claimed in batch.column("claimed").to_pylist():
                    own, sub, root, path = next(proofs)
                    folded = own if claimed is None else claimed
                    for before, after in path:
                        folded = parent(before + folded + after)
                    for column, value in zip(out, (own.hex(), sub.hex(), root.hex(), parent(b"".join([x for pair in path for x in pair])).hex(), folded.hex(), folded == root), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out)], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        return self._each(run, f"id {self.id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: its groups, and the first and the last of them (by digest) with their rows."""
    from pyspark import TaskContext

    name = lambda v: "-" if v is None else hashlib.sha256(v.encode()).hexdigest()
    groups, first, n_first, last, n_last = 0, None, 0, None, 0
    for batch in batches:
        column, at = batch.column(0), 0
        for n in _runs(column):
            found = name(column[at].as_py())
            at += n
            if found != last:
                groups, last, n_last = groups + 1, found, 0
                first = first or found
            n_last += n
            n_first += n if groups == 1 else 0
    if groups:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int32()), (groups, pa.int64()), (first, pa.string()), (n_first, pa.int64()), (last, pa.string()), (n_last, pa.int64()))], names=["part", "groups", "first", "n_first", "last", "n_last"])


def _table(batches: Iterator[pa.RecordBatch], names: list[str]) -> pa.Table | None:
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held).select(names) if held else None


def _digests(column: pa.ChunkedArray) -> bytes:
    """The digests of a column, laid end to end."""
    return b"".join(np.asarray(c.cast(pa.binary(32)).to_numpy(zero_copy_only=False), "S32").tobytes() for c in column.chunks)


def _proofs(spans: list[Span], top: Span, seams: bytes, root: bytes) -> Iterator[tuple[bytes, bytes, bytes, list[tuple[bytes, bytes]]]]:
    """``(leaf, subroot, root, [(siblings before, siblings after) of each level])`` of every leaf, in order."""
    records = np.frombuffer(seams, _SEAM)
    near: dict[tuple[int, int, int], bytes] = {}

    def pick(span: Span, low: int, high: int) -> None:
        """Seams of a tree whose runs have a node over the leaves ``low`` to ``high``."""
        own, level = records[records["tree"] == span.tree], 0
        while len(own) and width(span.size, level) > 1:
            some = own[(own["level"] == level) & (own["index"] >= low - ARITY) & (own["index"] <= high + ARITY)]
            near.update({(span.tree, level, int(r["index"])): bytes(r["digest"]) for r in some})
            low, high, level = low // ARITY, high // ARITY, level + 1

    for s in spans:
        if s is spans[0] or s is spans[-1]:
            pick(s, s.levels[0][0], s.levels[0][0] + len(s.levels[0][1]) // 32)
    pick(top, spans[0].tree, spans[-1].tree)

    def paths(span: Span, first: int, n: int) -> Iterator[list[tuple[bytes, bytes]]]:
        """The siblings of leaves one after the other; levels above change seldom and are kept."""
        widths = [span.size]
        while widths[-1] > 1:
            widths.append(-(-widths[-1] // ARITY))
        kept: list[tuple[int, tuple[bytes, bytes]]] = [(-1, (b"", b""))] * (len(widths) - 1)
        for index in range(first, first + n):
            for level in range(len(widths) - 1):
                if kept[level][0] == index:
                    break
                low = index - index % ARITY
                get = lambda k: span.node(level, k) or near[span.tree, level, k]  # noqa: E731, B023
                kept[level] = (index, (b"".join(map(get, range(low, index))), b"".join(map(get, range(index + 1, min(low + ARITY, widths[level]))))))
                index //= ARITY
            yield [pair for _, pair in kept]

    for s in spans:
        low, data = s.levels[0]
        above = next(paths(top, s.tree, 1))
        sub = s.root if s.root is not None and len(data) == 32 * s.size else top.node(0, s.tree) or near.get((TOP, 0, s.tree)) or root
        for k, path in enumerate(paths(s, low, len(data) // 32)):
            yield data[32 * k : 32 * k + 32], sub, root, path + above
