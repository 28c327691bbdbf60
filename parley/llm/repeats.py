"""Exact substring deduplication by suffix order.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller document, or before in
the same one. Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

1. Every string of ``LENGTH`` bytes picks an anchor in itself: the last of the least hashes of its ``GRAM``-byte parts.
   Equal strings pick the same anchor at the same place, so only strings whose anchor's bytes occur twice can repeat.
   Anchors' hashes are dealt out in packed blocks, and the repeated ones are sent back to their documents.
2. Around each repeated anchor, the slice of its strings is dealt out by the anchor's hash to shards, which are as many
   as the slices' bytes ask for. A shard reads its slices in the order of their hashes; neighbours whose bytes are equal
   are one form. Where an anchor has several forms, they are laid end to end in a file, and the file's suffixes are
   ordered by external induced sorting (``suffixes``): strings that agree in their common prefix over ``LENGTH`` bytes
   are one string, whose first occurrence stays. All this streams, so a shard may be far larger than memory.
3. The spans to remove go back to their documents.

Anchors decide only what is compared. Documents whose whole text is equal to a smaller one's are left out of all this:
each of their strings starts earlier. Slices that repeat in a block of documents are reduced to the first before they are
dealt out, so a shard gets each form at most once a block, however many documents share it. The slices of an anchor that
over ``HOT`` documents have may still all differ (at the edges of a shared passage): their strings are dealt out one by
one, by their own hashes, so no shard gets them all. In a block of documents and among the strings of hot anchors, what is
equal is told by two 64-bit hashes (of the anchor and of the whole); between blocks it is told by the bytes.

Defined cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose none; texts of any length are used
whole; rows with equal ids and equal texts are one document (ids are expected to be distinct); rows with null ids are
documents too, at numbers from 2**62 on by their texts' hashes, so after smaller ids, and keep their null; an empty table gives no
rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.packed import bitmap, dealt, gathered, has, spot, stand_in, unpacked
from parley.llm.scratch import written
from parley.llm.suffixes import BUDGET, Disk, sorted_suffixes
from parley.llm.textio import byte_values, equal_spans, give_back, mix64, powers, released, span_hashes, texts_of

LENGTH = 100
GRAM = 50
HOT = 10_000
BLOCK_BYTES = 16 << 20  # of texts that a block of documents has on average, at most: a task holds a block several times over
SHARD_BYTES = 8 << 20  # of slices; even if all are laid, their S* suffixes (every other byte at most) are within BUDGET
POSTED = 1 << 19  # anchors that are dealt out at once
SLICES, SPANS = -2, -1  # what a row of the cut texts holds; from 0 on, it is a shard of hot strings
ANCHOR = np.dtype([("h", "<u8"), ("doc", "<i8")])
FLAGGED = np.dtype([("h", "<u8"), ("doc", "<i8"), ("hot", "u1")])
FORM = np.dtype([("h", "<u8"), ("own", "<u8")])
WINDOW = np.dtype([("h", "<u8"), ("own", "<u8"), ("doc", "<i8"), ("at", "<i8")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: ``(text, first string, last string, anchor)``, positions in ``data``."""
    n = len(data)
    last = n - LENGTH + 1
    none = np.zeros(0, np.int64)
    if last <= 0:
        return none, none, none, none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[:n], out=total[1:])
    h = mix64((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    # The least hash, of equal ones the last: the upper half is the hash, the lower counts down.
    key = h & np.uint64(0xFFFFFFFF00000000) | np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    anchor = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)[:last]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:last]
    inside = offsets[text + 1] - np.arange(last) >= LENGTH
    at = np.flatnonzero(inside)
    anchor, text = anchor[at], text[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    return text[begin], at[begin], at[stop], anchor[begin]


def gram_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return span_hashes(data, at, at + GRAM)


def first_of_block(seen: np.ndarray, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether neither ``seen`` nor an earlier entry has the same form, and ``seen`` with the new forms."""
    both = np.empty(len(seen) + len(h), FORM)
    both[: len(seen)] = seen
    both["h"][len(seen) :], both["own"][len(seen) :] = h, own
    by = np.lexsort((both["own"], both["h"]))
    new = np.ones(len(both), bool)
    new[by[1:]] = both[by[1:]] != both[by[:-1]]
    return new[len(seen) :], both[new]


def repeated_hashes(w: np.ndarray) -> np.ndarray:
    """Spans to remove, from strings of hot anchors, each with its own hash."""
    w = w[np.lexsort((w["at"], w["doc"], w["own"], w["h"]))]
    again = np.zeros(len(w), bool)
    again[1:] = (w["own"][1:] == w["own"][:-1]) & (w["h"][1:] == w["h"][:-1])
    return _spans(w["doc"][again], w["at"][again], LENGTH)


def _spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(doc), SPAN)
    out["doc"], out["start"], out["end"] = doc, start, start + size
    return out


class Forms:
    """The slices of a shard, in the order of their hashes: equal ones are told at once, the different forms of an anchor
    that has several are laid end to end on the disk."""

    def __init__(self, disk: Disk):
        self.text, self.base, self.size, self.doc, self.at = disk.sink(np.uint8), *(disk.sink(np.int64) for _ in range(4))
        self.previous: tuple | None = None  # the last slice
        self.pending: tuple | None = None  # a form whose anchor has no other one yet
        self.laid = None  # the anchor whose forms are being laid

    def add(self, h: np.ndarray, own: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Take slices; those that repeat an earlier one whole are the spans that are given back."""
        carried = [x for x in (self.previous, self.pending) if x is not None]
        lead = len(carried)
        h, own, doc, at = (np.concatenate([np.array([c[k] for c in carried], x.dtype), x]) for k, x in enumerate((h, own, doc, at)))
        size = np.concatenate([np.array([len(c[4]) for c in carried], np.int64), size])
        data = np.concatenate([*(c[4] for c in carried), data])
        start = np.cumsum(size) - size
        rows = np.arange(lead, len(h))
        before = np.append(0 if self.previous is not None else lead, rows[:-1])
        same = (h[rows] == h[before]) & (own[rows] == own[before]) & equal_spans(data, start[rows], size[rows], start[before], size[before])
        if self.previous is None:
            same[0] = False
        again, heads = rows[same], rows[~same]
        last = len(h) - 1
        self.previous = (h[last], own[last], doc[last], at[last], data[start[last] : start[last] + size[last]].copy())
        if len(heads):
            if self.pending is not None:
                heads = np.append(lead - 1, heads)
            new = np.append(True, h[heads][1:] != h[heads][:-1])
            count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            lay = (count > 1) | (h[heads] == self.laid if self.laid is not None else False)
            end = heads[-1]
            if lay[-1]:
                self.laid, self.pending = h[end], None
            else:
                self.pending = (h[end], own[end], doc[end], at[end], data[start[end] : start[end] + size[end]].copy())
            self._lay(doc[heads[lay]], at[heads[lay]], start[heads[lay]], size[heads[lay]], data)
        return _spans(doc[again], at[again], size[again])

    def _lay(self, doc: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        if not len(doc):
            return
        base = np.cumsum(size + 1) - (size + 1)
        laid = np.zeros(int((size + 1).sum()), np.uint8)
        laid[np.arange(int(size.sum())) + np.repeat(base - (np.cumsum(size) - size), size)] = gathered(data, start, size) + np.uint8(1)  # UTF-8 has no byte 255; 0 ends a slice
        self.base.add(base + self.text.size)
        self.text.add(laid)
        self.size.add(size)
        self.doc.add(doc)
        self.at.add(at)


def repeated_strings(forms: Forms, disk: Disk, budget: int = BUDGET) -> Iterator[np.ndarray]:
    """Spans to remove: of the strings of all forms that are equal, all but the first."""
    base, size, docs, ats = (x.whole() for x in (forms.base, forms.size, forms.doc, forms.at))
    best: tuple | None = None  # of the string that the last block ended with
    for pos, lcp in sorted_suffixes(forms.text.whole(), LENGTH, budget, disk):
        group = np.cumsum(lcp < LENGTH)
        final = int(group[-1])
        row = np.searchsorted(base, pos, "right") - 1
        off = pos - base[row]
        good = np.flatnonzero(off + LENGTH <= size[row])
        group, doc, at = group[good], docs[row[good]], ats[row[good]] + off[good]
        if best is not None and final >= 0:  # it stands first in its group, which this block goes on with
            group, doc, at = np.append(0, group), np.append(best[0], doc), np.append(best[1], at)
        by = np.lexsort((at, doc, group))
        group, doc, at = group[by], doc[by], at[by]
        first = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
        yield _spans(doc[~first], at[~first], LENGTH)
        ends = np.flatnonzero(first & (group == final))
        best = (int(doc[ends[0]]), int(at[ends[0]])) if len(ends) else None


def shard_spans(blocks: int, budget: int = BUDGET, most: int = 500_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans to remove from the slices of a shard, packed by the block of their document."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            found = merged(np.concatenate(held)) if held else np.zeros(0, SPAN)
            held.clear()
            size = 0
            yield from _with_docs(found, blocks).to_batches()

        with Disk() as disk:
            forms = Forms(disk)
            for batch in batches:
                if batch.num_rows:
                    h, own, doc, at = (batch.column(k).to_numpy().copy() for k in range(4))
                    offsets, data = _bytes_of(batch.column(4))
                    held.append(forms.add(h, own, doc, at, np.diff(offsets), data))
                    size += len(held[-1])
                    if size >= most:
                        yield from flush()
            for found in repeated_strings(forms, disk, budget):
                held.append(found)
                size += len(found)
                if size >= most:
                    yield from flush()
        yield from flush()

    return run


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes laid end to end as an array of binary values."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def merged(spans: np.ndarray) -> np.ndarray:
    """Unions of overlapping or adjoining spans, by document."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    new_doc = np.append(True, spans["doc"][1:] != spans["doc"][:-1])
    # Ends grow within a document; a shift by document keeps the running maximum apart.
    number = np.cumsum(new_doc) - 1
    reach = int(spans["end"].max()) + 1
    if len(spans) * reach < 1 << 62:
        ends = np.maximum.accumulate(spans["end"] + number * reach) - number * reach
    else:
        ends = np.concatenate([np.maximum.accumulate(part) for part in np.split(spans["end"], np.flatnonzero(new_doc)[1:])])
    begin = new_doc.copy()
    begin[1:] |= spans["start"][1:] > ends[:-1]
    at = np.flatnonzero(begin)
    out = spans[at].copy()
    out["end"] = ends[np.append(at[1:], len(spans)) - 1]
    return out


def _doc_block(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = table.column("doc").to_numpy()
    for lo, hi, data, offsets in texts_of(table.column("text")):
        yield ids[lo:hi], data, offsets


def deduplicate(df: DataFrame, finish: Callable[[bytes, np.ndarray], tuple], names: list[str], types: list[pa.DataType], ddl: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, hot: int = HOT, budget: int = BUDGET) -> DataFrame:
    """``(id, *carry, *names)`` of each row, with what ``finish(bytes, spans)`` makes of a text and its ``(start, end)`` to remove."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("bigint"), stand_in(text))
    texts = df.select(doc.alias("doc"), text.alias("text"))

    # Equal texts: the least document stands for all.
    equal = texts.select("doc", F.md5("text").alias("digest"), F.octet_length("text").alias("n"))
    # They are a table of their own: then the large groups of a join with them can be split.
    classes = written(equal.groupBy("digest", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("size")), "text-classes")
    blocks = max(8, 2 * parts, -(-(classes.agg(F.sum("n")).first()[0] or 0) // BLOCK_BYTES))
    rep_bits = spark.sparkContext.broadcast(bitmap(classes, "rep"))

    @released
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            return dealt(rows, (mix64(rows["h"]) % np.uint64(blocks)).astype(np.int64), blocks)

        for batch in batches:
            batch = batch.filter(pa.array(has(rep_bits.value, batch.column(2).to_numpy())))
            ids = batch.column(0).to_numpy()
            for lo, _, data, offsets in texts_of(batch.column(1)):
                of, _, _, at = anchors(data, offsets)
                rows = np.empty(len(at), ANCHOR)
                rows["h"], rows["doc"] = gram_hashes(data, at), ids[lo + of]
                # Twice tells as much as often.
                by = np.lexsort((rows["doc"], rows["h"]))
                rows = rows[by]
                third = np.zeros(len(rows), bool)
                third[2:] = (rows["h"][2:] == rows["h"][:-2]) & (rows["doc"][2:] == rows["doc"][:-2])
                held.append(rows[~third])
                size += len(held[-1])
                if size >= POSTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def repeated(table: pa.Table) -> pa.Table:
        give_back()
        rows = unpacked(table.column("rows"), ANCHOR)
        rows = rows[np.argsort(rows["h"], kind="stable")]
        same = rows["h"][1:] == rows["h"][:-1]
        again = np.zeros(len(rows), bool)
        again[1:] |= same
        again[:-1] |= same
        rows = np.unique(rows[again])
        _, of, count = np.unique(rows["h"], return_inverse=True, return_counts=True)
        marked = np.empty(len(rows), FLAGGED)
        marked["h"], marked["doc"], marked["hot"] = rows["h"], rows["doc"], count[of] > hot
        out = _with_docs(marked, blocks)
        some = [int(np.frombuffer(b, FLAGGED)["hot"].sum()) for b in out.column("rows").to_pylist()]
        return out.append_column("hots", pa.array(some, pa.int64()))

    posted = texts.select("doc", "text", spot("doc").alias("s")).mapInArrow(post, "block int, rows binary")
    flagged = written(posted.groupBy("block").applyInArrow(repeated, "block int, rows binary, docs array<bigint>, hots bigint"), "repeated-anchors")
    # A hot anchor has at most as many strings in a document as fit around it, of 32 bytes each.
    hots = flagged.agg(F.sum("hots")).first()[0] or 0
    shards = max(8, parts, -(-hots * (LENGTH - GRAM + 1) * WINDOW.itemsize // SHARD_BYTES))
    bits = spark.sparkContext.broadcast(bitmap(flagged.select(F.explode("docs").alias("doc")), "doc"))

    @released
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = has(bits.value, batch.column(2).to_numpy()) & has(rep_bits.value, batch.column(2).to_numpy())
            own = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([pa.array(_doc_block(own.column(0).to_numpy().copy(), blocks).astype(np.int32)), own.column(0), own.column(1)], names=["block", "doc", "text"])

    numbers = [(name, pa.int64()) for name in ("h", "own", "doc", "at")]
    cut_schema = pa.schema([("shard", pa.int32()), *numbers, ("slices", pa.binary()), ("spans", pa.binary())])
    cut_ddl = "shard int, h bigint, own bigint, doc bigint, at bigint, slices binary, spans binary"

    def slices(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        wanted = unpacked(right.column("rows"), FLAGGED) if right.num_rows else np.zeros(0, FLAGGED)
        hot_anchors = np.unique(wanted["h"][wanted["hot"] > 0])
        seen, seen_windows = np.zeros(0, FORM), np.zeros(0, FORM)
        pairs = np.unique(mix64(wanted["h"] ^ mix64(wanted["doc"].view(np.uint64))))
        out: list[pa.RecordBatch] = []
        if left.num_rows:
            # A document that is there twice is one document.
            left = left.take(pa.array(np.unique(left.column("doc").to_numpy(), return_index=True)[1]))
            for ids, data, offsets in _texts(left):
                of, first, last, at = anchors(data, offsets)
                h, doc = gram_hashes(data, at), ids[of]
                own = np.isin(mix64(h ^ mix64(doc.view(np.uint64))), pairs)
                of, first, last, at, h, doc = (x[own] for x in (of, first, last, at, h, doc))
                size = last - first + LENGTH
                form = span_hashes(data, first, first + size)
                # The anchor's place in the slice is part of its form.
                form = mix64(form ^ (at - first).astype(np.uint64))
                # Texts come in the order of their documents: what a form's first slice has, the later ones repeat.
                new, seen = first_of_block(seen, h, form)
                spans = [_spans(doc[~new], (first - offsets[of])[~new], size[~new])]
                warm = new & ~np.isin(h, hot_anchors)
                some = int(warm.sum())
                numbers = (h[warm].view(np.int64), form[warm].view(np.int64), doc[warm], (first - offsets[of])[warm])
                bytes_ = _binaries(gathered(data, first[warm], size[warm]), size[warm])
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(some, SLICES, np.int32)), *map(pa.array, numbers), bytes_, pa.nulls(some, pa.binary())], schema=cut_schema))
                row = np.flatnonzero(new & ~warm)
                if len(row):
                    count = size[row] - LENGTH + 1
                    start = np.arange(int(count.sum())) + np.repeat(first[row] - (np.cumsum(count) - count), count)
                    row = np.repeat(row, count)
                    w = np.empty(len(row), WINDOW)
                    w["h"], w["doc"], w["at"] = h[row], doc[row], start - offsets[of[row]]
                    w["own"] = mix64(span_hashes(data, start, start + LENGTH) ^ (at[row] - start).astype(np.uint64))
                    new, seen_windows = first_of_block(seen_windows, w["h"], w["own"])
                    spans.append(_spans(w["doc"][~new], w["at"][~new], LENGTH))
                    w = w[new]
                    packed = dealt(w, (mix64(w["own"] ^ mix64(w["h"])) % np.uint64(shards)).astype(np.int64), shards)
                    none = [pa.nulls(len(packed), pa.int64())] * 4
                    out.append(pa.RecordBatch.from_arrays([packed.column(0), *none, packed.column(1), pa.nulls(len(packed), pa.binary())], schema=cut_schema))
                spans = np.concatenate(spans)
                if len(spans):
                    none = [pa.nulls(1, pa.int64())] * 4
                    out.append(pa.RecordBatch.from_arrays([pa.array([SPANS], pa.int32()), *none, pa.nulls(1, pa.binary()), pa.array([merged(spans).tobytes()], pa.binary())], schema=cut_schema))
        return pa.Table.from_batches(out, cut_schema)

    sifted = texts.select("doc", "text", spot("doc").alias("s")).mapInArrow(sift, "block int, doc bigint, text string")
    cut = sifted.groupBy("block").cogroup(flagged.select("block", "rows").groupBy("block")).applyInArrow(slices, cut_ddl)
    cut = written(cut, "repeated-slices")

    def hot_strings(table: pa.Table) -> pa.Table:
        give_back()
        return _with_docs(merged(repeated_hashes(unpacked(table.column("slices"), WINDOW))), blocks)

    @released
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield from _with_docs(np.frombuffer(blob, SPAN), blocks).to_batches()

    schema = "block int, rows binary, docs array<bigint>"
    size = cut.filter(F.col("shard") == SLICES).agg(F.sum(F.length("slices"))).first()[0] or 0
    dealt_slices = cut.filter(F.col("shard") == SLICES).select("h", "own", "doc", "at", "slices").repartition(max(parts, -(-size // SHARD_BYTES)), "h")
    between = dealt_slices.sortWithinPartitions("h", "own", "doc", "at").mapInArrow(shard_spans(blocks, budget), schema)
    edges = cut.filter("shard >= 0").select("shard", "slices").groupBy("shard").applyInArrow(hot_strings, schema)
    inner = cut.filter(F.col("shard") == SPANS).select("spans").mapInArrow(local, schema)
    spans = written(between.unionAll(edges).unionAll(inner), "repeated-spans")

    # What a row carries along goes in one struct, with its own id, which may be null.
    along = F.struct(F.col(id_col).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry or [])))
    source = df.select(doc.alias("doc"), text.alias("text"), spot(doc).alias("s"), along.alias("along"))
    along_ddl = source.schema["along"].dataType.simpleString()

    # Copies of whole texts, and documents with spans, are dealt out; the rest is finished where it is read.
    span_bits = spark.sparkContext.broadcast(bitmap(spans.select(F.explode("docs").alias("doc")), "doc"))
    several = classes.filter("size > 1").select("digest", "n", "rep")
    copied = equal.join(several, ["digest", "n"]).filter("doc <> rep").select("doc", "n")
    copies = copied.select(F.col("doc"), F.col("n")).distinct()
    whole = written(copies.mapInArrow(_whole(blocks), schema), "repeated-texts")
    copy_bits = spark.sparkContext.broadcast(bitmap(whole.select(F.explode("docs").alias("doc")), "doc"))
    empty = np.zeros((0, 2), np.int64)

    @released
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            own = batch.filter(pa.array(~(has(span_bits.value, s) | has(copy_bits.value, s))))
            ids = own.column(0)
            for lo, hi, data, offsets in texts_of(own.column(1)):
                made = [finish(data[offsets[k] : offsets[k + 1]].tobytes(), empty) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), own.column(3).slice(lo, hi - lo), *(pa.array([m[c] for m in made], t) for c, t in enumerate(types))], names=["doc", "along", *names])

    @released
    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            own = batch.filter(pa.array(has(span_bits.value, s) | has(copy_bits.value, s)))
            yield pa.RecordBatch.from_arrays([pa.array(_doc_block(own.column(0).to_numpy().copy(), blocks).astype(np.int32)), own.column(0), own.column(1), own.column(3)], names=["block", "doc", "text", "along"])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        found = merged(unpacked(right.column("rows"), SPAN)) if right.num_rows else np.zeros(0, SPAN)
        out: list[pa.RecordBatch] = []
        if left.num_rows:
            left = left.combine_chunks()
            lo = 0
            for ids, data, offsets in _texts(left):
                a, b = np.searchsorted(found["doc"], ids, "left"), np.searchsorted(found["doc"], ids, "right")
                made = []
                for k in range(len(ids)):
                    own = found[a[k] : b[k]]
                    made.append(finish(data[offsets[k] : offsets[k + 1]].tobytes(), np.stack([own["start"], own["end"]], axis=1)))
                carried = left.column("along").slice(lo, len(ids)).combine_chunks()
                lo += len(ids)
                out.append(pa.RecordBatch.from_arrays([pa.array(ids), carried.chunk(0) if isinstance(carried, pa.ChunkedArray) else carried, *(pa.array([m[c] for m in made], t) for c, t in enumerate(types))], names=["doc", "along", *names]))
        return pa.Table.from_batches(out, pa.schema([("doc", pa.int64()), left.schema.field("along").with_nullable(True), *zip(names, types, strict=True)]))

    out_ddl = f"doc bigint, along {along_ddl}, {ddl}"
    rest = source.mapInArrow(alone, out_ddl)
    gone = spans.unionAll(whole).select("block", "rows")
    dealt_out = source.mapInArrow(touched, f"block int, doc bigint, text string, along {along_ddl}")
    changed = dealt_out.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(remove, out_ddl)
    carried = (F.col(f"along.c{k}").alias(c) for k, c in enumerate(carry or []))
    return rest.unionAll(changed).select(F.col("along._").alias(id_col), *carried, *(F.col(f"`{n}`") for n in names))


def _with_docs(rows: np.ndarray, blocks: int) -> pa.Table:
    """Rows packed by the block of their document, with the documents that each block has."""
    batch = dealt(rows, _doc_block(np.ascontiguousarray(rows["doc"]), blocks), blocks)
    docs = [np.unique(np.frombuffer(b, rows.dtype)["doc"]) for b in batch.column(1).to_pylist()]
    return pa.table({"block": batch.column(0), "rows": batch.column(1), "docs": pa.array(docs, pa.list_(pa.int64()))})


def _whole(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            spans = np.zeros(int((n >= LENGTH).sum()), SPAN)
            spans["doc"], spans["end"] = doc[n >= LENGTH], n[n >= LENGTH]
            yield from _with_docs(spans, blocks).to_batches()

    return run


def cut_out(text: bytes, spans: np.ndarray) -> bytes:
    parts, at = [], 0
    for start, end in spans.tolist():
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]])


def _digest(text: bytes, spans: np.ndarray) -> tuple:
    kept = cut_out(text, spans)
    return len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, budget: int = BUDGET) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row."""
    return deduplicate(
        df, _digest, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()],
        "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", id_col, text_col, hot=hot, budget=budget,
    )


def kept_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without its repeats; characters cut in two by a repeat's bounds go with it, a null text becomes empty."""
    others, name = [c for c in df.columns if c not in (id_col, text_col)], "kept text"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    made = deduplicate(df, lambda text, spans: (cut_out(text, spans).decode("utf-8", "ignore"),), [name], [pa.string()], f"`{name}` string", id_col, text_col, others)
    return made.select(*(F.col(f"`{name}`").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns))
