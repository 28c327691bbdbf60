"""External induced sorting of suffixes with their common prefixes, to a bounded depth.

The suffixes that begin a rise after a fall (S*) are sorted first. Where there are more than a budget of them, their
substrings up to the next one are named by rank, and the text of names is sorted by the same procedure to half the depth,
and so on recursively; few enough are sorted directly. The order of all others is induced: a scan over the sorted
suffixes puts each one's left neighbour into a priority queue, L suffixes in an ascending and then S suffixes in a
descending pass. Every queued tuple carries its position and the length of the prefix that it has in common with the
tuple before it under its symbol, which is one more than the least such length between their two sources, so no two
suffixes are compared in the induction.

Keys of the queue are (symbol, rank of the source). They only ever rise (fall), so the queue is a radix queue: ranges of
symbols of about equal weight, whose tuples lie in order of arrival, in memory up to the budget and in a file beyond. The
range being read is split by symbol, and a symbol's tuples are read first in, first out.

Text, types, S* positions and the L buckets between the two passes lie in files, too, which are mapped or read a block at
a time: what is in memory is bounded by the budget, whatever the length of the text.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18  # symbols or tuples that are worked on at once
WINDOWS = 1 << 16  # suffixes whose first symbols are laid out side by side to be sorted
BUDGET = 4_000_000  # tuples held by a queue, and S* suffixes sorted directly
UNSEEN = -1

Tuples = tuple[np.ndarray, np.ndarray]


class Sink:
    """An array that grows in a file, and is mapped when it is whole."""

    def __init__(self, path: str, kind: np.dtype):
        self.path, self.kind, self.size = path, kind, 0
        self.file = open(path, "wb")  # noqa: SIM115

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.kind).data)
        self.size += len(values)

    def whole(self) -> np.ndarray:
        self.file.close()
        return np.memmap(self.path, self.kind, "r", shape=(self.size,)) if self.size else np.zeros(0, self.kind)


class Disk:
    """A task's own files: arrays appended to one of them, and mapped arrays. All are gone when it is closed."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory(prefix="parley-suffixes-")
        self.file = open(os.path.join(self.folder.name, "spilled"), "w+b")  # noqa: SIM115
        self.number = 0

    def put(self, *arrays: np.ndarray) -> tuple:
        at = self.file.seek(0, 2)
        for a in arrays:
            self.file.write(np.ascontiguousarray(a).data)
        return at, len(arrays[0]), tuple(a.dtype for a in arrays)

    def get(self, held: tuple) -> tuple[np.ndarray, ...]:
        at, n, kinds = held
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)

    def sink(self, kind) -> Sink:
        self.number += 1
        return Sink(os.path.join(self.folder.name, str(self.number)), np.dtype(kind))

    def mapped(self, n: int, kind) -> np.ndarray:
        self.number += 1
        return np.memmap(os.path.join(self.folder.name, str(self.number)), kind, "w+", shape=(max(1, n),))[:n]

    def close(self) -> None:
        self.file.close()
        self.folder.cleanup()

    def __enter__(self) -> Disk:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def loaded(part: tuple, disk: Disk) -> tuple[np.ndarray, ...]:
    return part if isinstance(part[0], np.ndarray) else disk.get(part)


class Queue:
    """Tuples by (symbol, arrival), read from the smallest symbol up, or from the largest down. ``weights`` are the numbers
    of tuples that may come by symbol."""

    def __init__(self, weights: np.ndarray, budget: int, disk: Disk, ascending: bool):
        share = max(1, budget // 4)
        total = np.cumsum(weights)
        total -= weights
        total //= share
        heavy = weights > share
        cut = np.append(True, (total[1:] != total[:-1]) | heavy[1:] | heavy[:-1])
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], len(weights))
        self.parts: dict[int, deque] = {}
        self.waiting: list[int] = []  # ranges that hold tuples, as a heap
        self.sign, self.budget, self.disk, self.held = (1 if ascending else -1), budget, disk, 0
        self.range = None  # the one being read
        self.own: dict[int, deque] = {}
        self.symbols: list[int] = []  # heap of the symbols in it

    def range_of(self, symbol) -> np.ndarray:
        return np.searchsorted(self.starts, symbol, "right") - 1

    def put(self, symbol: np.ndarray, pos: np.ndarray, common: np.ndarray) -> None:
        """Tuples in order of arrival for each symbol, sorted by symbol."""
        ranges = self.range_of(symbol)
        cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])).tolist() + [len(symbol)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            r = int(ranges[a])
            if r == self.range:
                self._read(symbol[a:b], pos[a:b], common[a:b])
                continue
            if r not in self.parts:
                self.parts[r] = deque()
                heapq.heappush(self.waiting, self.sign * r)
            self.parts[r].append((symbol[a:b].copy(), pos[a:b].copy(), common[a:b].copy()))  # a view would hold all of its block
            self.held += b - a
        if self.held > self.budget:
            self._spill()

    def _read(self, symbol: np.ndarray, pos: np.ndarray, common: np.ndarray) -> None:
        cuts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])).tolist() + [len(symbol)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            s = int(symbol[a])
            if s not in self.own:
                self.own[s] = deque()
                heapq.heappush(self.symbols, self.sign * s)
            self.own[s].append((pos[a:b].copy(), common[a:b].copy()))
            self.held += b - a

    def _spill(self) -> None:
        for parts in (*self.parts.values(), *self.own.values()):
            for k, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    self.held -= len(part[0])
                    parts[k] = self.disk.put(*part)

    def next(self, limit: int | None = None) -> int | None:
        """The symbol to be read next, or None if none comes before or with ``limit``."""
        while not self.symbols:
            if not self.waiting or (limit is not None and self.waiting[0] > self.sign * int(self.range_of(limit))):
                return None
            self.range = self.sign * heapq.heappop(self.waiting)
            parts = self.parts.pop(self.range)
            first = int(self.starts[self.range])
            if self.ends[self.range] == first + 1:  # one symbol, maybe more tuples than memory holds: its parts stay where they are
                self.own[first] = deque((p[1], p[2]) if isinstance(p[0], np.ndarray) else p for p in parts)
                heapq.heappush(self.symbols, self.sign * first)
                continue
            own = [loaded(p, self.disk) for p in parts]
            self.held -= sum(len(p[0]) for p in parts if isinstance(p[0], np.ndarray))
            symbol, pos, common = (np.concatenate([p[k] for p in own]) for k in range(3))
            by = np.argsort(symbol, kind="stable")
            self._read(symbol[by], pos[by], common[by])
        return self.sign * self.symbols[0]

    def blocks(self, symbol: int) -> Iterator[Tuples]:
        """All tuples of the next symbol, with those that are put in meanwhile."""
        own = self.own[symbol]
        while own:
            held, size = [], 0
            while own and size < BLOCK:
                part = own.popleft()
                if isinstance(part[0], np.ndarray):
                    self.held -= len(part[0])
                    held.append(part)
                else:
                    held.append(self.disk.get(part)[-2:])
                size += len(held[-1][0])
            yield np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
        del self.own[symbol]
        heapq.heappop(self.symbols)


class Least:
    """Range minima of small numbers by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of ``values[lo:hi]``, none of them empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for k in np.unique(level).tolist():
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
        return out


class Scan:
    """One pass of induction. ``wanted`` tells which left neighbours are induced."""

    def __init__(self, text: np.ndarray, depth: int, wanted: np.ndarray, value: bool, queue: Queue, last: np.ndarray):
        self.text, self.depth, self.wanted, self.value, self.queue = text, depth, wanted, value, queue
        self.last = last  # by symbol, where the scan was when a tuple was last queued for it
        self.last[:] = UNSEEN
        self.seen = np.full(depth + 1, UNSEEN, np.int64)  # by length of a common prefix, where the scan last had it
        self.at = 0

    def step(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Induce from scanned suffixes, in order; ``lcp`` is what each has in common with the one scanned before it."""
        keep = np.flatnonzero(pos > 0)
        keep = keep[self.wanted[pos[keep] - 1] == self.value]
        if len(keep):
            symbol = self.text[pos[keep] - 1].astype(np.int64)
            by = np.argsort(symbol, kind="stable")
            at, symbol = keep[by], symbol[by]
            first = np.append(True, symbol[1:] != symbol[:-1])
            head = np.flatnonzero(first)
            low = Least(lcp).over(np.where(first, 0, np.append(0, at[:-1] + 1)), at + 1)
            before = self.last[symbol[head]]
            since = self.seen[None, :] > before[:, None]
            low[head] = np.minimum(low[head], np.where(since.any(axis=1), since.argmax(axis=1), 255))
            common = np.minimum(low.astype(np.int64) + 1, self.depth).astype(np.uint8)
            common[head[before == UNSEEN]] = 0
            self.last[symbol[head]] = self.at + at[np.append(head[1:], len(at)) - 1]
            self.queue.put(symbol, pos[at] - 1, common)
        self.seen[lcp] = self.at + np.arange(len(pos))
        self.at += len(pos)


def types_of(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Whether each suffix is S, that is less than the next one; the end counts as less than any symbol."""
    n, out = len(text), disk.mapped(len(text), bool)
    after, s_after = -1, False
    for hi in range(n, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        own = np.append(text[lo:hi].astype(np.int64), after)
        turn, rise = own[:-1] != own[1:], own[:-1] < own[1:]
        at = np.minimum.accumulate(np.where(turn, np.arange(hi - lo), hi - lo)[::-1])[::-1]
        out[lo:hi] = np.append(rise, s_after)[at]
        after, s_after = int(own[0]), bool(out[lo])
    return out


def stars_of(s_type: np.ndarray, disk: Disk) -> np.ndarray:
    parts, size = [], 0
    for lo in range(1, len(s_type), BLOCK):
        hi = min(len(s_type), lo + BLOCK)
        own = np.flatnonzero(s_type[lo:hi] & ~s_type[lo - 1 : hi - 1]) + lo
        parts.append(disk.put(own))
        size += len(own)
    out, at = disk.mapped(size, np.int64), 0
    for part in parts:
        (own,) = disk.get(part)
        out[at : at + len(own)] = own
        at += len(own)
    return out


def windows(text: np.ndarray, pos: np.ndarray, size: np.ndarray | int, depth: int, pad: np.ndarray | int, kind: np.dtype) -> np.ndarray:
    """Symbols plus one of ``text[pos:pos + size]`` in ``depth`` columns, then ``pad``; the end of the text is 0."""
    out = np.empty((len(pos), depth), kind)
    for k in range(depth):
        at = pos + k
        own = np.where(k < size, text[np.minimum(at, len(text) - 1)].astype(np.int64) + 1, pad)
        own[(at >= len(text)) & (k <= size)] = 0
        out[:, k] = own
    return out


def top_of(text: np.ndarray) -> tuple[int, np.dtype]:
    """A number above all symbols plus one, and the smallest kind that sorts as bytes and holds it."""
    top = int(max(text[lo : lo + BLOCK].max() for lo in range(0, len(text), BLOCK))) + 2
    return top, np.dtype(next(k for k in ("u1", ">u2", ">u4", ">u8") if top >> 8 * np.dtype(k).itemsize == 0))


def as_bytes(keys: np.ndarray) -> np.ndarray:
    """Rows of numbers as one string each, in the same order."""
    return keys.view(f"S{keys.shape[1] * keys.itemsize}").ravel()


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, up to ``depth``."""
    out, open_ = np.zeros(len(a), np.uint8), np.arange(len(a))
    for k in range(depth):
        open_ = open_[np.maximum(a[open_], b[open_]) + k < len(text)]
        open_ = open_[text[a[open_] + k] == text[b[open_] + k]]
        if not len(open_):
            break
        out[open_] = k + 1
    return out


def sorted_stars(text: np.ndarray, stars: np.ndarray, depth: int, budget: int, disk: Disk) -> Tuples:
    """The S* positions in ascending order of their suffixes, with common prefixes."""
    order = disk.mapped(len(stars), np.int64)
    if len(stars) <= budget:
        _sort_directly(text, stars, depth, order, min(budget, WINDOWS))
    else:
        names, count = _names(text, stars, depth, budget, disk)
        at = len(stars)
        for pos, _ in sorted_suffixes(names, depth // 2 + 1, budget, disk, count):
            order[at - len(pos) : at] = stars[pos[::-1]]
            at -= len(pos)
    lcp = disk.mapped(len(stars), np.uint8)
    for lo in range(0, len(stars), BLOCK):
        hi = min(len(stars), lo + BLOCK)
        lcp[lo:hi] = common(text, order[lo:hi], order[max(0, lo - 1) : hi - 1] if lo else np.append(order[:1], order[: hi - 1]), depth)
    lcp[:1] = 0
    return order, lcp


def _sort_directly(text: np.ndarray, pos: np.ndarray, depth: int, out: np.ndarray, batch: int) -> None:
    """By two symbols at a time, as long as more than ``batch`` agree in them, then part by part by whole windows."""
    top, kind = top_of(text)
    pos = np.array(pos)
    todo = [(0, len(pos), 0)]  # ranges that agree in their first symbols
    while todo:
        lo, hi, d = todo.pop()
        part = pos[lo:hi]
        if hi - lo <= batch or d >= depth:
            rest = max(0, depth - d)
            out[lo:hi] = part[np.argsort(as_bytes(windows(text, part + d, rest, rest, 0, kind)), kind="stable")] if rest and hi - lo > 1 else part
            continue
        lead = np.empty(hi - lo, np.uint16 if top < 256 else np.int64)
        for at in range(0, hi - lo, BLOCK):
            two = windows(text, part[at : at + BLOCK] + d, 2, 2, 0, np.int64)
            lead[at : at + BLOCK] = two[:, 0] * top + two[:, 1]
        by = np.argsort(lead, kind="stable")
        part[:] = part[by]
        lead = lead[by]
        cuts = np.append(np.flatnonzero(np.append(True, lead[1:] != lead[:-1])), hi - lo)
        at = 0
        while at < hi - lo:
            stop = int(cuts[np.searchsorted(cuts, at + batch, "right") - 1])
            alone = stop <= at
            stop = int(cuts[np.searchsorted(cuts, at, "right")]) if alone else stop
            todo.append((lo + at, lo + stop, d + 2 * alone))
            at = stop


def _names(text: np.ndarray, stars: np.ndarray, depth: int, budget: int, disk: Disk) -> tuple[np.ndarray, int]:
    """A text of names: the rank of each S* substring (up to the next S*, its symbol included, at most ``depth``)."""
    m, names, count = len(stars), disk.mapped(len(stars), np.int64), 0
    top, kind = top_of(text)

    def sized(k: np.ndarray) -> Tuples:
        last = k + 1 == m
        size = np.where(last, len(text) - stars[k], stars[np.minimum(k + 1, m - 1)] - stars[k] + 1)
        # A substring that ends at an S* is greater than a longer one that goes on there with an L.
        return np.minimum(size, depth), np.where(last, 0, top)

    def column(k: np.ndarray, d: int) -> np.ndarray:
        size, pad = sized(k)
        return windows(text, stars[k] + d, size - d, 1, pad, kind)[:, 0].astype(np.int64)

    todo = [([disk.put(np.arange(lo, min(m, lo + BLOCK))) for lo in range(0, m, BLOCK)], m, 0)]
    while todo:
        parts, size, d = todo.pop()
        if size <= min(budget, WINDOWS):
            k = np.concatenate([disk.get(p)[0] for p in parts])
            length, pad = sized(k)
            keys = as_bytes(windows(text, stars[k], length, depth, pad, kind))
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            new = np.append(True, keys[1:] != keys[:-1])
            names[k[by]] = count + np.cumsum(new) - 1
            count += int(new.sum())
            continue
        if d == depth:
            for p in parts:
                names[disk.get(p)[0]] = count
            count += 1
            continue
        # Dealt out by the symbol in column d, in ranges of about equal weight.
        found: dict[int, int] = {}
        for p in parts:
            for v, c in zip(*(x.tolist() for x in np.unique(column(disk.get(p)[0], d), return_counts=True)), strict=True):
                found[v] = found.get(v, 0) + c
        values = np.array(sorted(found))
        total = np.cumsum([found[v] for v in values.tolist()])
        of = (total - 1) * 64 // size if len(values) > 64 else np.arange(len(values))
        groups = np.unique(of)
        out: list[list] = [[] for _ in groups]
        sizes = [0] * len(groups)
        for p in parts:
            k = disk.get(p)[0]
            own = np.searchsorted(groups, of[np.searchsorted(values, column(k, d))])
            for g in np.unique(own).tolist():
                out[g].append(disk.put(k[own == g]))
                sizes[g] += int((own == g).sum())
        single = [int((of == g).sum()) == 1 for g in groups.tolist()]
        todo += [(out[g], sizes[g], d + single[g]) for g in range(len(groups) - 1, -1, -1)]
    return names, count


def _weights(text: np.ndarray, symbols: int, disk: Disk) -> np.ndarray:
    out = disk.mapped(symbols, np.int64)
    for lo in range(0, len(text), BLOCK):
        value, count = np.unique(text[lo : lo + BLOCK], return_counts=True)
        out[value] += count
    return out


def sorted_suffixes(text: np.ndarray, depth: int, budget: int, disk: Disk, symbols: int = 256) -> Iterator[Tuples]:
    """Blocks of ``(position, common prefix with the one before)`` of all suffixes in descending order. Suffixes that agree
    in ``depth`` symbols come in any order. ``depth`` is at most 254."""
    n = len(text)
    if not n:
        return
    s_type = types_of(text, disk)
    star, star_lcp = sorted_stars(text, stars_of(s_type, disk), depth, budget, disk)
    weights, last = _weights(text, symbols, disk), disk.mapped(symbols, np.int64)

    # L suffixes, ascending; what is found goes to the disk in blocks over symbols.
    queue = Queue(weights, budget, disk, True)
    scan = Scan(text, depth, s_type, False, queue, last)
    queue.put(text[n - 1 :].astype(np.int64), np.array([n - 1]), np.zeros(1, np.uint8))
    last[int(text[n - 1])] = scan.at
    scan.seen[0], scan.at = scan.at, scan.at + 1
    kept: list[tuple] = []
    held: list[Tuples] = []
    size = s = 0

    def keep(pos: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal size
        held.append((pos, lcp))
        size += len(pos)
        if size >= BLOCK:
            kept.append(disk.put(np.concatenate([p for p, _ in held]), np.concatenate([x for _, x in held])))
            held.clear()
            size = 0

    while True:
        limit = int(text[star[s]]) if s < len(star) else None
        c = queue.next(limit)
        if c is None and limit is None:
            break
        c = limit if c is None or (limit is not None and limit < c) else c
        before = None
        if c in queue.own:
            for pos, lcp in queue.blocks(c):
                scan.step(pos, lcp)
                keep(pos, lcp)
                before = pos[-1:]
        while s < len(star) and text[star[s]] == c:
            stop = min(len(star), s + BLOCK)
            stop = s + int(np.searchsorted(text[star[s:stop]], c, "right"))
            lcp = np.array(star_lcp[s:stop])
            if before is not None:
                lcp[:1] = common(text, before, star[s : s + 1], depth)
                before = None
            scan.step(np.array(star[s:stop]), lcp)
            s = stop
            if c in queue.own:
                raise AssertionError("an S* suffix induced an L suffix of its own symbol")
    if held:
        kept.append(disk.put(np.concatenate([p for p, _ in held]), np.concatenate([x for _, x in held])))

    # S suffixes, descending, each symbol's before its L suffixes; all go out.
    queue = Queue(weights, budget, disk, False)
    scan = Scan(text, depth, s_type, True, queue, last)
    left: list[np.ndarray] = [*(disk.get(kept.pop()) if kept else (np.zeros(0, np.int64), np.zeros(0, np.uint8)))]
    while True:
        while not len(left[0]) and kept:
            left = [*disk.get(kept.pop())]
        limit = int(text[left[0][-1]]) if len(left[0]) else None
        c = queue.next(limit)
        if c is None and limit is None:
            return
        c = limit if c is None or (limit is not None and limit > c) else c
        before = None
        if c in queue.own:
            for pos, lcp in queue.blocks(c):
                scan.step(pos, lcp)
                yield pos, lcp
                before = pos[-1:]
        above = common(text, before, left[0][-1:], depth) if before is not None and limit == c else np.zeros(1, np.uint8)
        while len(left[0]) and text[left[0][-1]] == c:
            own = int(np.searchsorted(text[left[0]], c, "left"))
            pos, lcp = left[0][own:][::-1], left[1][own:][::-1]
            shown = np.append(above, lcp[:-1])
            above = lcp[-1:]
            left = [left[0][:own], left[1][:own]]
            scan.step(pos, shown)
            yield pos, shown
            while not len(left[0]) and kept:
                left = [*disk.get(kept.pop())]
        if c in queue.own:
            raise AssertionError("an L suffix induced an S suffix of its own symbol")


def equal_prefixes(text: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """A number for each position of ``text`` (uint8): equal where the first ``depth`` bytes are.

    The last ``depth`` positions get numbers, too, but those mean nothing.
    """
    group, number = np.zeros(len(text), np.int64), 0
    with Disk() as disk:
        for pos, lcp in sorted_suffixes(text, depth, budget, disk):
            own = number + np.cumsum(lcp < depth)
            group[pos], number = own, int(own[-1])
    return group
