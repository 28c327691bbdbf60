"""Vectorised pre-token split and a memo of pre-token ids.

The split is that of ``public_tokenizers.PATTERN`` over code points; each distinct pre-token of a chunk is encoded
once by the given encoder, and the ids of all texts are gathered from that.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from parley.llm.textio import distinct_spans

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Code points with the White_Space property.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What may follow an apostrophe that begins a pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def split(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts laid end to end; ``offsets`` are the texts' bounds in code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    starts = run & white
    # The last white space before something else stands alone or leads the next pre-token.
    starts[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]
    led = np.zeros(n, bool)
    led[1:] = (points[:-1] == 0x20) & ~first[1:n]
    starts |= run & ~white & ~led
    quotes = np.flatnonzero(starts & (points == 0x27))
    if len(quotes):
        ends = offsets[np.searchsorted(offsets, quotes, "right")]
        free = np.ones(len(quotes), bool)
        for c in CONTRACTIONS:
            hit = free & (quotes + 1 + len(c) <= ends)
            for k, ch in enumerate(c):
                hit[hit] = points[quotes[hit] + 1 + k] == ord(ch)
            free &= ~hit
            at = quotes[hit]
            starts[at + 1] = False
            after = at + 1 + len(c)
            after = after[after < n]
            # What is left of a run of letters begins a pre-token; other runs have begun already.
            starts[after[(kind[after] == LETTER) & ~first[after]]] = True
    return np.flatnonzero(starts)


class Memo:
    """Ids of whole texts, by the bytes of each pre-token. ``encode`` maps a list of pre-tokens to lists of ids."""

    LIMIT, LONG = 400_000, 256  # entries, and bytes of one that is kept; memory stays bounded whatever the corpus holds

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode, self.known = encode, {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ids before each text)`` of the texts in ``data``. Pre-tokens are the same if all their bytes are."""
        raw = data.tobytes()
        try:
            shown = raw.decode("utf-8")
        except UnicodeDecodeError:  # a column of bytes that was called text
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            offsets = np.cumsum([0, *map(len, texts)])
            raw = b"".join(texts)
            data, shown = np.frombuffer(raw, np.uint8), raw.decode("utf-8")
        points = np.frombuffer(shown.encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each code point begins
        starts = place[split(points, np.searchsorted(place, offsets))]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        first, number = distinct_spans(data, starts, ends)
        keys = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = [k for k in keys if k not in self.known]
        if len(self.known) + len(new) > self.LIMIT:
            self.known, new = {}, keys
        if new:
            found = self.encode([k.decode("utf-8") for k in new])
            self.known.update((k, array("I", ids).tobytes()) for k, ids in zip(new, found, strict=True))
        blobs = [self.known[k] for k in keys]
        for k in new:
            if len(k) > self.LONG:
                del self.known[k]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
        ids = np.frombuffer(b"".join([blobs[i] for i in number.tolist()]), np.uint32)
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes[number], out=before[1:])
        return ids, before[np.searchsorted(starts, offsets)]
