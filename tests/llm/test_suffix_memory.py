"""What a task holds while it orders suffixes follows their number, not that of all their first symbols."""

import tracemalloc

import numpy as np
import pytest

from parley.llm import suffixes


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def same_beginnings(n, seed):
    """A text whose S* suffixes all begin with the same two symbols."""
    text = np.random.default_rng(seed).integers(3, 240, n).astype(np.uint8)
    text[0::8], text[1::8] = 1, 2
    text[2::8] = 3
    return text


def test_suffixes_of_one_beginning():
    text = same_beginnings(8 * 150_000, 1)
    pos, found = np.arange(0, len(text), 8), []
    with suffixes.Disk() as disk:
        # 150,000 suffixes of 100 symbols; as numbers of 64 bits these alone were 120 MB, several times over.
        assert peak_mb(lambda: found.append(suffixes.sorted_stars(text, pos, 100, suffixes.BUDGET, disk)[0])) < 60
        out = found[0].tolist()
    raw = text.tobytes()
    some = [raw[p : p + 100] for p in out[:5000]]
    assert some == sorted(some) and sorted(out) == pos.tolist()


def test_names_of_many_substrings():
    text = same_beginnings(8 * 60_000, 2)
    with suffixes.Disk() as disk:
        stars = np.array(suffixes.stars_of(suffixes.types_of(text, disk), disk))
        budget = len(stars) - 1
        assert peak_mb(lambda: suffixes._names(text, stars, 100, budget, disk)) < 60
        names, count = suffixes._names(text, stars, 100, budget, disk)
        ends = np.append(stars[1:] + 1, len(text))
        known = {}
        for name, a, b in zip(names.tolist()[:-1], stars.tolist(), ends.tolist(), strict=False):
            assert known.setdefault(name, text[a:b].tobytes()) == text[a:b].tobytes()
        assert len(known) == len(set(known.values())) <= count


@pytest.mark.parametrize("batch", [1, 7, 1 << 16])
def test_direct_sort_of_any_symbols(batch):
    """Bytes 0 and 255, suffixes that the end cuts off, and equal beginnings beyond the batch."""
    rng = np.random.default_rng(batch)
    for symbols in ([0, 255], [0, 1], list(range(256)), [7]):
        text = np.append(rng.choice(symbols, 300), symbols[0] * np.ones(20)).astype(np.uint8)
        pos, out = np.arange(len(text)), np.zeros(len(text), np.int64)
        suffixes._sort_directly(text, pos, 30, out, batch)
        raw = text.tobytes()
        found = [raw[p : p + 30] for p in out.tolist()]
        assert found == sorted(found) and sorted(out.tolist()) == pos.tolist()
