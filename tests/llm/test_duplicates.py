"""The near-duplicate join, the vector join and the substring deduplication against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import jaccard as brute_jaccard
from brute import repeats as brute_repeats
from brute import vectors as brute_vectors
from pyspark.sql import functions as F

from parley.llm import components, jaccard, repeats, suffixes, vectors


def clash(df):
    """Columns named like those that the operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("doc", "n", "h", "block", "rows", "s", "key", "cell", "part", "rep", "text2", "along", "digest")})


def near_copies(seed=5):
    rng, docs = random.Random(seed), []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 30)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(["X", "y", "zz"])
            docs.append((len(docs) * 3 % 1009, " ".join(words)))
    return docs + [(90001, None), (90002, ""), (90003, " \n"), (90004, "a b"), (90005, "A  b"), (90006, "a b c d e")]


def test_jaccard(spark):
    docs = near_copies()
    df = clash(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()} == brute_jaccard(docs)


def test_jaccard_repeated_and_no_rows(spark):
    docs = [(3, "one two three four five six"), (3, "one two three four five six"), (8, "one two three four five six")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in jaccard.similar(df).collect()) == [(3, 2, 3), (3, 2, 3), (8, 2, 3)]
    assert jaccard.similar(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_t_occurrences(seed):
    rng = random.Random(seed)
    for _ in range(60):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 25))) for _ in range(rng.randint(1, 30))]
        least = rng.randint(1, 12)
        count = {d: sum(d in own for own in lists) for d in range(40)}
        assert dict(jaccard.t_occurrences(lists, least)) == {d: c for d, c in count.items() if c >= least}


@pytest.mark.parametrize("seed", range(3))
def test_cells_find_every_component(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
    owned = []
    for _ in range(40):
        own = base.copy()
        own[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(20_000, 40_000)
        owned.append(np.unique(own))
    links = [(i, j) for i in range(40) for j in range(i) if jaccard.links(len(np.intersect1d(owned[i], owned[j])), len(owned[i]), len(owned[j]))]
    label = lambda found: dict(zip(*(x.tolist() for x in components.forest(*np.array(found or [(0, 0)]).T.astype(np.int64))), strict=True))
    assert label(jaccard.cell_links(owned)) == label(links)


@pytest.mark.parametrize("budget", [5, 10**6])
def test_induced_sorting(budget):
    rng = np.random.default_rng(1)
    for _ in range(250):
        depth, letters = int(rng.choice([1, 2, 3, 5, 8, 20])), int(rng.choice([1, 2, 3, 5, 200]))
        text = rng.integers(0, letters, rng.integers(1, 150)).astype(np.uint8)
        text = np.concatenate([text, text[:20], np.repeat(text[:1], 25), text[:20]])
        group = suffixes.equal_prefixes(text, depth, budget)
        by_key, by_group = {}, {}
        for i in range(len(text) - depth):
            key = text[i : i + depth].tobytes()
            assert by_key.setdefault(key, group[i]) == group[i]
            assert by_group.setdefault(group[i], key) == key


def repeated_texts(seed=5):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(90, 400))) for _ in range(12)]
    part = lambda: rng.choice([rng.choice(shared), rng.choice(shared)[10:150], "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 120))), "ab " * 60])
    docs = [(g * 7 % 307, "".join(part() for _ in range(rng.randint(0, 5)))) for g in range(250)]
    return docs + [(9001, None), (9002, ""), (9003, docs[5][1]), (9004, "a" * 700), (9005, "a" * 300 + "b"), (9006, "b" + "a" * 99)]


def test_repeats(spark):
    docs = repeated_texts()
    df = clash(spark.createDataFrame(docs, "doc_id bigint, text string"))
    expected = brute_repeats(docs)
    assert {r.doc_id: tuple(r)[1:] for r in repeats.digests(df).collect()} == {i: v[:4] for i, v in expected.items()}
    kept = repeats.kept_texts(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()} == {i: v[4].decode("utf-8", "ignore") for i, v in expected.items()}


def shared_passage(n=600):
    """A passage in every document, between text of its own: its inner slices are equal, those at its edges all differ."""
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(400))
    own = lambda: "".join(rng.choice("qrstuvwxyz é") for _ in range(130))
    return [(k * 7 % 1009, own() + passage + own()) for k in range(n)]


@pytest.mark.parametrize("hot", [0, 5])
def test_repeats_of_hot_anchors(spark, hot):
    docs = repeated_texts(6) + [(20_000 + i, text) for i, text in shared_passage(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: tuple(r)[1:] for r in repeats.digests(df, hot=hot).collect()} == {i: v[:4] for i, v in brute_repeats(docs).items()}


def test_shared_passage_is_split(spark, monkeypatch):
    """What is dealt out is bounded by forms and blocks, and no shard gets a share of every document."""
    kept = {}
    real = repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, what: kept.setdefault(what, real(df, what)))
    docs = shared_passage()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: tuple(r)[1:] for r in repeats.digests(df, hot=100).collect()} == {i: v[:4] for i, v in brute_repeats(docs).items()}
    edges = {}
    for shard, packed in kept["repeated-slices"].filter("shard >= 0").select("shard", "slices").collect():
        edges[shard] = edges.get(shard, 0) + len(packed) // repeats.WINDOW.itemsize
    of_anchor = kept["repeated-slices"].filter(F.col("shard") == repeats.SLICES).groupBy("h").count().collect()
    assert max((r["count"] for r in of_anchor), default=0) <= 100
    assert len(edges) == 8 and max(edges.values()) < 2 * sum(edges.values()) / len(edges)
    kept.clear()
    repeats.digests(df, hot=10**6).collect()
    forms = kept["repeated-slices"].filter(F.col("shard") == repeats.SLICES).groupBy("h", "own").count().collect()
    assert max(r["count"] for r in forms) <= 8  # once a block, before: 600


def test_a_shard_may_exceed_its_budget(spark, tmp_path):
    """Text of many times what is held in memory: S* suffixes are named and sorted recursively, queues go to the disk."""
    docs = repeated_texts(8)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    assert sum(len((t or "").encode()) for _, t in docs) > 20 * 2000
    assert {r.doc_id: tuple(r)[1:] for r in repeats.digests(df, budget=2000).collect()} == {i: v[:4] for i, v in brute_repeats(docs).items()}


def test_recursion_names_substrings(monkeypatch):
    levels = []
    real = suffixes._names
    monkeypatch.setattr(suffixes, "_names", lambda *a: levels.append(len(a[1])) or real(*a))
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(0, 3, 3000), *[rng.integers(0, 2, 50)] * 40, np.zeros(300)]).astype(np.uint8)
    group = suffixes.equal_prefixes(text, 100, 60)
    assert len(levels) > 1 and levels == sorted(levels, reverse=True)
    known = {}
    for i in range(len(text) - 100):
        assert known.setdefault(text[i : i + 100].tobytes(), group[i]) == group[i]
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("rows", [1, 2, 7])
def test_forms_are_told_by_their_bytes(rows):
    """All hashes equal: the bytes tell forms apart, whatever the batches are."""
    rng = random.Random(rows)
    texts = sorted((rng.choice("ab"), bytes(rng.choice(b"xyz") for _ in range(rng.choice([100, 101])))) for _ in range(40))
    texts += [texts[k] for k in (3, 3, 9)]
    with suffixes.Disk() as disk:
        forms, spans = repeats.Forms(disk), []
        for lo in range(0, len(texts), rows):
            part = texts[lo : lo + rows]
            numbers = (np.array([ord(a) for a, _ in part]), np.zeros(len(part), np.int64), np.arange(lo, lo + len(part)), np.zeros(len(part), np.int64))
            spans.append(forms.add(*numbers, np.array([len(b) for _, b in part]), np.frombuffer(b"".join(b for _, b in part), np.uint8)))
        spans += list(repeats.repeated_strings(forms, disk, 50))
        found = {(int(s["doc"]), k) for part in spans for s in part for k in range(int(s["start"]), int(s["end"]) - 99)}
    seen, expected = set(), set()
    for i, (_, b) in enumerate(texts):
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                expected.add((i, k))
            seen.add(b[k : k + 100])
    assert found == expected


def test_repeats_repeated_and_no_rows(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in repeats.digests(df).collect()) == [(1, 0), (1, 0), (2, 300)]
    assert repeats.digests(df.limit(0)).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    rows = [(k, (centre[k % 12] + rng.normal(size=16) * rng.choice([0.1, 0.3, 0.6])).tolist()) for k in range(400)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [None] * 16), (506, [float("inf")] * 16), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (509, [])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"label": F.lit(1), "raw": F.lit(1), "rep": F.lit(1), "i": F.lit(1), "vector": F.lit(1)})
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()} == brute_vectors(rows)
    assert vectors.near_duplicates(df.limit(0)).collect() == []
    assert vectors.near_duplicates(df.filter("vec_id IN (502, 503)")).count() == 2


def test_repeats_null_ids(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared, alone = text(300), text(250)
    df = spark.createDataFrame([(4, shared), (None, alone), (None, alone[:120] + shared), (None, None), (None, "short"), (5, shared)], "doc_id bigint, text string")
    # Alone, or with what only other nulls have: by the text's hash one of both keeps the 120 bytes they share.
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.digests(df).collect())
    assert [x for x in found if x[1] not in (250, 420)] == [(0, 0, 0), (0, 5, 0), (4, 300, 0), (5, 300, 300)]
    assert [x for x in found if x[1] in (250, 420)] in ([(0, 250, 0), (0, 420, 420)], [(0, 250, 120), (0, 420, 300)])
    assert repeats.kept_texts(df).filter("doc_id IS NULL").count() == 4


def test_vectors_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, a), (3, a), (None, b), (None, b), (None, [0.0, 1.0, 0.1]), (9, c), (None, None), (None, [0.0, 0.5, 2.0]), (7, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()]
    near = [x for x in found if x[0] is None and x[2] is None and x[1]]
    assert sorted((n, kept) for _, n, _, kept in near) in ([(2, False), (2, True), (2, True)], [(2, False), (2, False), (2, True)])
    rest = [x for x in found if x not in near]
    assert sorted(rest, key=repr) == sorted([(None, 1, 3, False), (3, 1, 3, True), (9, 1, 9, True), (None, 0, None, True), (None, 1, 9, False), (7, 0, 7, True)], key=repr)
    unsound = vectors.near_duplicates(df.filter("embedding IS NULL")).collect()
    assert sorted(((r.vec_id, r.component_id, r.kept) for r in unsound), key=repr) == [(7, 7, True), (None, None, True)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    from brute import smallest_reachable

    expected = smallest_reachable({x for p in pairs for x in p if p[0] != p[1]}, [p for p in pairs if p[0] != p[1]])
    found = components.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7))
    assert {r.node: r.component for r in found.collect()} == expected


def test_long_lists_are_written_once():
    """Chunks of a list of unlike documents hold each posting once, and their pairs are all pairs across components."""
    n = 3000
    p = np.zeros(n, jaccard.POSTING)
    p["key"], p["doc"], p["part"], p["n"], p["ends"] = 9, np.arange(n), np.r_[np.full(500, -1), np.arange(n - 500)], 10, 1
    lists = jaccard.Lists.of(p)
    own, chunks = jaccard.apart(lists, 1000, 64)
    assert not len(own) and sum(len(c[3]) for c in chunks) == n * jaccard.POSTING.itemsize
    rows = [np.frombuffer(c[3], jaccard.POSTING) for c in chunks]
    found = 0
    for k, (_, number, meets, _) in enumerate(chunks):
        assert number == k
        for other in range(k, meets):
            found += sum(len(x) for x in jaccard.chunk_pairs(rows[k], None if other == k else rows[other]))
    assert found == n * (n - 1) // 2 - 500 * 499 // 2
