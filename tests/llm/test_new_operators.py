"""The manifest, fill-in-the-middle and exact search against plain versions, and the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import fim, merkle, topk


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest


def plain_tree(leaves):
    """Levels of a tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, index):
    for level in levels[:-1]:
        low = index - index % 3
        yield level[low:index], level[index + 1 : low + 3]
        index //= 3


def plain_manifest(rows):
    """``rows``: (group, id, leaf); gives (id, leaf, subroot, root, path) sorted."""
    groups = {}
    for g, i, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((i, leaf))
    trees = [plain_tree([leaf for _, leaf in own]) for own in groups.values()]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for t, (tree, own) in enumerate(zip(trees, groups.values(), strict=True)):
        for k, (i, leaf) in enumerate(own):
            out.append((i, leaf, tree[-1][0], top[-1][0], [*plain_path(tree, k), *plain_path(top, t)]))
    return out


def leaves_of(spark, rows, parts=3):
    frame = spark.createDataFrame([(g, i, leaf) for g, i, leaf in rows], "grp string, id bigint, leaf string").repartition(parts)
    return frame.withColumn("leaf", F.unhex("leaf"))


SHAPES = {
    "one": [("a", 1)],
    "a source with most rows": [("hot", k) for k in range(700)] + [(f"s{k}", k) for k in range(40)],
    "many small sources": [(f"s{k % 301}", k) for k in range(800)],
    "sources of one row": [(f"s{k}", k) for k in range(500)],
    "one source": [("x", k) for k in range(821)],
    "nulls": [(None, 3), (None, None), ("", 1), ("é", 2), ("z", 4), ("z", None)],
    "repeated rows": [("a", 5)] * 400 + [("b", k % 7) for k in range(90)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_manifest(spark, shape, monkeypatch):
    monkeypatch.setattr(merkle, "PER_PART", 23)
    rows = [(g, i, sha(str(i), str(g))) for g, i in SHAPES[shape]]
    expected = plain_manifest(rows)
    made = merkle.Manifest(leaves_of(spark, rows))
    found = [(r.id, r.leaf, r.subroot, r.root, [(list(p.before), list(p.after)) for p in r.proof]) for r in made.proofs().collect()]
    key = repr
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert made.root == expected[0][3] and made.n_leaves == len(rows)
    audit = made.audited().collect()
    assert all(r.verified and r.folded_root == made.root for r in audit)
    assert sorted((r.id or -1, r.proof_sha256) for r in audit) == sorted((i or -1, sha(*(s for a, b in path for s in a + b))) for i, _, _, _, path in expected)


def test_forests_merge_in_any_order():
    leaves = [sha(str(k)) for k in range(50)]
    sizes = {0: 50, merkle.TOP: 1}
    single = [merkle.Forest({(0, 0, k): bytes.fromhex(leaf)}) for k, leaf in enumerate(leaves)]
    root = plain_tree(leaves)[-1][0]
    for seed in range(20):
        draw, forests = random.Random(seed), list(single)
        while len(forests) > 1:
            a, b = forests.pop(draw.randrange(len(forests))), forests.pop(draw.randrange(len(forests)))
            forests.append(a.merged(b, sizes))
        assert {k: d.hex() for k, d in forests[0].nodes.items()} == {(merkle.TOP, 0, 0): root}
        # Each node below the root was replaced once.
        assert len(forests[0].seams) == 49 * sum(len(level) for level in plain_tree(leaves)[:-1])


def test_tampering_is_found(spark):
    rows = [(f"s{k % 3}", k, sha(str(k))) for k in range(60)]
    leaves = leaves_of(spark, rows).withColumn("claimed", F.when(F.col("id") % 7 == 0, F.unhex(F.lit(sha("other")))))
    for r in merkle.Manifest(leaves).audited().collect():
        assert r.verified == (r.id % 7 != 0) == (r.folded_root == r.root)


def test_leaf_and_empty_table(spark):
    frame = spark.createDataFrame([(1, None, "é\n", 2)], "doc_id bigint, source string, text string, n int")
    assert frame.select(F.hex(merkle.leaf(*map(F.col, frame.columns)))).collect()[0][0].lower() == sha("1:1", "-", "3:é\n", "1:2")
    empty = merkle.Manifest(leaves_of(spark, []))
    assert empty.root is None and empty.audited().collect() == [] == empty.proofs().collect()


# --- fill-in-the-middle

TEXTS = [None, "", " ", "word", " lead", "trail \t\n", "a  b c\x1cd é\U0001f600 e", "x" * 300, "\n" * 5000, "has <P> in it", "ends <", "<S", "a <S b P> c <M d", ">M> <<P", "one two three four five"] + ["w%d x\n\n y" % k * (k % 9 + 1) for k in range(120)]


def plain_fim(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "no id here"), (5, TEXTS[5]), (10**15, "é " * 200_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(-1)).withColumn("form", F.lit("clash")).withColumn("output", F.lit(None).cast("string"))
    made = fim.transform(frame).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = repr
    assert sorted([tuple(r)[:-1] for r in made], key=key) == sorted([(i, *plain_fim(i, t)) for i, t in rows], key=key)
    assert sorted([(r.doc_id, r.back) for r in made], key=key) == sorted([(i, t or "") for i, t in rows], key=key)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    for r in fim.digests(frame).collect():
        if r.doc_id is not None:
            assert r.restored_sha256 == sha(dict(rows)[r.doc_id] or "") and r.output_sha256 == sha(plain_fim(r.doc_id, dict(rows)[r.doc_id])[4])
    assert fim.digests(frame.limit(0)).collect() == []


def test_marks_at_seams_are_read_back():
    pieces = ["", "<", "<P", "<S", "<M", "P>", "S>", ">", "M> <", "a"]
    for p in pieces:
        for m in pieces:
            for s in pieces:
                assert fim.rebuilt(f"<P>{p}<S>{s}<M>{m}", "psm") == fim.rebuilt(f"<S>{s}<P>{p}<M>{m}", "spm") == p + m + s


def test_unit_ends_are_compact():
    ends = fim.unit_ends("a b  c ")
    assert isinstance(ends, array) and ends.itemsize == 4 and ends.tolist() == [1, 3, 6, 7]


# --- exact search


def plain_search(rows, k=10, every=100, scale=1024):
    """``rows``: (id, vector); ids of queries are unique here."""
    whole = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for q, x in whole:
        if q is not None and q % every == 0:
            scored = sorted((-clip(sum(a * b for a, b in zip(x, y, strict=False))), i is None, i or 0) for i, y in whole if i != q)[:k]
            out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored)]
    return sorted(out, key=repr)


def run_search(spark, rows, kind="float", **how):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("rank", F.lit(7)).withColumn("score", F.lit("clash"))
    return sorted(map(tuple, topk.search(frame.repartition(5), **how).collect()), key=repr)


def vectors_of(n, dim, seed=1, spread=0.2, centres=9):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dim))
    return (middle[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("shard,leaf,per_task,group", [(64, 8, 2, 5), (1 << 14, 128, 4, 4096), (16, 4, 1, 2)])
def test_search(spark, monkeypatch, shard, leaf, per_task, group):
    for name, value in (("SHARD", shard), ("PER_TASK", per_task), ("GROUP", group)):
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(topk.Tree.__init__, "__defaults__", (leaf,))
    rows = [(k * 10, v.tolist()) for k, v in enumerate(vectors_of(400, 6))]
    assert run_search(spark, rows) == plain_search(rows)
    assert run_search(spark, rows, k=3, every=70) == plain_search(rows, 3, 70)


def test_search_ties_and_copies(spark):
    rows = [(k, [1.0, 0.5, -0.25]) for k in range(350)] + [(1000 + k, [0.0, 0.0, 0.0]) for k in range(30)] + [(7, [1.0, 0.5, -0.25])] * 2 + [(None, [1.0, 0.5, -0.25])] * 2
    assert run_search(spark, rows) == plain_search(rows)


def test_search_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.1, 0.2]), (100, [1.0, None]), (200, None), (300, [nan, 1.0]), (400, [1.0, inf]), (500, []), (600, [0.5]), (700, [-0.5, 0.25, 3.0]), (1, [0.0, 0.0]), (2, [2.0, -1.0, 1.0, 9.0]), (None, [3.0, 3.0])]
    assert run_search(spark, rows) == plain_search(rows)
    assert run_search(spark, rows[:1]) == [] == run_search(spark, [])


def test_search_beyond_doubles(spark):
    rows = [(100 * k, [3e15 + 7 * k, -1e9 - k, float(k)]) for k in range(12)] + [(5, [1e30, 1.0, 1.0]), (6, [-1e30, 1.0, 1.0])]
    assert run_search(spark, rows, "double") == plain_search(rows)


def test_query_rows_that_share_an_id(spark):
    rows = [(100, [2.0, 1.0]), (100, [2.0, 1.0]), (100, [1.0, 5.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    found = run_search(spark, rows)
    assert found in (plain_search(rows[:1] + rows[3:]), plain_search(rows[2:])) and len(found) == 2


def test_boxes_bound_every_score():
    x = np.floor(vectors_of(900, 8) * 1024).astype(np.float64)
    tree, q = topk.Tree(x, np.arange(900), 16), x[:20]
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(tree.parts):
        assert (bounds[:, node] >= (tree.x[a:b] @ q.T).max(axis=0)).all()
        assert (tree.low[node] == tree.x[a:b].min(axis=0)).all() and (tree.high[node] == tree.x[a:b].max(axis=0)).all()
        if (child := tree.children[node]) is not None:
            assert tree.parts[child][0] == a and tree.parts[child][1] == tree.parts[child + 1][0] and tree.parts[child + 1][1] == b
    assert sorted(tree.ids.tolist()) == list(range(900))
