"""Tool calls, broken replies, alignments and sets by their rarest words, against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import infer, requests, sets, tools

CALL = lambda name, args: {"function": {"name": name, "arguments": args}}
MESSAGES = [
    ({"role": "assistant", "tool_calls": [CALL("edit_file", '{"path": "src/a.py"}'), CALL("read_file", '{"path": "no.py"}'), CALL("write", "{broken"), 7, CALL("patch", {"files": [{"filename": "x/y.go"}, {"filename": 3}]})]}, {("file", "src/a.py"), ("file", "x/y.go")}),
    ({"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Write", "input": {"file_path": "b.ts", "edits": [{"path": "c.ts"}]}}, "loose", {"type": "tool_use", "name": "NotebookRead", "input": {"path": "no"}}]}, {("file", "b.ts"), ("file", "c.ts")}),
    ({"role": "user", "content": [{"type": "tool_result", "is_error": True, "content": [{"type": "text", "text": "ran\nTypeError: bad"}]}, {"type": "tool_result", "is_error": True, "content": "exit 1"}, {"type": "tool_result", "is_error": "what", "content": "fine"}]}, {("error", "TypeError: bad"), ("error", "exit 1")}),
    ({"role": "tool", "content": "ERROR failed\nmore"}, {("error", "ERROR failed")}),
    ({"role": "tool", "content": "all right\nERROR later"}, set()),
    ({"role": "model", "content": [{"functionCall": {"name": "apply", "args": {"path": "d.rs"}}}, {"functionCall": 5}]}, {("file", "d.rs")}),
    ({"role": 5, "tool_calls": 7, "content": {"type": "tool_use"}}, set()),
    ("{broken", set()),
    (None, set()),
]


def test_signals_of_four_shapes(spark):
    rows = [(k, m if m is None or isinstance(m, str) else json.dumps(m)) for k, (m, _) in enumerate(MESSAGES)]
    found: dict[int, set] = {}
    for r in tools.signals(spark.createDataFrame(rows, "i int, raw string"), ["i"]).collect():
        found.setdefault(r.i, set()).add((r.kind, r.label))
    assert [found.get(k, set()) for k in range(len(MESSAGES))] == [e for _, e in MESSAGES]


def test_every_prefix_gives_its_whole_objects(spark):
    items = [{"a": 1}, {"b": 'x "} {" \\ y', "c": {"d": [1, {"e": "]"}]}}, {"f": "\\"}, {}]
    text = "Here it is: " + json.dumps(items)
    ends = []
    for k in range(1, len(items) + 1):
        ends.append(len("Here it is: ") + len(json.dumps(items[:k])) - 1)
    rows = [(n, text[:n]) for n in range(len(text) + 1)]
    for r in spark.createDataFrame(rows, "n int, t string").select("n", tools.whole_objects(F.col("t")).alias("o")).collect():
        assert [json.loads(o) for o in r.o] == items[: sum(e <= r.n for e in ends)], r


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignments(spark):
    draw = random.Random(5)
    pairs = [([draw.choice("abcde") for _ in range(draw.randint(0, 8))], [draw.choice("abcde") for _ in range(draw.randint(0, 8))]) for _ in range(300)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<string>, b array<string>")
    for r in frame.select("k", sets.aligned(F.col("a"), F.col("b")).alias("p"), sets.swapped_inside(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = pairs[r.k]
        assert len(r.p) == plain_lcs(a, b) and all(a[i] == b[j] for i, j in r.p)
        assert all(p.i < q.i and p.j < q.j for p, q in zip(r.p, r.p[1:], strict=False))
        assert r.s == any(q.i - p.i > 1 and q.j - p.j > 1 for p, q in zip(r.p, r.p[1:], strict=False))


def facts(seed, n=60):
    draw = random.Random(seed)
    words = "fix add token index cache for orders users api today again".split()
    return [(draw.randint(1, 3), k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 7)))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_tasks_by_brute_force(spark, seed):
    rows = facts(seed)
    from collections import Counter

    expected = {(s, a, b) for s, a, x in rows for t, b, y in rows if s == t and a != b and len(x.split()) < len(y.split()) and not Counter(x.split()) - Counter(y.split())}
    found = infer.contained_tasks(spark.createDataFrame(rows, "session_id int, node_id int, label string"))
    assert {tuple(r) for r in found.collect()} == expected


def test_subsumed_facts(spark):
    rows = [(1, 1, "retry failed payments"), (1, 2, "retry failed payments twice daily"), (1, 3, "migrate users table nightly"), (1, 4, "migrate orders table nightly with care"), (1, 5, "totally unlike"), (2, 6, "retry failed payments")]
    found = requests.subsumed(spark.createDataFrame(rows, "session_id int, node_id int, label string"))
    assert [tuple(r) for r in found.collect()] == [(1, 1, 2)]


def test_a_word_of_all_pairs_nothing(spark):
    """In a session of facts that share one word, sets are looked up by their own words."""
    rows = [(1, k, f"timeouterror alpha{k} beta{k} gamma{k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "session_id int, node_id int, label string").select("session_id", "node_id", F.split("label", " ").alias("words"))
    assert sets.meeting(frame, ["session_id"], lambda n: n - 3 + 1).count() == 0
