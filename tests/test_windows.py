"""Windows of sessions with tools against a plain writing of the cut, and their bridges by hand."""

from __future__ import annotations

import random

import pytest

from parley.operators import windows

MESSAGE = "session_id bigint, turn bigint, role string, text string, calls array<struct<name:string,arguments:string>>"
CONTEXT = "session_id bigint, block string"


def count(messages):
    tokens = lambda t: max(1, len(t) // 4) if t else 0
    return sum(tokens(m[3]) + tokens(m[2]) + 4 for m in messages) + 2


def plain(messages, budget, protect, ceiling, floor):
    """Where a session is cut, step by step; 0 for not at all."""
    system, conv = [m for m in messages if m[2] == "system"], [m for m in messages if m[2] != "system"]
    starts = [i for i, m in enumerate(conv) if m[2] == "user" or (m[2] == "assistant" and m[4])]
    if count(messages) <= budget or len(conv) <= protect or not starts:
        return 0
    split = next((i for i in starts if i >= len(conv) - protect), starts[-1])
    if ceiling and any(m[2] == "tool" for m in conv):
        while split < starts[-1] and count(conv[split:]) > ceiling // 2:
            split = next(i for i in starts if i > split)
    while split > 0 and count(system) + count(conv[split:]) < floor and any(i < split for i in starts):
        split = max(i for i in starts if i < split)
    return split


@pytest.mark.parametrize(("ceiling", "floor"), [(0, 0), (120, 0), (0, 90), (120, 90), (40, 400)])
def test_cuts_equal_a_loop(spark, ceiling, floor):
    rng, rows = random.Random(ceiling + floor), []
    for session in range(150):
        for turn in range(rng.randint(0, 14)):
            role = rng.choice(["system"] if turn == 0 and rng.random() < 0.5 else ["user", "assistant", "assistant", "tool", "tool"])
            rows.append((session, turn, role, "x" * rng.choice([0, 3, 40, 130]), [("read", "a")] if role == "assistant" and rng.random() < 0.4 else rng.choice([None, []])))
    got = {r.session_id: r.split for r in windows.cuts(spark.createDataFrame(rows, MESSAGE), 100, 4, ceiling, floor).collect()}
    want = {s: plain([r for r in rows if r[0] == s], 100, 4, ceiling, floor) for s in {r[0] for r in rows}}
    assert got == {s: split for s, split in want.items() if split} and got


def test_paths(spark):
    text = "see src/app/main.py, (./lib/x.ts) 3/4 https://a.b/c -x/y setup.cfg node.js. v1.2 e.g. a/b " + "z" * 400 + "/q"
    assert spark.range(1).select(windows.paths(windows.F.lit(text)).alias("p")).first().p == ["src/app/main.py", "lib/x.ts", "setup.cfg", "node.js"]


def session(*rows):
    return [(1, turn, role, text, calls) for turn, (role, text, calls) in enumerate(rows)]


def test_bridge_paths_and_lead(spark):
    rows = session(
        ("system", "Be brief", None), ("user", "Look at docs/never.md " + "x" * 400, None), ("assistant", "", [("list", "src/old/a.py")]), ("tool", "src/new/b.py src/new/c.py src/old/a.py", None),
        ("assistant", "Reading", [("read", "src/new/b.py")]), ("tool", None, None),
    )
    contexts = spark.createDataFrame([(1, "Goal: ship"), (2, "Goal: other")], CONTEXT)
    got = windows.applied(spark.createDataFrame(rows, MESSAGE), contexts, 50, 2, index_budget=100).orderBy("place").collect()
    assert [r.role for r in got] == ["system", "system", "user", "assistant", "tool"]
    bridge = got[1].text
    assert "Goal: ship" in bridge and "Goal: other" not in bridge and "[3 earlier messages omitted]" in bridge
    assert "src/old/: a.py\nsrc/new/: b.py c.py" in bridge and "never.md" not in bridge
    assert (got[0].text, got[2].text, got[3].text, got[4].text) == ("Be brief", windows.LEAD, "Reading", "")
    # A small budget keeps the directory that was seen last.
    small = windows.applied(spark.createDataFrame(rows, MESSAGE), contexts, 50, 2, index_budget=len(windows.HEAD) // 4 + 6).filter("place = 1").first().text
    assert "src/new/: b.py c.py" in small and "src/old/" not in small


def test_sessions_that_stay_whole(spark):
    rows = [(1, 0, "user", "short", None), (2, 0, "tool", "y" * 900, None), (2, 1, "assistant", "y" * 900, None), (2, 2, "system", "s", None), (3, 0, "user", "z" * 900, None), (3, 1, "user", "z" * 900, None)]
    got = windows.applied(spark.createDataFrame(rows, MESSAGE), spark.createDataFrame([], CONTEXT), 50, 2).orderBy("session_id", "place").collect()
    assert [(r.session_id, r.place, r.role, r.text) for r in got] == [(1, 0, "user", "short"), (2, 0, "tool", "y" * 900), (2, 1, "assistant", "y" * 900), (2, 2, "system", "s"), (3, 0, "user", "z" * 900), (3, 1, "user", "z" * 900)]
    assert windows.applied(spark.createDataFrame([], MESSAGE), spark.createDataFrame([], CONTEXT), 50, 2).count() == 0


def test_deletion_counts_every_store(spark):
    from parley.operators import stores

    kept = {"nodes": spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "session_id bigint, x string"), "archive": spark.createDataFrame([(1, 5)], "session_id bigint, y int")}
    doomed = spark.createDataFrame([(1,), (1,), (3,), (None,)], "session_id bigint")
    got = {(r.session_id, r.store): r.removed for r in stores.deletion_counts(kept, doomed).collect()}
    assert got == {(1, "nodes"): 2, (1, "archive"): 1, (3, "nodes"): 0, (3, "archive"): 0}
    left = stores.without_sessions(kept, doomed)
    assert sorted(r.x for r in left["nodes"].collect()) == ["c", "d"] and left["archive"].count() == 0
