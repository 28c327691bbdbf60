"""The context block against a plain writing of its packing, and its sections by hand."""

from __future__ import annotations

import random

import pytest

from parley.operators import blocks

NODE = "session_id bigint, node_id bigint, type string, label string, status string, importance double, valid_from bigint, summary string, evicted boolean"
EDGE = "session_id bigint, source_id bigint, target_id bigint, type string"
CHANGE = "session_id bigint, from_label string, to_label string, to_id bigint, ts_us bigint, confidence_delta double"
SECTIONS = list(blocks.SECTIONS.values())


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def plain(items: list[tuple[int, int, str]], budget: int) -> str:
    """The packing as a loop over ``(section, place, item)``."""
    chosen: dict[int, list[str]] = {}
    used = 0
    for _, _, section, item in sorted((place, SECTIONS[s][2], s, item) for s, place, item in items):
        name, apart, *_ = SECTIONS[section]
        cost = tokens(apart + item) if section in chosen else tokens(f"{name}: {item}") + 1
        if used + cost <= budget:
            chosen.setdefault(section, []).append(item)
            used += cost

    def text() -> str:
        return "\n".join(f"{SECTIONS[s][0]}: " + SECTIONS[s][1].join(chosen[s]) for s in sorted(chosen) if chosen[s])

    while tokens(text()) > budget:
        worst = max((s for s in sorted(chosen) if chosen[s]), key=lambda s: (SECTIONS[s][2], len(chosen[s])))
        chosen[worst].pop()
    return text()


@pytest.mark.parametrize("budget", [0, 7, 25, 60, 400])
def test_packing_equals_a_loop(spark, budget):
    rng, rows = random.Random(budget), []
    for session in range(40):
        for section, (*_, cap) in enumerate(SECTIONS):
            rows += [(session, section, place, "x" * rng.choice([1, 2, 3, 6, 7, 11, 40])) for place in range(rng.randint(0, cap))]
    got = {r.session_id: r for r in blocks.pack(spark.createDataFrame(rows, "session_id bigint, section int, place int, item string"), budget).collect()}
    for session in {r[0] for r in rows}:
        want = plain([r[1:] for r in rows if r[0] == session], budget)
        assert got[session].block == want
        assert got[session].tokens == tokens(want) <= budget


def test_recount_takes_the_least_urgent_item_back(spark):
    # One by one these cost 1 + 1 + ... tokens, but together their remainders add up to more.
    rows = [(1, 9, place, "abcde") for place in range(10)] + [(1, 0, 0, "ab")]
    got = blocks.pack(spark.createDataFrame(rows, "session_id bigint, section int, place int, item string"), 14).first()
    assert got.block == plain([r[1:] for r in rows], 14)
    assert got.block.startswith("Goal: ab\nFiles: abcde")


def nodes(spark, *rows):
    full = [(1, k, kind, label, status, weight, time, summary, False) for k, (kind, label, status, weight, time, summary) in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def shown(spark, n, edges=(), changes=(), now=0):
    got = blocks.items(n, spark.createDataFrame(list(edges), EDGE), spark.createDataFrame(list(changes), CHANGE), now).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.section, r.place)):
        out.setdefault(SECTIONS[r.section][0], []).append(r.item)
    return out


def test_work_takes_turns(spark):
    rows = [("task", f"now {k}", "in_progress", 0.6, k, None) for k in range(6)] + [("task", f"then {k}", "pending", 0.6, k, None) for k in range(2)]
    assert shown(spark, nodes(spark, *rows))["Working on"] == ["now 5", "then 1", "now 4", "then 0", "now 3", "now 2"]


def test_finished_work_that_begins_alike_counts_once(spark):
    rows = [("task", "Add the login handler for staff", "completed", 0.6, 1, None), ("task", "add the login handler for guests", "completed", 0.6, 2, None), ("task", "Write docs", "completed", 0.9, 0, None)]
    assert shown(spark, nodes(spark, *rows))["Done"] == ["add the login handler for guests", "Write docs"]


def test_decisions_with_reasons_conflicts_and_changes(spark):
    rows = [
        ("decision", "Use postgres", "completed", 0.9, 1, "it has the extensions we need"), ("decision", "Use redis", "completed", 0.8, 1, "use redis today"),
        ("decision", "Use kafka", "contested", 0.9, 1, None), ("decision", "Use sqs", "contested", 0.9, 1, None), ("decision", "Use mysql", "invalidated", 0.9, 1, None), ("decision", "Use vue", "superseded", 0.9, 1, None),
    ]
    n = nodes(spark, *rows)
    got = shown(spark, n, [(1, 3, 2, "CONFLICTS_WITH"), (1, 2, 3, "CONFLICTS_WITH"), (1, 0, 1, "CONFLICTS_WITH")])
    assert got["Decided"] == ["Use postgres (it has the extensions we need)", "Use redis"]
    assert got["Conflicting (unresolved)"] == ["'Use kafka' vs 'Use sqs'"]
    assert got["Avoid"] == ["[DO NOT USE] Use mysql"]
    assert got["Note"] == ["1 decision(s) changed recently"]
    assert "Note" not in shown(spark, n, now=4 * blocks.DAY_US)
    told = shown(spark, n, changes=[(1, "Use vue", "Use react", 9, 5, 0.1), (1, "a", "b", 8, 4, 0.0)])
    assert told["Changes"] == ["Use vue -> Use react (confidence +10%)", "a -> b"] and "Note" not in told


def test_nulls_empty_tables_and_cold_nodes(spark):
    rows = [(1, 1, "goal", None, "pending", None, None, None, False), (1, 2, "goal", "Ship", "pending", None, None, None, None), (1, 3, "goal", "Cold", "pending", 1.0, 1, None, True), (1, 4, None, "x", None, None, None, None, False)]
    assert shown(spark, spark.createDataFrame(rows, NODE)) == {"Goal": ["Ship"]}
    assert shown(spark, spark.createDataFrame([], NODE)) == {}
    assert blocks.pack(spark.createDataFrame([], "session_id bigint, section int, place int, item string"), 10).count() == 0


def test_headings_of_a_domain(spark):
    items = spark.createDataFrame([(1, 0, 0, "Why is it slow"), (1, 9, 0, "a.csv")], "session_id bigint, section int, place int, item string")
    assert blocks.pack(items, 50, "research").first().block == "Question: Why is it slow\nSources: a.csv"
    assert blocks.pack(items, 50, "ops").first().block == "Incident: Why is it slow\nFiles: a.csv"
