"""Operators that SQL does not express, on small hand-worked cases."""

from __future__ import annotations

from parley.operators import cache, extract, graph, messages
from parley.sources.tables import DAY_US


def test_two_triangles_and_a_bridge_are_two_communities(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    edges = spark.createDataFrame([(7, a, b, 0.1 if (a, b) == (3, 4) else 1.0) for a, b in pairs], "session_id bigint, source_id bigint, target_id bigint, weight double")
    found = {r.node_id: r.community for r in graph.communities(edges).collect()}
    assert {found[k] for k in (1, 2, 3)} == {0}
    assert {found[k] for k in (4, 5, 6)} == {1}


def test_chains_end_in_cycles(spark):
    moves = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "from_id bigint, to_id bigint")
    assert {(r.node_id, r.chain) for r in graph.chain_ids(moves).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_packing_skips_what_does_not_fit(spark):
    lines = spark.createDataFrame([(1, "goal", 1, "g" * 40), (1, "decision", 1, "d" * 80), (1, "task", 1, "t" * 20)], "session_id bigint, type string, place bigint, line string")
    out = graph.pack_sections(lines, 16).collect()[0]
    assert (out.n_lines, out.tokens, out.block) == (2, 15, "g" * 40 + "\n" + "t" * 20)


def test_cache_replay_expires_and_evicts(spark):
    log = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 2, "a"), (1, 2, 3, "b"), (1, 3, 4, "c"), (1, 4, 5, "a"), (1, 50, 6, "a")], "session_id bigint, ts_us bigint, request_id bigint, prompt string")
    hit = {r.request_id: r.hit for r in cache.replay(log, 10, 2).collect()}
    assert hit == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_facts_keep_negation_and_questions_out(spark):
    rows = [
        (1, 0, "user", "My goal is to ship the billing page. We decided to use Postgres 15 for storage."),
        (1, 1, "assistant", "I added the retry handler in src/api/retry.py. GET /v1/users raised a ValueError. Should we use Redis?"),
        (1, 2, "user", "I have not fixed the login page. Need to add rate limits. pip install httpx==0.27"),
        (1, 3, "assistant", "I added rate limits."),
    ]
    m = spark.createDataFrame(rows, "session_id bigint, turn bigint, role string, text string")
    found = {(r.kind, r.label) for r in extract.session_facts(m).collect()}
    assert ("file", "src/api/retry.py") in found
    assert ("endpoint", "GET /v1/users") in found
    assert ("error", "ValueError") in found
    assert ("dependency", "httpx==0.27") in found
    assert ("goal", "ship the billing page") in found
    assert ("task_done", "rate limits") in found
    assert not any(kind == "task_done" and "login" in label for kind, label in found)
    assert not any(kind == "task_todo" for kind, _ in found)
    assert not any(kind == "decision" and "Redis" in label for kind, label in found)


def test_merge_tiers_and_evaluation(spark):
    kind = "session_id bigint, kind string, label string"
    a = spark.createDataFrame([(1, "file", "a.py"), (1, "task", "fix login page")], kind)
    b = spark.createDataFrame([(1, "file", "A.py"), (1, "task", "write docs")], kind)
    merged = {(r.label, r.confidence) for r in extract.merge_tiers(a, b).collect()}
    assert merged == {("A.py", 0.95), ("fix login page", 0.65), ("write docs", 0.80)}
    score = {r.kind: (r.precision, r.recall, r.f1) for r in extract.evaluate(a, b).collect()}
    assert score["file"] == (1.0, 1.0, 1.0)
    assert score["task"] == (0.0, 0.0, 0.0)


def test_shadowed_paths(spark):
    found = spark.createDataFrame([(1, "file", "a.py"), (1, "file", "src/a.py"), (1, "file", "b.py"), (2, "file", "a.py")], "session_id bigint, kind string, label string")
    assert {tuple(r) for r in extract.drop_shadowed_paths(found).collect()} == {(1, "file", "src/a.py"), (1, "file", "b.py"), (2, "file", "a.py")}


def test_repeated_lines_collapse(spark):
    long_line = "x" * 30
    df = spark.createDataFrame([(1, "\n".join([long_line] * 4 + ["a", "a", "a"])), (2, None), (3, "")], "doc_id bigint, text string")
    out = {r.doc_id: r.collapsed for r in messages.collapse_repeated_lines(df, "doc_id", "text", 3, 20).collect()}
    assert out == {1: f"{long_line}\n[previous line repeated 3 more times]\na\na\na", 2: "", 3: ""}


def test_decay_respects_grace(spark):
    kind = "node_id bigint, type string, status string, importance double, valid_from bigint"
    nodes = spark.createDataFrame([(1, "task", "completed", 0.8, 0), (2, "task", "completed", 0.8, 9 * DAY_US), (3, "goal", "completed", 0.8, 0)], kind)
    assert {r.node_id: r.decayed for r in graph.decay(nodes, 10 * DAY_US).collect()} == {1: 0.4}


def test_empty_tables(spark):
    m = spark.createDataFrame([], "session_id bigint, turn bigint, role string, text string")
    for f in (messages.last_query, messages.guard_requests, messages.repeated_replies, messages.archive_rows, lambda x: messages.split_point(x, 100), extract.session_facts):
        assert f(m).collect() == []
