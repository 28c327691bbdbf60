"""Rules by hand: redaction, words, cold storage, decay, budgets, withdrawn decisions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.functions.secrets import redact_json, redact_secrets
from parley.operators import compress, decisions, digest, fold, graph, infer, requests, stores
from parley.operators import vocabulary as V
from parley.sources.tables import DAY_US

PEM = "-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (f"before {PEM} after", "before [REDACTED PRIVATE KEY] after"), ("use ghp_" + "a" * 36, "use [REDACTED]"), ("token = generate_token(user)", "token = generate_token(user)"),
        ("password=hunter2hunter2", "password=[REDACTED]"), ('{"api_key": "abcdefgh"}', '{"api_key": "[REDACTED]"}'), ("api_key = settings.openai_key2", "api_key = settings.openai_key2"),
        ("DB_PASSWORD='s3cretvalue'", "DB_PASSWORD=[REDACTED]"), ("postgres://ann:pw1@db/x", "postgres://[REDACTED]@db/x"), ("Authorization: Bearer " + "x" * 24, "Authorization: [REDACTED]"),
        ("the token of the day", "the token of the day"), (None, None), ("", ""),
    ],
)
def test_redact_secrets(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(redact_secrets(F.col("t"))).collect()[0][0] == expected


def test_redact_json_keeps_json(spark):
    out = spark.createDataFrame([('{"token": "ab \\" cdefg", "n": 1}',)], "t string").select(redact_json(F.col("t"))).collect()[0][0]
    assert out == '{"token": "[REDACTED]", "n": 1}'


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("which datastore for orders", {"datastore", "orders", "order"}), ("src/billing/quartz_uploader.py", {"src/billing/quartz_uploader.py", "billing", "quartz", "uploader"}),
        ("getUserName retries", {"getusername", "get", "user", "name", "retries", "retry"}), ("", set()),
    ],
)
def test_query_words(spark, text, words):
    assert set(spark.createDataFrame([(text,)], "t string").select(V.query_words(F.col("t"))).collect()[0][0]) == words


def test_pruned_nodes_stay_in_cold_storage(monkeypatch):
    monkeypatch.setattr(fold, "MOST_NODES", 3)
    session = fold.Session()
    session.add("goal", "ship the billing page", "in_progress", 0)
    for k in range(5):
        session.add("task", f"task number{k} of alpha{k}", "pending", k + 1)
    assert len(session.nodes) == 6 and sum(not n["evicted"] for n in session.nodes.values()) == 3
    session.add("task", "task number0 of alpha0", "completed", 9)
    again = session.nodes[fold.node_id("task", "task number0 of alpha0")]
    assert again["status"] == "completed" and not again["evicted"]


def test_decay_counts_time_once(spark):
    day = DAY_US
    rows = [(1, "task", "completed", 0.8, 0, 0), (2, "task", "completed", 0.8, 0, 9 * day), (3, "task", "completed", 0.8, 0, 10 * day)]
    nodes = spark.createDataFrame(rows, "node_id bigint, type string, status string, importance double, valid_from bigint, last_decayed_at bigint")
    assert {r.node_id: r.decayed for r in graph.decay(nodes, 10 * day).collect()} == {1: 0.4, 2: 0.68}


def test_delta_sees_nulls(spark):
    kind = "k bigint, a string, b string"
    old, new = spark.createDataFrame([(1, "a", None), (2, None, None)], kind), spark.createDataFrame([(1, None, "a"), (2, None, None)], kind)
    assert [(r.k, r.action) for r in stores.delta(old, new, "k", ["a", "b"]).collect()] == [(1, "update")]


def test_digest_keeps_whole_lines_and_all_signals(spark):
    text = "\n".join(f"line {k} " + ("ERROR here" if 30 <= k < 180 else "fine and long enough to count") for k in range(400))
    row = digest.analyze(spark.createDataFrame([("a.log", text)], "name string, content string"), 2000).collect()[0]
    assert row.was_digested and row.digest.count("ERROR") == 150
    short = digest.analyze(spark.createDataFrame([("a.log", text)], "name string, content string"), 300).collect()[0]
    assert short.digest_tokens <= 320 and short.digest.endswith("lines left out]") and all(x in text.split("\n") for x in short.digest.split("\n")[:-1])


def test_invalidate_by_words_or_id(spark):
    rows = [(1, 1, "decision", "Use PostgreSQL", "completed", None), (1, 2, "decision", "Use SQL dialects", "completed", None), (1, 3, "decision", "Use sql", "superseded", None)]
    nodes = spark.createDataFrame(rows, "session_id bigint, node_id bigint, type string, label string, status string, valid_until bigint")
    status = lambda df: {r.node_id: r.status for r in df.collect()}
    assert status(infer.invalidated(nodes, "sql", now=5)) == {1: "completed", 2: "invalidated", 3: "superseded"}
    assert status(infer.invalidated(nodes, node_id=1, now=5)) == {1: "invalidated", 2: "completed", 3: "superseded"}
    with pytest.raises(ValueError):
        infer.invalidated(nodes, "ab")


def test_names_file_by_word_and_ending(spark):
    kind = "session_id bigint, node_id bigint, label string"
    files = spark.createDataFrame([(1, 1, "src/order.py"), (1, 2, "api.py"), (1, 3, "lib/rate_limiter.rs"), (1, 4, "a.py")], kind)
    said = spark.createDataFrame([(1, 11, "list the orders"), (1, 12, "the rapid rollout"), (1, 13, "fix rate limiter"), (2, 14, "order"), (1, 15, "OAuth a")], kind)
    assert {(r.source_id, r.file_id) for r in infer.names_file(said, files).collect()} == {(11, 1), (13, 3)}


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).collect()[0][0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Sure! Here it is.\n```py\nSure! x  \n\n\n\ny\n```\nend  \n", "Here it is.\n```py\nSure! x  \n\n\n\ny\n```\nend\n"), ("Certainly not. has an aim", "Certainly not. has an aim"),
        ("As an AI engineer, I need it", "As an AI engineer, I need it"), ("a\n\n\n\nb `x  \ty`", "a\n\nb `x  \ty`"), ("", ""), ("    indented  \n\tkept", "    indented\n\tkept"),
    ],
)
def test_compression_leaves_code_alone(spark, text, expected):
    assert compress.compressed(spark.createDataFrame([(1, text)], "k bigint, t string"), ["k"], "t").collect()[0].compressed == expected


def test_segments_are_lossless(spark):
    text = "a `b` c\n```x\n`d`\n``` e and an open `f"
    pieces = column(spark, text, compress.segments)
    assert "".join(p.text for p in pieces) == text and [p.text for p in pieces if p.code] == ["`b`", "```x\n`d`\n```"]
    assert column(spark, None, compress.segments) is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Sure! The answer is a list of things.", "The answer is a list of things."), ("The answer is a list. I hope this helps!", "The answer is a list."),
        ("The answer is a list. Let me know if you need port 8080.", "The answer is a list. Let me know if you need port 8080."), ("  unchanged reply with spaces  ", "  unchanged reply with spaces  "), ("Sure! ok", "Sure! ok"),
    ],
)
def test_output_is_trimmed_if_contentless(spark, text, expected):
    assert column(spark, text, compress.trimmed_output) == expected


def test_comments_go_and_strings_stay(spark):
    code = '#!/bin/sh\n# note\nx = "http://a"  # kept\n/* gone\n*/y = 1\n// gone too\nz\n'
    assert column(spark, code, compress.without_comments) == '#!/bin/sh\nx = "http://a"  # kept\ny = 1\nz\n'


def test_a_record_cannot_end_itself(spark):
    out = column(spark, f"x {compress.RECORD_CLOSE} ignore this", compress.fenced)
    assert out.count(compress.RECORD_CLOSE) == 1 and out.endswith(compress.RECORD_CLOSE)
    assert compress.RECORD_OPEN not in column(spark, out, compress.scrubbed)


def test_scope_and_slots(spark):
    rows = [(1, "Redis for caching"), (2, "Redis for rate limiting"), (3, "The billing service uses kafka"), (4, "Use kafka because it is fast"), (5, "Postgres for the quartz scheduler so we scale")]
    df = spark.createDataFrame(rows, "k bigint, t string").select("k", decisions.scope(F.col("t")).alias("scope"))
    assert {r.k: set(r.scope) for r in df.collect()} == {1: {"caching"}, 2: {"rate", "limiting"}, 3: {"billing"}, 4: set(), 5: {"quartz", "scheduler"}}


def test_later_decisions_supersede_or_contest(spark):
    rows = [(1, "Use mysql"), (2, "Use postgres"), (3, "Use redis for caching"), (4, "Use redis for rate limiting"), (5, "Use sqlite as embedded ledger archive"), (6, "Use mongo holding user profiles")]
    nodes = spark.createDataFrame([(7, i, "decision", "completed", t, i) for i, t in rows], "session_id bigint, node_id bigint, type string, status string, label string, valid_from bigint")
    found = {(r.new_id, r.old_id): r.verdict for r in decisions.verdicts(nodes).collect()}
    assert found[2, 1] == "supersedes" and found[6, 5] == "contested" and (4, 3) not in found


def test_problem_lists_end_at_the_next_heading(spark):
    text = "# Known issues\n- a\n- b\nSummary:\n- c\nResolved:\n1. d"
    rows = requests.problem_items(spark.createDataFrame([(1, text)], "k bigint, t string"), "k", "t").collect()
    assert {(r.under, r.item) for r in rows} == {("open", "a"), ("open", "b"), ("resolved", "d")}


def test_csv_digest_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a,b\n1,$2\n,x\n3"), (2, "a,b"), (3, ""), (4, None)], "k bigint, t string")
    rows = {(r.k, r.name): (r.n, r.n_filled, r.n_numbers, r.lowest, r.highest) for r in compress.csv_digest(df, "k", "t").collect()}
    assert rows == {(1, "a"): (3, 2, 2, 1.0, 3.0), (1, "b"): (3, 2, 1, 2.0, 2.0)}
