"""Extraction by passes: masks against a plain writing, claims, places, and own labelled sessions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import extract, mentions, passes

MESSAGES = "session_id bigint, turn bigint, role string, text string"


def plain_error(line):
    line = line.lstrip()
    return line.startswith(tuple(mentions.REPORTS)) or bool(re.match(r"[^:\s]*(Error|Exception):", line))


def plain_mask(text):
    """Spans first, all of them united, then one pass over the characters."""
    spans = []
    blocks = [m.span() for m in re.finditer(r"```[^\n]*\n(?:.*?```|.*)|~~~[^\n]*\n(?:.*?~~~|.*)", text, re.S)]
    for a, b in blocks:
        at = a
        for line in text[a:b].split("\n"):
            if not plain_error(line):
                spans.append((at, at + len(line)))
            at += len(line) + 1
    shown = list(text)

    def wipe():
        for a, b in spans:
            for k in range(a, b):
                shown[k] = "\n" if shown[k] == "\n" else " "

    wipe()
    lines, at = "".join(shown).split("\n"), 0
    numbered = [bool(re.match(r"[ \t]*\d{1,6}(:|\t| \| )", x)) for x in lines]
    for k, line in enumerate(lines):
        run = any(all(0 <= j < len(lines) and numbered[j] for j in range(s, s + 3)) for s in (k - 2, k - 1, k))
        if re.fullmatch(r"[ \t]*\|.*\|[ \t]*", line) or run:
            spans.append((at, at + len(line)))
        at += len(line) + 1
    wipe()
    for m in re.finditer(r'["“][^"“”\n]+["”]', "".join(shown)):
        words = re.split("[^A-Za-z0-9_]+", m[0])
        if len(m[0]) <= 302 and not any(re.fullmatch(r".*(Error|Exception)|[45]\d\d|E[A-Z]{4,}", w) for w in words):
            shown[m.start() : m.end()] = " " * len(m[0])
    return "".join(shown)


def test_masks(spark):
    draw = random.Random(3)
    parts = ["```py\n", "```", "~~~\n", "~~~", "ValueError: no\n", "  KeyError: 'x'\n", "| a | b |\n", "12: x\n", "13\ty\n", "14 | z\n", '"said"', '"a 404 came"', "“quoted”", "text goes on ", "\n", "é\U0001f600 ", '"', "error: bad\n", "| no\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string").select("i", mentions.mask(F.col("t")).alias("m")).collect()
    for r in found:
        assert r.m == plain_mask(texts[r.i]), texts[r.i]
        assert len(r.m) == len(texts[r.i])


def test_places_point_at_the_words(spark):
    text = 'He said "we decided to use oracle". 😀 We decided to use postgres for orders. I fixed src/a.py after a ValueError.\n```\nI fixed the sky\n```\nWe need to add tests.'
    found = passes.message_facts(spark.createDataFrame([(1, 5, "assistant", text)], MESSAGES)).collect()
    said = {(r.kind, text[r.start : r.stop]) for r in found}
    assert ("decision", "decided to use postgres for orders") in said and ("task_todo", "need to add tests") in said
    assert ("file", "src/a.py") in said and ("error", "ValueError") in said
    assert not any("oracle" in s or "sky" in s for _, s in said)


def test_claims_do_not_overlap(spark):
    text = "We switched from redis to memcached.\nFixed: payment retry\n- [x] write the docs\n- [ ] ship it today\nI just added a cache and we will use kafka instead of rabbitmq."
    found = passes.message_facts(spark.createDataFrame([(1, 9, "assistant", text)], MESSAGES)).filter("kind <> 'file'").collect()
    spans = sorted((r.start, r.stop) for r in found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {(r.kind, r.label, r.old) for r in found} == {
        ("decision", "Use memcached", "redis"), ("task_done", "payment retry", ""), ("task_done", "write the docs", ""), ("task_todo", "ship it today", ""), ("task_done", "Add cache", ""), ("decision", "Use kafka", "rabbitmq"),
    }


FINISHED = [
        ("The login page was merged.", "Merge login page"),
        ("Both of us agree that the retry logic has been rewritten.", "Rewrite retry logic"),
        ("So now the billing webhook handler is finished.", "Finish billing webhook handler"),
        ("We have already deployed the new search index to staging.", "Deploy new search index to staging"),
        ("I wrote a parser because it was slow.", "Write parser"),
        ("We've migrated user tables, and it works.", "Migrate user tables"),
        ("The migration is not done yet.", None),
        ("Once the branch is merged we can go on.", None),
        ("If I have fixed the build it will pass.", None),
        ("Have we fixed the build?", None),
        ("We would have added more tests.", None),
        ("Nobody has deployed the fix.", None),
]


def test_labels_of_finished_work(spark):
    rows = [(k, 9, "assistant", text) for k, (text, _) in enumerate(FINISHED)]
    found = {r.session_id: r.label for r in passes.message_facts(spark.createDataFrame(rows, MESSAGES)).filter("kind = 'task_done'").collect()}
    assert [found.get(k) for k in range(len(FINISHED))] == [label for _, label in FINISHED]


def test_base_verbs(spark):
    forms = {"merged": "merge", "added": "add", "shipped": "ship", "wrote": "write", "moved": "move", "deployed": "deploy", "updated": "update", "configured": "configure", "tested": "test", "created": "create", "wired": "wire", "built": "build", "fixed": "fix"}
    row = spark.range(1).select(*(passes.base_verb(F.lit(v)).alias(v) for v in forms)).collect()[0].asDict()
    assert row == forms


SESSIONS = {
    1: [("user", "The goal is to speed up the checkout. Can we use redis for sessions?"), ("assistant", "Sounds good. I added a session store. We need to write load tests."), ("user", "What about memcached?"), ("assistant", "I would rather not."), ("user", "ok, the dashboard is failing")],
    2: [("user", "Help me migrate the reports. How about kafka for events?"), ("system", "reminder"), ("assistant", "Yes, let's do that. We switched from celery to kafka."), ("assistant", "I have fixed the retry queue. Should I add metrics?"), ("user", "We decided to use grafana for metrics. We must update the runbook.")],
    3: [("user", "I want to ship the mobile app"), ("assistant", "Currently working on the push service. The icon set was updated."), ("user", "I'm getting a TimeoutError when it starts"), ("assistant", "Fixed: startup timeout\nNext: crash reports"), ("user", "Let's go with sentry for crash reports. We never deployed the old backend.")],
    4: [("user", "wir haben das nicht mit der datenbank, und die app ist ein problem, I fixed x"), ("tool", "We decided to use oracle. src/main.py\nKeyError: 'a'"), ("assistant", "We will use sqlite for tests. Use sqlite rather than mysql."), ("user", "If we added caching it would be faster. We have to remove dead code.")],
    5: [("user", "We want to rename the package"), ("assistant", "Bug: imports are circular\nDecision: one module a table\n- [x] move the helpers\n- [ ] delete the shim"), ("user", "Perfect. I refactored the loader, and we will test the loader."), ("assistant", 'The error says "we decided to use perl". We chose poetry.')],
}
TRUTH = {
    1: [("goal", "speed up the checkout"), ("decision", "redis for sessions"), ("task_done", "Add session store"), ("task_todo", "write load tests"), ("error", "dashboard")],
    2: [("goal", "migrate the reports"), ("decision", "kafka for events"), ("decision", "Use kafka"), ("task_done", "Fix retry queue"), ("decision", "grafana for metrics"), ("task_todo", "update the runbook")],
    3: [("goal", "ship the mobile app"), ("task_wip", "push service"), ("task_done", "Update icon set"), ("error", "TimeoutError"), ("task_done", "startup timeout"), ("task_todo", "crash reports"), ("decision", "sentry for crash reports")],
    4: [("file", "src/main.py"), ("error", "KeyError"), ("decision", "sqlite for tests"), ("decision", "Use sqlite"), ("task_todo", "remove dead code")],
    5: [("goal", "rename the package"), ("error", "imports are circular"), ("decision", "one module a table"), ("task_done", "move the helpers"), ("task_todo", "delete the shim"), ("task_done", "Refactor loader"), ("task_todo", "test the loader"), ("decision", "poetry")],
}


def test_labelled_sessions(spark):
    rows = [(s, t, role, text) for s, turns in SESSIONS.items() for t, (role, text) in enumerate(turns)]
    found = passes.conversation_facts(spark.createDataFrame(rows, MESSAGES)).select("session_id", "kind", "label")
    truth = spark.createDataFrame([(s, k, label) for s, facts in TRUTH.items() for k, label in facts], "session_id bigint, kind string, label string")
    scores = {r.kind: (r.precision, r.recall) for r in extract.evaluate(found, truth).collect()}
    assert set(scores) == {"goal", "decision", "task_done", "task_todo", "task_wip", "error", "file"}, scores
    assert all(p >= 0.9 and q >= 0.9 for p, q in scores.values()), (scores, sorted(map(tuple, found.collect())))


def test_vaguer_decisions_go(spark):
    rows = [(1, "decision", x) for x in ("bcrypt", "bcrypt for password hashing", "redis", "Redis cache", "kafka", "postgres for orders")] + [(2, "decision", "bcrypt"), (1, "task_done", "redis")]
    frame = spark.createDataFrame(rows, "session_id bigint, kind string, label string")
    found = sorted(map(tuple, passes.drop_vaguer(frame).collect()))
    assert found == [(1, "decision", "Redis cache"), (1, "decision", "bcrypt for password hashing"), (1, "decision", "kafka"), (1, "decision", "postgres for orders"), (1, "task_done", "redis"), (2, "decision", "bcrypt")]


def test_a_clause_is_cut_once(spark):
    m = spark.createDataFrame([(1, 0, "user", "We decided to use redis.")], "session_id bigint, turn bigint, role string, text string")
    plan = passes.message_facts(m)._jdf.queryExecution().optimizedPlan().toString()
    # What is around a candidate, and the words of a text, are each computed in one place of the plan.
    assert plan.count(r"([^.!?;\n]*)$") == plan.count(r"^([^.!?\n]*[.!?]?)") == 1
    assert plan.count("split(lower(text") == 1


def test_what_precedes_a_candidate(spark):
    ends = ["We decided to use redis for jobs.", "not sure.\r\nWe decided to use redis for jobs", "We never\r\n decided to use redis for jobs", "It is not so; we decided to use redis for jobs?", "if a.b\nwe decided to use redis for jobs", "maybe" + " so" * 70 + " we decided to use redis for jobs", "x. " * 80 + "we decided to use redis for jobs"]
    m = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(ends)], "session_id bigint, turn bigint, role string, text string")
    found = {r.session_id: r.kind for r in passes.message_facts(m).filter("label LIKE 'redis%'").collect()}
    # A line's end ends a clause, and no more than 160 characters are looked at.
    assert found == {k: "proposal" if k == 3 else "decision" for k in range(len(ends))}
