"""Edges of folded sessions against loops over all pairs, and what a change does to the graph."""

from __future__ import annotations

import random
import re

import pytest

from parley.operators import connect, fold, passes
from parley.operators.infer import INFLECTIONS
from parley.operators.relations import ALIASES
from parley.plans import blocked

DATA = "/root/testdata/sf0.001"
INACTIVE = ("superseded", "modified", "invalidated", "archived")
OPEN = ("in_progress", "pending", "failed", "contested")
SUBJECT = {alias: subject for subject, own in ALIASES.items() for alias in own}


def words(label, least):
    return {w for w in re.split(r"[^\w]+", label.lower()) if len(w) >= least}


def subjects(label):
    own = words(label, 4)
    return own | {SUBJECT[w] for w in own if w in SUBJECT}


def names(label, path):
    stem = re.sub(r"[_\-]+", " ", path.rsplit("/", 1)[-1].split(".")[0].lower()).strip()
    return len(stem) > 2 and re.search(rf"(?<![a-z0-9]){re.escape(stem)}(?:{'|'.join(INFLECTIONS)})?(?![a-z0-9])", re.sub(r"[_\-]+", " ", label.lower())) is not None


def plain(nodes):
    """Every pair of a session looked at."""
    out = set()
    for session in {n.session_id for n in nodes}:
        own = [n for n in nodes if n.session_id == session]
        live = [n for n in own if not n.evicted and n.status not in INACTIVE]
        goals = sorted((n for n in live if n.type == "goal"), key=lambda n: (n.last_turn, n.node_id))
        pairs = [(a, b) for a in live for b in live if a is not b]
        out |= {(session, t.node_id, goals[-1].node_id, "PART_OF") for t in live if t.type == "task" and goals}
        out |= {(session, n.superseded_by, n.node_id, "SUPERSEDES") for n in own if n.superseded_by}
        for a, b in pairs:
            kinds, edge = (a.type, b.type), (session, a.node_id, b.node_id)
            if kinds == ("decision", "task") and subjects(a.label) & subjects(b.label):
                out.add((*edge, "RELATED_TO"))
            if b.type == "file" and a.type in ("task", "decision") and names(a.label, b.label):
                out.add((*edge, "IMPLEMENTS" if a.type == "task" else "RELATED_TO"))
            if kinds == ("error", "file") and b.label.rsplit("/", 1)[-1] in a.label:
                out.add((*edge, "RELATED_TO"))
            if b.type == "dependency" and a.type in ("decision", "task", "file") and b.label.lower().strip() in {w.strip(".,!?:;()[]") for w in a.label.lower().split() if len(w) > 3}:
                out.add((*edge, "DEPENDS_ON"))
            parts = [w for w in re.split(r"[/\s]+", b.label.lower()) if w]
            if kinds == ("file", "endpoint") and {w for w in re.split(r"[/\s]+", a.label.lower()) if len(w) > 3} & set(parts):
                out.add((*edge, "IMPLEMENTS"))
            if kinds == ("task", "endpoint") and b.label.lower() in a.label.lower():
                out.add((*edge, "IMPLEMENTS"))
            if kinds == ("task", "error"):
                shared, least = len(words(a.label, 3) & words(b.label, 3)), min(len(words(a.label, 3)), len(words(b.label, 3)))
                if shared and shared / least >= 0.6 and a.status == "completed":
                    out.add((*edge, "FIXES"))
                elif shared >= 2 and a.status in OPEN and b.status in OPEN:
                    out.add((session, b.node_id, a.node_id, "BLOCKS"))
    return out


def test_edges_of_made_sessions(spark):
    rng, rows = random.Random(5), []
    things = ["login", "session", "database", "token", "payment", "handler", "redis"]
    for session in range(25):
        for k in range(30):
            a, b, c = rng.choices(things, k=3)
            kind = rng.choice(["goal", "task", "decision", "error", "file", "endpoint", "dependency"])
            label = {"file": f"src/{a}/{b}_{c}.py", "endpoint": f"POST /api/{a}", "dependency": a, "error": f"Timeout of the {a} {b} in {b}_{c}.py", "goal": f"Ship {a}", "decision": f"Use {a} for {b}"}.get(kind, f"Fix the {a} {b} of {b}_{c}, POST /api/{c}")
            rows.append((session, f"n{k}", kind, label, rng.choice(["completed", "pending", "failed", "superseded"]), 0.5, k, rng.choice([k, k + 40]), 1, None, rng.random() < 0.1))
    nodes = spark.createDataFrame(rows, fold.SCHEMA)
    assert {tuple(r) for r in connect.edges(nodes).collect()} == plain(nodes.collect())


def test_edges_of_given_conversations(spark):
    nodes = blocked.QUERIES["folded_conversations"](spark, DATA).collect()
    got = connect.edges(spark.createDataFrame(nodes, fold.SCHEMA)).collect()
    assert {tuple(r) for r in got} == plain(nodes) and len(got) == len({tuple(r) for r in got})
    assert {"PART_OF", "RELATED_TO", "IMPLEMENTS", "SUPERSEDES"} <= {r.type for r in got}


def test_a_stated_change_replaces_what_names_the_old(spark):
    said = [(1, 0, "user", "We decided to use celery for mail."), (1, 1, "assistant", "Yes."), (1, 2, "user", "We switched from celery to temporal."), (1, 3, "user", "We decided to use spark for reports.")]
    facts = passes.conversation_facts(spark.createDataFrame(said, "session_id bigint, turn bigint, role string, text string")).withColumnRenamed("first_turn", "turn")
    nodes = fold.fold_sessions(facts)
    by = {r.label: r for r in nodes.filter("type = 'decision'").collect()}
    assert by["celery for mail"].status == "superseded" and by["celery for mail"].superseded_by == by["Use temporal"].node_id
    assert by["spark for reports"].superseded_by is None
    assert [(r.from_label, r.to_label, r.turn) for r in connect.changes(nodes).collect()] == [("celery for mail", "Use temporal", 2)]


@pytest.mark.parametrize("again", [False, True])
def test_a_change_is_folded_once(again):
    session = fold.Session()
    session.add("decision", "Use postgres", "completed", 1)
    new = session.add("decision", "Use cockroach", "completed", 2, "Postgres")
    if again:
        session.add("decision", "Use cockroach", "completed", 3, "postgres")
    old = session.nodes[fold.node_id("decision", "Use postgres")]
    assert old["superseded_by"] == new and session.nodes[new]["superseded_by"] is None
    # What was replaced is no longer of its slot: the next choice of a database does not touch it.
    session.add("decision", "Use mysql", "completed", 4)
    assert old["superseded_by"] == new


def test_no_nodes_and_null_labels(spark):
    assert connect.edges(spark.createDataFrame([], fold.SCHEMA)).count() == 0
    rows = [(1, "a", "task", None, "pending", 0.5, 1, 1, 1, None, False), (1, "b", "goal", "Ship", "in_progress", 0.5, 1, 1, 1, None, False)]
    assert connect.edges(spark.createDataFrame(rows, fold.SCHEMA)).count() == 0


def test_a_fold_is_dealt_out(spark):
    # By their bytes, all facts of a small input would be folded in one task.
    nodes = blocked._folded(spark, DATA)
    assert nodes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert fold.fold_sessions(nodes.select("session_id", "first_turn", "type", "label").toDF("session_id", "turn", "kind", "label"), 3).rdd.getNumPartitions() == 3
