"""The appended index, grown passages, notes of dropped spans and observed preferences, against plain versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from parley.operators import recall, stores
from parley.operators.requests import FILLER


def tokens(t):
    return max(1, len(t) // 4) if t else 0


def test_search_reads_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "index")
    turns = [(s, f"h{s}-{k}", k, f"turn {k} about topic{k % 4} and item{k % 7} with word{s}") for s in (1, 2) for k in range(40)]
    shape = "session_id bigint, msg_hash string, seq bigint, content string"
    recall.append(spark.createDataFrame(turns[:50], shape), path)
    recall.append(spark.createDataFrame(turns[30:], shape), path)  # half of it is there
    asked = [(1, 1, "what about topic2 or item5"), (2, 2, "item3"), (3, 1, "nothing of it"), (4, 1, "at")]
    questions = spark.createDataFrame(asked, "question_id bigint, session_id bigint, question string")
    found = {}
    hits = recall.searched(spark, path, questions, 3)
    for r in hits.collect():
        found.setdefault(r.question_id, []).append((r["rank"], r.seq, r.matched))
    for q, s, text in asked:
        terms = {w for w in re.findall(r"\w+", text.lower()) if len(w) >= 3}
        scored = sorted(((-len(terms & set(re.findall(r"\w+", c))), -k) for own, _, k, c in turns if own == s and terms & set(re.findall(r"\w+", c))))[:3]
        assert sorted(found.get(q, [])) == [(n + 1, -k, -m) for n, (m, k) in enumerate(scored)], q
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert spark.read.parquet(f"{path}/turns").count() == len(turns)


def plain_excerpt(content, terms, budget):
    if tokens(content) <= budget:
        return content
    lines = content.split("\n")
    scores = [sum(t in line.lower() for t in terms) for line in lines]
    lo = hi = scores.index(max(scores))
    used = tokens(lines[lo])
    if used > budget:
        places = [lines[lo].lower().index(t) for t in terms if t in lines[lo].lower()]
        at = max(0, min(places, default=0) - 200)
        return "…" + lines[lo][at : at + 3 * budget] + "…"
    while True:
        before = (lo, hi)
        if hi + 1 < len(lines) and used + tokens(lines[hi + 1]) + 1 <= budget:
            hi += 1
            used += tokens(lines[hi]) + 1
        if lo and used + tokens(lines[lo - 1]) + 1 <= budget:
            lo -= 1
            used += tokens(lines[lo]) + 1
        if (lo, hi) == before:
            return ("…\n" if lo else "") + "\n".join(lines[lo : hi + 1]) + ("\n…" if hi < len(lines) - 1 else "")


def test_excerpts(spark):
    draw = random.Random(2)
    rows = [(k, "\n".join(" ".join(draw.choice(["alpha", "beta", "gamma", "x" * draw.randint(1, 60)]) for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(1, 14)))) for k in range(150)]
    rows += [(900, "y" * 900 + " alpha " + "z" * 900), (901, ""), (902, "\n" * 300)]
    terms = F.array(F.lit("alpha"), F.lit("beta"))
    for budget in (5, 30, 90):
        found = spark.createDataFrame(rows, "k int, t string").select("k", recall.excerpt(F.col("t"), terms, budget).alias("e")).collect()
        assert {r.k: r.e for r in found} == {k: plain_excerpt(t, ["alpha", "beta"], budget) for k, t in rows}


def test_recall_skips_what_is_sent(spark, tmp_path):
    path, shape = str(tmp_path / "index"), "session_id bigint, msg_hash string, seq bigint, content string"
    archive = spark.createDataFrame([(1, "a", 0, "retry limit is 5 for payments"), (1, "b", 1, "payments retry was discussed"), (2, "c", 0, "only payments here")], shape)
    recall.append(archive, path)
    questions = spark.createDataFrame([(1, 1, "payments retry limit"), (2, 2, "payments retry")], "question_id bigint, session_id bigint, question string")
    hits = recall.searched(spark, path, questions)
    sent = spark.createDataFrame([(1, "before: retry limit is 5 for payments.")], "session_id bigint, payload string")
    assert [tuple(r) for r in recall.recalled(hits, archive, sent, 50).collect()] == [(1, 1, 1, "payments retry was discussed")]
    assert [r.seq for r in recall.recalled(hits, archive, sent.limit(0), 50).filter("question_id = 1").collect()] == [0]


def plain_notes(messages, known, limit=4):
    kept = []
    for turn, role, text in messages:
        if role == "tool":
            continue
        for place, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+|\n+|;\s+", text or "") if x):
            s = re.sub(r"^[ .!?]+|[ .!?]+$", "", re.sub(r"\s+", " ", s))
            words = {w for w in re.findall(r"\w+", s.lower()) if len(w) >= 3}
            weight = 2 if re.search(recall.QUANTITY, s) else 1 if re.search(recall.CONSTRAINT, s) else 0
            if len(s) < 20 or re.search(recall.FILLER, s) or not weight or len(words) < 4:
                continue
            if any(len(words & set(re.findall(r"\w+", k.lower()))) >= 0.6 * len(words) for k in known):
                continue
            if any(len(words & w) >= 0.7 * len(words) for _, _, _, w, _ in kept):
                continue
            kept.append((weight, turn, place, words, s))
    return [s for _, _, _, _, s in sorted(kept, key=lambda x: (-x[0], -x[1], -x[2]))[:limit]]


def test_notes_of_dropped_spans(spark):
    draw = random.Random(4)
    nouns = "cache payload worker bundle index queue search upload session budget".split()
    say = lambda: draw.choice(["The {} must never exceed the {} of the {}", "Keep the {} of the {} under 500 KB for the {}", "It is nice that the {} has a {} and {}", "Ok, the {} must have a {} in the {}", "We handle 20 requests for each {} and {} in {}"]).format(*(draw.choice(nouns) for _ in range(3)))
    sessions = {s: [(t, draw.choice(["user", "assistant", "tool"]), draw.choice([". ", "\n", "; "]).join(say() for _ in range(draw.randint(0, 4))) + draw.choice([".", "", "!"])) for t in range(25)] for s in (1, 2, 3)}
    known = {1: ["Keep the cache of the index under 500 KB for the queue"], 2: [], 3: ["The worker must never exceed the budget of the search"]}
    messages = spark.createDataFrame([(s, *m) for s, own in sessions.items() for m in own], "session_id bigint, turn bigint, role string, text string")
    labels = spark.createDataFrame([(s, k) for s, own in known.items() for k in own], "session_id bigint, label string")
    found: dict[int, list] = {}
    for r in recall.span_notes(messages, labels).orderBy("session_id", "place").collect():
        found.setdefault(r.session_id, []).append(r.sentence)
    assert found == {s: plain_notes(own, known[s]) for s, own in sessions.items()}
    assert max(len(x) for x in found.values()) == 4


def test_observed_preferences(spark):
    draw = random.Random(6)
    words = "tabs spaces dark light mode strict types brief answers python rust tests always never prefer".split()
    said = [(p, k, k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 5)))) for p in range(300) for k in range(draw.randint(0, 40))]
    significant = lambda t: [w for w in re.findall(r"[a-z0-9]+", t.lower()) if len(w) >= 3 and w not in FILLER]
    expected = set()
    for p in range(300):
        held = []  # (key, text, words, at, n), the oldest first
        for _, at, _, text in (x for x in said if x[0] == p):
            w = significant(text)
            if not w:
                continue
            at_ = next((k for k, h in enumerate(held) if h[2][0] == w[0] or len(set(h[2]) & set(w)) >= 0.6 * min(len(set(h[2])), len(set(w)))), None)
            if at_ is None:
                at_ = next((k for k, h in enumerate(held) if h[0] == "-".join(w[:3])), None)
            old = held.pop(at_) if at_ is not None else ("-".join(w[:3]), None, None, None, 0)
            held.append((old[0], text, w, at, old[4] + 1))
            held = held[-12:]
        expected |= {(p, h[0], h[1], h[3], h[4]) for h in held}
    found = stores.observed_preferences(spark.createDataFrame(said, "principal bigint, ts_us bigint, id bigint, text string"))
    assert {tuple(r) for r in found.collect()} == expected
    assert found.count() == len(expected)
