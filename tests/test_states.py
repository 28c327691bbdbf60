"""Streams with state against their batch forms and plain loops."""

from __future__ import annotations

import datetime
import random

import pytest

from parley.operators import passes
from parley.streaming import states

HISTORY = "session_id bigint, request_id bigint, turn bigint, role string, text string"
OPS = "ts timestamp, scope string, op_id bigint, op string, key string, bytes bigint"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    states.configure(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, parts, kind, run, name):
    source = tmp_path / "in"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(source / f"p{k:03d}"))
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = run(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).collect()))


def histories(seed, sessions=3, requests=6):
    draw, out = random.Random(seed), []
    for s in range(sessions):
        talk = []
        for r in range(requests):
            talk += [(draw.choice(["user", "assistant"]), draw.choice(["ok", "ok", f"We decided to use kafka{draw.randint(0, 5)} for events.", f"text {draw.random()}"])) for _ in range(draw.randint(1, 4))]
            out.append([(s, r, t, role, text) for t, (role, text) in enumerate(talk)])
    return out


def test_streamed_new_messages_are_the_batch_ones(rocks, tmp_path):
    parts = histories(1)
    by_session = {}
    for p in parts:
        by_session.setdefault(p[0][0], []).append(p)
    draw, shuffled = random.Random(9), []
    while any(by_session.values()):  # requests of a session in order, sessions mixed, rows of a request in any order
        own = by_session[draw.choice([s for s, left in by_session.items() if left])].pop(0)
        shuffled.append(draw.sample(own, len(own)))
    found = streamed(rocks, tmp_path, shuffled, HISTORY, states.new_messages, "fresh")
    batch = states.new_messages_of_table(rocks.createDataFrame([r for p in parts for r in p], HISTORY))
    assert found == sorted(map(tuple, batch.select("session_id", "request_id", "turn", "role", "text").collect()))
    # Of a whole history, each message came once; so the facts of the stream are those of the last request's history.
    facts = lambda rows: sorted(map(tuple, passes.message_facts(rocks.createDataFrame(rows, "session_id bigint, turn bigint, role string, text string")).collect()))
    last = [(s, t, role, text) for p in parts if p[0][1] == 5 for s, _, t, role, text in p]
    assert facts([(s, t, role, text) for s, _, t, role, text in found]) == facts(last)


def test_trimmed_digests_do_not_bring_old_messages_back():
    talk, known, trimmed, seen = [], [], False, 0
    for k in range(400):
        talk.append(("user", "ok" if k % 3 else f"message {k}"))
        hashes = states.history_hashes(*map(list, zip(*talk, strict=True)))
        places = states.new_places(hashes, known, trimmed)
        assert places == [k]
        known, trimmed = states.remembered(known, trimmed, [hashes[p] for p in places], 50)
        seen += len(places)
    assert len(known) == 50 and trimmed and seen == 400
    assert states.new_places(states.history_hashes(["user"], ["another talk"]), known, trimmed) == [0]


def plain_cache(ops, ttl, most):
    out, caches = [], {}
    for ts, scope, i, op, key, n in sorted(ops, key=lambda o: (o[1], o[0], o[2])):
        held = caches.setdefault(scope, [])  # [key, made, bytes], the least recently used first
        at = int(ts.timestamp() * 1000)
        entry = next((e for e in held if e[0] == key), None)
        hit = False
        if op == "invalidate":
            held[:] = [e for e in held if e[0] != key]
        elif op == "set":
            held[:] = [e for e in held if e[0] != key] + [[key, at, n]]
            while sum(e[2] for e in held) > most:
                held.pop(0)
        elif entry:
            held.remove(entry)
            hit = at - entry[1] <= ttl
            if hit:
                held.append(entry)
        out.append((scope, i, hit))
    return sorted(out)


def operations(n=400, seed=3):
    draw, start = random.Random(seed), datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    return [(start + datetime.timedelta(seconds=40 * k + draw.randint(0, 30)), draw.choice("ab"), k, draw.choice(["get", "get", "set", "set", "invalidate"]) if k % 11 else "get", f"k{draw.randint(0, 9)}", draw.randint(1, 400)) for k in range(n)]


def test_cache_of_a_table_is_the_plain_cache(spark):
    ops = operations()
    found = states.cache_of_table(spark.createDataFrame(ops, OPS), 600_000, 1000)
    assert sorted(map(tuple, found.collect())) == plain_cache(ops, 600_000, 1000)
    assert 20 < sum(r.hit for r in found.collect()) < 200


def test_streamed_cache_is_the_batch_cache(rocks, tmp_path):
    ops = operations(120)
    found = streamed(rocks, tmp_path, [ops[:40], ops[40:80], ops[80:]], OPS, lambda s: states.cache(s, 600_000, 1000), "cached")
    assert found == plain_cache(ops, 600_000, 1000)
