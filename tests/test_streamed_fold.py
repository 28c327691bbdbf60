"""Sessions that stream through a task give the nodes that each gives by itself; facts of texts that recur are those of each message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from parley.operators import extract, fold


def test_sessions_in_one_stream(spark):
    said = [("decision", "use redis"), ("file", "src/a/auth.py"), ("error", "TimeoutError"), ("task_todo", "write the load tests"), ("decision", "use memcached"), ("task_done", "write the load tests today"), ("file", "auth.py"), ("other", "x")]
    rows = [(s, t, *said[(s * 5 + t * 3) % len(said)], "redis" if t % 5 == 4 else None) for s in range(40) for t in range(s % 30)]
    facts = spark.createDataFrame(rows, "session_id bigint, turn bigint, kind string, label string, old string").repartition(5)
    alone = [fold.rows(s, fold.fold(fold.Session(), g)) for s, g in pd.DataFrame(rows, columns=facts.columns).groupby("session_id")]
    expected = sorted(tuple(None if v is None or v != v else v for v in r) for g in alone for r in g.itertuples(index=False))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # sessions go on in the next batch
    try:
        found = fold.fold_sessions(facts)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # No session is a group of its own in Python: that costs more than its facts do.
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert fold.fold_sessions(facts.limit(0)).count() == 0


def test_each_text_is_read_once(spark):
    texts = ["We decided to use redis. I fixed src/app/a.py after a ValueError.", "My goal is to ship it", None, "", "nothing"]
    m = spark.range(60).select((F.col("id") % 7).alias("session_id"), (F.col("id") % 9).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    plain, joined = (sorted(map(tuple, extract.facts(m, recurring=r).collect())) for r in (False, True))
    assert len(plain) > 40 and joined == plain


def test_patterns_run_once(spark):
    m = spark.createDataFrame([(1, 0, "user", "We decided to use redis.")], "session_id bigint, turn bigint, role string, text string")
    for recurring in (False, True):
        plan = extract.facts(m, recurring=recurring)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("decided (?:to use") == 1


def test_facts_of_sessions_are_settled(spark):
    said = ["We need to fix the login page. See src/a/x.py", "I fixed the login page in x.py", "We decided to use redis"]
    m = spark.createDataFrame([(s, t, "user", said[(s + t) % 3]) for s in range(5) for t in range(4)], "session_id bigint, turn bigint, role string, text string")
    plain, more = extract.session_facts(m), extract.session_facts(m.filter("turn < 2"), more=m.filter("turn >= 2"))
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, plain.collect())) != []
    # Patterns do not run again for each use of the facts.
    assert "regexp_extract_all" not in extract.drop_shadowed_paths(plain)._jdf.queryExecution().optimizedPlan().toString()
