"""Edges come from one sort of the users, and what is added is aggregated in place."""

from __future__ import annotations

from parley.operators import infer
from parley.plans import registry
from parley.sources import tables as S

DATA = "/root/testdata/sf0.001"


def test_users_are_sorted_once_a_use(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(S.edges(spark, DATA)).count("Window [") == 1
    added = plan(registry.QUERIES["added_edges"](spark, DATA))
    assert added.count("Window [") == 2 and "SortAggregate" not in added


def test_first_weight_stays(spark):
    shape = "session_id bigint, source_id bigint, target_id bigint, type string, weight double"
    old = spark.createDataFrame([(1, 1, 2, "A", 0.7), (1, 1, 2, "A", 0.9), (1, 2, 2, "A", 1.0), (1, 3, 4, "A", None)], shape)
    new = spark.createDataFrame([(1, 1, 2, "A", 0.1), (1, 2, 1, "A", 0.4), (1, 2, 1, "A", 0.3), (1, 3, 4, "A", 0.2), (1, 5, 6, "A", None), (1, 5, 6, "A", 0.2)], shape)
    assert sorted(map(tuple, infer.with_edges(old, new).collect())) == [(1, 1, 2, "A", 0.7), (1, 2, 1, "A", 0.3), (1, 3, 4, "A", None), (1, 5, 6, "A", None)]


def test_parts_grow_with_the_events(spark, monkeypatch):
    monkeypatch.setattr(S, "PER_PART", 50)
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert S.edges(spark, DATA).rdd.getNumPartitions() == -(-n // 50) > 4
