"""Vector searches over many copies, nulls, uneven lengths and zeros; and cosines that tie only once they are rounded."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import cache
from parley.plans import registry

NAMES = ["nearest_vectors", "nearest_vectors_all", "similar_hits", "similar_hits_all", "blended_scores", "blended_scores_all"]


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
@pytest.mark.parametrize("name", NAMES)
def test_copies_and_near_ties(spark, tmp_path, name, threshold):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    x = base[rng.integers(0, 60, 3000)] + rng.choice([0.0, 0.0, 1e-7, 3e-4], (3000, 1)) * rng.normal(size=(3000, 8))
    rows = [(k * 3, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = registry.QUERIES[name](spark, str(tmp_path))
        found = sorted(map(tuple, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    # Blocks meet, not single vectors, and each pair of blocks is cut down before it is sorted.
    assert "collect_list" in plan and "MapInArrow" in plan


def test_equals_the_plain_join(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, 1.0]), (3, [1.0]), (4, [1.0, None]), (5, [-1.0, 0.5]), (None, [1.0, 0.0]), (7, [float("nan"), 1.0]), (20, [0.0, 1.0]), (40, None), (60, [2.0, 2.0]), (60, [2.0, -2.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    plain = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(cache.cosine(F.col("query"), F.col("embedding")), 6).alias("similarity"))
    for k in (1, 3, 50):
        found: dict = {}
        for r in cache.nearest(v, q, k).collect():
            found.setdefault(r.query_id, []).append((r.vec_id, repr(r.similarity)))
        expected: dict = {}
        for r in plain.orderBy("query_id", F.desc("similarity"), "vec_id").collect():
            expected.setdefault(r.query_id, []).append((r.vec_id, repr(r.similarity)))
        cut = {i: sorted(own[:k]) for i, own in expected.items() if i != 60}
        assert {i: sorted(own) for i, own in found.items() if i != 60} == cut
        assert [s for _, s in found[60]] == [s for _, s in expected[60][:k]]


def test_zero_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    found = cache.nearest(v, v.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 2).collect()
    assert [(r.rank, r.vec_id, repr(r.similarity)) for r in sorted(found)] == [(1, 1, "nan"), (2, 2, "0.707107")]


def test_no_more_tasks_than_pairs_of_blocks(spark):
    v = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")).repartition(9)
    assert cache._blocks(v, ["vec_id", "embedding"], 50, "vectors").rdd.getNumPartitions() <= 2
