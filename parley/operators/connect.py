"""Edges and changes of folded sessions: what ``fold`` makes is joined by the relations of ``infer``, ``relations`` and ``graph``.

Both ends of a relation are looked for in the whole session, not in one batch of facts, so a fix of today meets the error
of last week. Only live nodes are joined, of which a fold keeps at most ``fold.MOST_NODES`` a session; so the joins on words
are bounded by that and not by a session's length. SUPERSEDES leads from a decision to what it replaced, whatever its status.

Nodes are those of ``fold.fold_sessions``. Null labels relate to nothing; no nodes, no edges. An edge is given once; a node
has no edge to itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import graph, infer, relations
from parley.sources.tables import INACTIVE

COLUMNS = ["session_id", "source_id", "target_id", "type"]


def _edge(df: DataFrame, source: str, target: str, kind: str | Column) -> DataFrame:
    return df.select("session_id", F.col(source).alias("source_id"), F.col(target).alias("target_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))


def edges(nodes: DataFrame) -> DataFrame:
    """``(session_id, source_id, target_id, type)`` of every session."""
    live = nodes.filter(~F.col("evicted") & ~F.col("status").isin(INACTIVE) & F.col("label").isNotNull()).withColumn("valid_from", F.col("last_turn"))
    found = [
        _edge(relations.part_of(live), "task_id", "goal_id", "PART_OF"),
        _edge(relations.related(live), "decision_id", "task_id", "RELATED_TO"),
        _edge(infer.file_links(live), "source_id", "file_id", F.col("relation")),
        _edge(infer.error_files(live), "error_id", "file_id", "RELATED_TO"),
        _edge(infer.depends_on(live), "source_id", "dependency_id", "DEPENDS_ON"),
        _edge(infer.implements(live), "source_id", "endpoint_id", "IMPLEMENTS"),
        _edge(graph.error_task_links(live).withColumn("fix", F.col("relation") == "FIXES").selectExpr("session_id", "if(fix, task_id, error_id) AS a", "if(fix, error_id, task_id) AS b", "relation"), "a", "b", F.col("relation")),
        _edge(changes(nodes), "to_id", "from_id", "SUPERSEDES"),
    ]
    return reduce(DataFrame.unionByName, found).filter("source_id <> target_id").distinct()


def changes(nodes: DataFrame) -> DataFrame:
    """``(session_id, from_id, from_label, to_id, to_label, turn)``: each decision that another one replaced, and when."""
    old = nodes.filter("type = 'decision' AND superseded_by IS NOT NULL").select("session_id", F.col("node_id").alias("from_id"), F.col("label").alias("from_label"), F.col("superseded_by").alias("to_id"))
    new = nodes.filter("type = 'decision'").select("session_id", F.col("node_id").alias("to_id"), F.col("label").alias("to_label"), F.col("first_turn").alias("turn"))
    return old.join(new, ["session_id", "to_id"]).select("session_id", "from_id", "from_label", "to_id", "to_label", "turn")
