"""Queries of inferred relations and of changes to the graph, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import infer
from parley.plans.oracle import EDGES, NODES
from parley.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The labels of ``tables.artifacts``, written out.
ARTIFACTS = """
a0 AS (SELECT event_id AS node_id, user_id AS session_id, ['use', 'fix', 'add', 'review', 'drop', 'test', 'migrate'][event_id % 7 + 1] AS verb, ['database', 'auth', 'cache', 'deploy', 'billing'][event_id % 5 + 1] AS topic,
  ['schema', 'token', 'index', 'pipeline', 'handler', 'timeout', 'config', 'query', 'worker', 'route', 'session'][event_id % 11 + 1] AS noun, event_id % 6 AS k, event_id % 4 AS q,
  ['completed', 'in_progress', 'failed'][event_id % 7 % 3 + 1] AS status, epoch_us(ts) AS valid_from FROM events),
artifacts AS (SELECT node_id, session_id, status, valid_from, ['file', 'endpoint', 'dependency', 'task', 'decision', 'error'][k + 1] AS type, topic, noun, CASE WHEN k = 0 THEN 'src/' || topic || '/' || noun || '_handler.py' WHEN k = 1 THEN 'POST /api/' || topic || '/' || noun
  WHEN k = 2 THEN topic WHEN k = 3 AND q = 3 THEN 'Ship POST /api/' || topic || '/' || noun || ' today' WHEN k = 3 THEN verb || ' the ' || noun || ' handlers' WHEN k = 4 THEN 'Use ' || topic || ' for the ' || noun || '-handler'
  ELSE 'TimeoutError in ' || noun || '_handler.py' || CASE WHEN q = 1 THEN ' of ' || topic ELSE '' END END AS label FROM a0)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + " "


_NAMED = "regexp_matches(regexp_replace(lower(m.label), '[_-]+', ' ', 'g'), '(^|[^a-z0-9])' || regexp_replace(regexp_extract(f.label, '([^/.]*)[^/]*$', 1), '[_-]+', ' ', 'g') || '(s|es|d|ed|r|er|ers|ing|ment|ql)?($|[^a-z0-9])')"


@query(_with(ARTIFACTS) + f"SELECT m.session_id, m.node_id AS source_id, f.node_id AS file_id, CASE m.type WHEN 'task' THEN 'IMPLEMENTS' ELSE 'RELATED_TO' END AS relation FROM artifacts m JOIN artifacts f ON m.session_id = f.session_id AND f.type = 'file' AND m.type IN ('task', 'decision') AND {_NAMED}")
def file_links(spark, d):
    return infer.file_links(S.artifacts(spark, d))


@query(_with(ARTIFACTS) + "SELECT e.session_id, e.node_id AS error_id, f.node_id AS file_id FROM artifacts e JOIN artifacts f ON e.session_id = f.session_id AND e.type = 'error' AND f.type = 'file' AND contains(e.label, regexp_extract(f.label, '([^/]*)$', 1))")
def error_files(spark, d):
    return infer.error_files(S.artifacts(spark, d))


@query(_with(ARTIFACTS) + "SELECT o.session_id, o.node_id AS source_id, p.node_id AS dependency_id FROM artifacts o JOIN artifacts p ON o.session_id = p.session_id AND p.type = 'dependency' AND o.type IN ('decision', 'task', 'file') AND list_contains(string_split(lower(o.label), ' '), p.label)")
def depends_on_links(spark, d):
    return infer.depends_on(S.artifacts(spark, d))


@query(_with(ARTIFACTS) + "SELECT s.session_id, s.node_id AS source_id, p.node_id AS endpoint_id FROM artifacts s JOIN artifacts p ON s.session_id = p.session_id AND p.type = 'endpoint' AND ((s.type = 'file' AND (s.topic = p.topic OR s.noun || '_handler.py' = p.noun)) OR (s.type = 'task' AND contains(lower(s.label), lower(p.label))))")
def implements_links(spark, d):
    return infer.implements(S.artifacts(spark, d))


@query(_with(ARTIFACTS, "o AS (SELECT session_id, node_id, valid_from, label, list_distinct(list_filter(string_split_regex(lower(label), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('use', 'for', 'the'))) AS ws FROM artifacts WHERE type = 'decision' AND status = 'completed')") + "SELECT a.session_id, a.node_id AS new_id, b.node_id AS old_id, len(list_intersect(a.ws, b.ws))::BIGINT AS shared FROM o a JOIN o b ON a.session_id = b.session_id AND (b.valid_from, b.node_id) < (a.valid_from, a.node_id) AND a.label <> b.label WHERE len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), len(b.ws)) >= 0.6::DOUBLE")
def overlapping_decisions(spark, d):
    return infer.overlapping_decisions(S.artifacts(spark, d))


_ASKED = "asked AS (SELECT DISTINCT session_id, unnest(['Database', 'use auth', 'use cache for the token-handler', 'nothing']) AS name FROM artifacts)"


@query(_with(ARTIFACTS, _ASKED, "hits AS (SELECT a.session_id, a.name, n.node_id, lower(n.label) = lower(a.name) AS exact, length(n.label) AS size FROM asked a JOIN artifacts n ON n.session_id = a.session_id AND n.type = 'decision' AND regexp_matches(lower(n.label), '\\b' || lower(a.name) || '\\b'))") + "SELECT a.session_id, a.name, h.node_id FROM asked a LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY session_id, name ORDER BY NOT exact, size, node_id) = 1) h ON a.session_id = h.session_id AND a.name = h.name")
def resolved_names(spark, d):
    n = S.artifacts(spark, d)
    names = n.select("session_id").distinct().withColumn("name", F.explode(F.array(*map(F.lit, ["Database", "use auth", "use cache for the token-handler", "nothing"]))))
    return infer.resolved(names, n)


@query(_with(EDGES, "n AS (SELECT session_id, source_id, target_id, type, 0.75::DOUBLE AS weight FROM edges WHERE source_id % 2 = 0 UNION ALL SELECT session_id, target_id, source_id, 'BLOCKS', 0.5 FROM edges WHERE target_id % 5 = 0 UNION ALL SELECT session_id, source_id, source_id, 'LOOP', 1 FROM edges)", "u AS (SELECT *, 0 AS later FROM edges UNION ALL SELECT *, 1 FROM n)") + "SELECT session_id, source_id, target_id, type, arg_min(weight, (later, weight)) AS weight FROM u WHERE source_id <> target_id GROUP BY 1, 2, 3, 4")
def added_edges(spark, d):
    e = S.edges(spark, d)
    edge = lambda source, target, kind, weight: F.struct(F.col(source).alias("source_id"), F.col(target).alias("target_id"), kind.alias("type"), F.lit(weight).alias("weight"))
    again = F.when(F.col("source_id") % 2 == 0, edge("source_id", "target_id", F.col("type"), 0.75))
    back = F.when(F.col("target_id") % 5 == 0, edge("target_id", "source_id", F.lit("BLOCKS"), 0.5))
    loop = edge("source_id", "source_id", F.lit("LOOP"), 1.0)
    new = e.select("session_id", F.explode(F.array_compact(F.array(again, back, loop))).alias("new")).select("session_id", "new.*")
    return infer.with_edges(e, new)


@query(_with(NODES) + r"SELECT node_id, CASE WHEN hit THEN 'invalidated' ELSE status END AS status, CASE WHEN hit THEN 1705320000000000 ELSE valid_until END AS valid_until, CASE WHEN hit THEN 'Invalidated: too slow' END AS summary FROM (SELECT *, type = 'decision' AND status = 'completed' AND regexp_matches(label, '\bcache\b') AS hit FROM nodes)")
def invalidated_decisions(spark, d):
    return infer.invalidated(S.nodes(spark, d), "Cache ", reason="too slow", now=1_705_320_000_000_000).select("node_id", "status", "valid_until", "summary")


@query(_with(ARTIFACTS, "e AS (SELECT session_id, node_id, string_split_regex(lower(label), '[^a-z0-9_]+') AS ws FROM artifacts WHERE type = 'error')") + "SELECT a.session_id, a.node_id, min(b.node_id) AS stated_by FROM e a JOIN e b ON a.session_id = b.session_id AND len(a.ws) < len(b.ws) AND len(list_intersect(a.ws, b.ws)) = len(list_distinct(a.ws)) GROUP BY 1, 2")
def restated_errors(spark, d):
    return infer.restated_errors(infer.of_type(S.artifacts(spark, d), "error"))


@query(_with(ARTIFACTS, "t AS (SELECT session_id, node_id, list_filter(string_split_regex(lower(label || CASE WHEN node_id % 5 = 0 THEN ' the token worker' ELSE '' END), '[^a-z0-9_]+'), lambda w: w <> '') AS ws FROM artifacts WHERE type = 'task')", "c AS (SELECT session_id, node_id, w, count(*) AS c FROM (SELECT session_id, node_id, unnest(ws) AS w FROM t) GROUP BY ALL)", "p AS (SELECT a.session_id, a.node_id AS small_id, b.node_id AS large_id FROM t a JOIN t b ON a.session_id = b.session_id AND a.node_id <> b.node_id AND len(a.ws) < len(b.ws))") + "SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM c x LEFT JOIN c y ON y.node_id = p.large_id AND y.w = x.w WHERE x.node_id = p.small_id AND x.c > coalesce(y.c, 0))")
def contained_tasks(spark, d):
    t = infer.of_type(S.artifacts(spark, d), "task")
    return infer.contained_tasks(t.withColumn("label", F.when(F.col("node_id") % 5 == 0, F.concat("label", F.lit(" the token worker"))).otherwise(F.col("label"))))


@query(_with(NODES, "f AS (SELECT session_id, label, 0 AS part, row_number() OVER (PARTITION BY session_id ORDER BY valid_from, node_id) AS place FROM nodes WHERE type = 'task' UNION ALL SELECT session_id, label, 1, row_number() OVER (PARTITION BY session_id ORDER BY valid_from, node_id) FROM nodes WHERE type = 'file')", "g AS (SELECT session_id, label, min((part, place)) AS pos FROM f GROUP BY 1, 2)") + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos, label) AS place, label FROM g")
def merged_labels(spark, d):
    n = S.nodes(spark, d)
    by = W.partitionBy("session_id").orderBy("valid_from", "node_id")
    listed = lambda kind: n.filter(F.col("type") == kind).select("session_id", "label", F.row_number().over(by).alias("place"))
    return infer.merged_labels(listed("task"), listed("file"))
