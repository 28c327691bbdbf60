"""Queries of decisions and of what texts state about them, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import decisions as D
from parley.plans.inferred import _with
from parley.sources import tables as S
from parley.sources.tables import micros, pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TECHS = ["postgres", "mysql", "redis", "memcached", "kafka", "rabbitmq"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def decided(spark, d) -> DataFrame:
    """Decisions in four shapes: with a component, bare, with a subject, with a purpose."""
    i = F.col("event_id")
    tech, noun = pick(TECHS, i % 6), pick(S.NOUNS, i % 11)
    label = F.when(i % 4 == 0, F.concat(F.lit("Use "), tech, F.lit(" for the "), noun, F.lit(" store"))).when(i % 4 == 1, F.concat(F.lit("Use "), tech)).when(i % 4 == 2, F.concat(F.lit("The "), noun, F.lit(" service uses "), tech)).otherwise(F.concat(F.lit("Use "), tech, F.lit(" for session caching")))
    return S.read(spark, d, "events").select(i.alias("node_id"), F.col("user_id").alias("session_id"), F.lit("decision").alias("type"), F.when(i % 3 == 0, "superseded").otherwise("completed").alias("status"), label.alias("label"), micros("ts").alias("valid_from"))


# What each shape says, written out.
DECIDED = """
d0 AS (SELECT event_id AS node_id, user_id AS session_id, epoch_us(ts) AS valid_from, event_id % 3 <> 0 AS live, event_id % 4 AS k, ['postgres', 'mysql', 'redis', 'memcached', 'kafka', 'rabbitmq'][event_id % 6 + 1] AS tech,
  ['database', 'database', 'cache', 'cache', 'queue', 'queue'][event_id % 6 + 1] AS topic, ['schema', 'token', 'index', 'pipeline', 'handler', 'timeout', 'config', 'query', 'worker', 'route', 'session'][event_id % 11 + 1] AS noun FROM events),
decided AS (SELECT *, CASE k WHEN 0 THEN [noun, 'store'] WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN [noun] ELSE ['session', 'caching'] END AS words FROM d0)
"""


@query(_with(DECIDED) + "SELECT node_id, topic, tech, array_to_string(list_sort(words), ' ') AS slot, array_to_string(list_sort(words), ' ') AS scope FROM decided")
def decision_slots(spark, d):
    line = lambda c: F.array_join(F.array_sort(c), " ")
    label = F.col("label")
    return decided(spark, d).select("node_id", line(D.topics_of(label)).alias("topic"), line(D.keywords(label)).alias("tech"), line(D.slot_words(label)).alias("slot"), line(D.scope(label)).alias("scope"))


@query(_with(DECIDED, "p AS (SELECT a.session_id, a.node_id AS new_id, b.node_id AS old_id, a.words AS x, b.words AS y, a.tech = b.tech AS same_tech FROM decided a JOIN decided b ON a.session_id = b.session_id AND a.topic = b.topic AND a.live AND b.live AND (b.valid_from, b.node_id) < (a.valid_from, a.node_id) AND NOT (a.tech = b.tech AND a.k = b.k AND (a.k IN (1, 3) OR a.noun = b.noun)))", "q AS (SELECT *, len(list_intersect(x, y)) AS shared FROM p)") + "SELECT session_id, new_id, old_id, CASE WHEN same_tech OR len(x) = 0 OR len(y) = 0 OR shared / least(len(x), len(y)) >= 0.5::DOUBLE THEN 'supersedes' ELSE 'contested' END AS verdict FROM q WHERE len(x) = 0 OR len(y) = 0 OR shared = len(x) OR shared = len(y)")
def decision_verdicts(spark, d):
    return D.verdicts(decided(spark, d))


def _told(spark, d) -> DataFrame:
    """Whole messages, each with a statement behind its text."""
    i = F.col("turn") + F.col("conv_id")
    said = F.when(i % 5 == 0, " We switched from Moment.js to date-fns. And replaced Redis with redis, x with y2.").when(i % 5 == 1, " So use pg instead of mysql; migrating from A1 to B1.").when(i % 5 == 2, " It took 340 ms, then 12%, 7 apples.").otherwise(" login page fix kar diya, test suite update karna hai aur api nahi chal raha hai")
    return S.read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.concat(F.coalesce("text", F.lit("")), said).alias("text"))


TOLD = """told AS (SELECT conv_id AS session_id, turn, coalesce(text, '') || CASE (turn + conv_id) % 5 WHEN 0 THEN ' We switched from Moment.js to date-fns. And replaced Redis with redis, x with y2.' WHEN 1 THEN ' So use pg instead of mysql; migrating from A1 to B1.'
  WHEN 2 THEN ' It took 340 ms, then 12%, 7 apples.' ELSE ' login page fix kar diya, test suite update karna hai aur api nahi chal raha hai' END AS t FROM conversations)"""


def _all(pattern: str, *groups: int) -> str:
    return ", ".join(f"unnest(regexp_extract_all(t, '{pattern}', {g}))" for g in groups)


_NAME = r"([\w.+#/-]+)"


@query(f"""WITH {TOLD}, c(session_id, turn, old, new) AS (SELECT session_id, turn, {_all(rf"(?i)\b(?:switch|switched|switching|move|moved|moving|migrate|migrated|migrating) from {_NAME} to {_NAME}", 1, 2)} FROM told
    UNION ALL SELECT session_id, turn, {_all(rf"(?i)\b(?:replace|replaced|replacing) {_NAME} with {_NAME}", 1, 2)} FROM told UNION ALL SELECT session_id, turn, {_all(rf"(?i)\b(?:use|using|chose|picked) {_NAME} instead of {_NAME}", 2, 1)} FROM told),
  b AS (SELECT session_id, turn, rtrim(old, '.') AS old, rtrim(new, '.') AS new FROM c) SELECT DISTINCT * FROM b WHERE length(old) > 1 AND length(new) > 1 AND lower(old) <> lower(new)""")
def stated_changes(spark, d):
    return D.stated_changes(_told(spark, d))


@query(rf"""WITH {TOLD} SELECT DISTINCT session_id, turn, {_all(r"(?i)(?:^|[^0-9.])([0-9]+(?:\.[0-9]+)?\s*(?:ms|second|seconds|minute|minutes|hour|hours|%|percent|mb|gb|tb|kb|rpm|rps|req/s))(?:[^A-Za-z0-9]|$)", 1)} AS evidence FROM told""")
def measurements(spark, d):
    return D.measurements(_told(spark, d))


_WORK = r"([\w./-]+(?: [\w./-]+)?) (?:fix|add|test|deploy|update|merge)"


@query(rf"""WITH {TOLD} SELECT DISTINCT * FROM (SELECT session_id, turn, 'task_done' AS kind, {_all(rf"(?i)\b{_WORK} kar (?:diya|di|liya)\b", 1)} AS label FROM told
  UNION ALL SELECT session_id, turn, 'task_todo', {_all(rf"(?i)\b{_WORK} karna (?:hai|hoga|padega)\b", 1)} FROM told UNION ALL SELECT session_id, turn, 'error', {_all(r"(?i)\b([\w./-]+) (?:nahi|nahin|nhi) chal (?:raha|rahi|rahe)\b", 1)} FROM told)""")
def hinglish_facts(spark, d):
    return D.hinglish_facts(_told(spark, d))
