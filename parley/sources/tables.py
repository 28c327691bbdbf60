"""The engine's relations over the driver's tables.

Conversations are messages; events are read twice, as a request log and as a temporal property graph with one session
a user. Time is in microseconds since 1970 (``bigint``), so it does not depend on a session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
PER_PART = 200_000  # events that are sorted in one task
# The vocabulary of the node labels, chosen by remainders of the event id.
VERBS = ["use", "fix", "add", "review", "drop", "test", "migrate"]
TOPICS = ["database", "auth", "cache", "deploy", "billing"]
NOUNS = ["schema", "token", "index", "pipeline", "handler", "timeout", "config", "query", "worker", "route", "session"]
# Node types by event type, statuses by remainder.
TYPES = {"error": "error", "purchase": "decision", "view": "file", "click": "task", "signup": "goal"}
STATUSES = ["pending", "in_progress", "completed", "failed", "archived", "superseded", "modified", "invalidated", "contested"]
INACTIVE = ["superseded", "modified", "invalidated", "archived"]
OPEN = ["in_progress", "pending", "failed", "contested"]
# Providers and models of the request log, by event type.
MODELS = {"view": ("anthropic", "claude-3-haiku"), "click": ("openai", "gpt-4o-mini"), "error": ("google", "gemini-1.5-pro"), "purchase": ("ollama", "llama3"), "signup": ("mistral", "mistral-large")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def pick_column(values: list[Column], index: Column) -> Column:
    """One of several columns, of which only that one is computed."""
    out = F.when(F.lit(False), values[0])
    for k, value in enumerate(values):
        out = out.when(index == k, value)
    return out


def lookup(values: dict[str, str], column: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, value in values.items():
        out = out.when(column == key, F.lit(value))
    return out


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, turn, role, text)``."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    base = e.select(
        i.alias("node_id"),
        F.col("user_id").alias("session_id"),
        lookup(TYPES, F.col("event_type")).alias("type"),
        F.concat_ws(" ", pick(VERBS, i % 7), pick(TOPICS, i % 5), pick(NOUNS, i % 11)).alias("label"),
        pick(STATUSES, i % 9).alias("status"),
        F.round(F.least(F.col("value"), F.lit(500.0)) / 500, 3).alias("importance"),
        F.round(0.5 + (i % 50) / 100, 2).alias("confidence"),
        (i % 5).alias("topic"),
        micros("ts").alias("valid_from"),
    )
    later = F.lead("valid_from").over(W.partitionBy("session_id", "type", "topic").orderBy("valid_from", "node_id"))
    return base.withColumn("valid_until", F.when(F.col("type") == "decision", later))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user, and every third again in the other direction with its own type."""
    events = read(spark, sf_dir, "events")
    # As many parts as the events ask for: left to itself, Spark fits parts by their compressed size, and these swell in a sort.
    parts = max(spark.sparkContext.defaultParallelism, -(-events.count() // PER_PART))
    e = events.select("event_id", "user_id", micros("ts").alias("ts_us")).repartition(parts, "user_id")
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts_us", "event_id"))
    pairs = e.withColumn("before", before).filter("before IS NOT NULL")
    kind = F.when(F.col("event_id") % 4 == 0, "FIXES").when(F.col("event_id") % 4 == 1, "PART_OF").when(F.col("event_id") % 4 == 2, "DEPENDS_ON").otherwise("RELATED_TO")
    # Both directions come from one row, so users are sorted once.
    edge = lambda source, target, kind, weight: F.struct(F.col(source).alias("source_id"), F.col(target).alias("target_id"), kind.alias("type"), weight.alias("weight"))
    ahead = edge("before", "event_id", kind, F.round(0.5 + (F.col("event_id") % 10) / 20, 2))
    both = F.array(ahead, edge("event_id", "before", F.lit("RELATED_TO"), F.lit(1.0)))
    return pairs.select(F.col("user_id").alias("session_id"), F.explode(F.when(F.col("event_id") % 3 == 0, both).otherwise(F.array(ahead))).alias("e")).select("session_id", "e.*")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision and the next one of the same user on the same topic."""
    d = nodes(spark, sf_dir).filter("type = 'decision'")
    w = W.partitionBy("session_id", "topic").orderBy("valid_from", "node_id")
    nxt = d.select("session_id", "topic", F.col("node_id").alias("from_id"), F.col("label").alias("from_label"), F.lead("node_id").over(w).alias("to_id"), F.lead("label").over(w).alias("to_label"), F.lead("valid_from").over(w).alias("ts_us"), F.round(F.lead("confidence").over(w) - F.col("confidence"), 2).alias("confidence_delta"))
    return nxt.filter("to_id IS NOT NULL")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    t = F.col("event_type")
    original = F.floor(F.col("value") * 40).cast("bigint") + 100
    saved = F.floor(F.col("value") * (F.col("event_id") % 7) * 2).cast("bigint")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("session_id"),
        micros("ts").alias("ts_us"),
        lookup({k: v[0] for k, v in MODELS.items()}, t).alias("provider"),
        lookup({k: v[1] for k, v in MODELS.items()}, t).alias("model"),
        original.alias("input_original"),
        (original - saved).alias("input_sent"),
        (F.floor(F.col("value") * 3).cast("bigint") + 1).alias("output_tokens"),
        saved.alias("saved"),
        F.create_map(F.lit("compression"), F.floor(saved / 2).cast("bigint"), F.lit("window"), (saved - F.floor(saved / 2)).cast("bigint"), F.concat(F.lit("layer_"), t), F.col("event_id") % 3).alias("layers"),
    )


def latest(df: DataFrame, column: str) -> Column:
    """The log's own clock: its latest time, as a scalar subquery of the plan that uses it."""
    return df.agg(F.max(column)).scalar()


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of six types whose labels have the shapes of their types: paths, routes, packages, work, choices, failures."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    verb, topic, noun = pick(VERBS, i % 7), pick(TOPICS, i % 5), pick(NOUNS, i % 11)
    kind = pick(["file", "endpoint", "dependency", "task", "decision", "error"], i % 6)
    label = (
        F.when(i % 6 == 0, F.concat(F.lit("src/"), topic, F.lit("/"), noun, F.lit("_handler.py")))
        .when(i % 6 == 1, F.concat(F.lit("POST /api/"), topic, F.lit("/"), noun))
        .when(i % 6 == 2, topic)
        .when((i % 6 == 3) & (i % 4 == 3), F.concat(F.lit("Ship POST /api/"), topic, F.lit("/"), noun, F.lit(" today")))
        .when(i % 6 == 3, F.concat(verb, F.lit(" the "), noun, F.lit(" handlers")))
        .when(i % 6 == 4, F.concat(F.lit("Use "), topic, F.lit(" for the "), noun, F.lit("-handler")))
        .otherwise(F.concat(F.lit("TimeoutError in "), noun, F.lit("_handler.py"), F.when(i % 4 == 1, F.concat(F.lit(" of "), topic)).otherwise("")))
    )
    status = pick(["completed", "in_progress", "failed"], i % 7 % 3)
    return e.select(i.alias("node_id"), F.col("user_id").alias("session_id"), kind.alias("type"), label.alias("label"), status.alias("status"), F.round(F.least(F.col("value"), F.lit(500.0)) / 500, 3).alias("importance"), micros("ts").alias("valid_from"))
