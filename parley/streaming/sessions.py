"""The session operators over streams: archive, graph fold, rate limit, usage windows.

State is keyed by session, or by client for the limiter, and lives in the state store under the query's checkpoint, so a lost
executor costs a replay of one micro-batch. Time comes from the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators import extract, fold

CAPACITY, PER_SECOND = 70.0, 1.0
IDLE = "2 hours"


def archive(messages: DataFrame, late: str = IDLE) -> DataFrame:
    """Each text of a session once, as it arrives; ``messages`` has an event time ``ts``."""
    key = F.substring(F.sha1(F.concat("role", F.lit(":"), "text")), 1, 20)
    return messages.withColumn("msg_hash", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "msg_hash"])


def usage(requests: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Requests and tokens by provider and hour, emitted when the watermark passes the hour."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", window), "provider").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def graph(messages: DataFrame) -> DataFrame:
    """Nodes of the sessions that each micro-batch touches: facts are folded into the session's state.

    Within a micro-batch a session's facts are sorted; across micro-batches order of arrival is the order.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = fold.Session(json.loads(state.get[0])) if state.exists else fold.Session()
        facts = pd.concat(list(batches))
        fold.fold(session, facts)
        state.update((json.dumps(session.nodes),))
        yield fold.rows(int(key[0]), session)

    facts = extract.facts(messages)
    return facts.groupBy("session_id").applyInPandasWithState(update, fold.SCHEMA, "nodes string", "update", GroupStateTimeout.NoTimeout)


def limiter(requests: DataFrame, capacity: float = CAPACITY, per_second: float = PER_SECOND) -> DataFrame:
    """Admission of requests ``(client_id, request_id, at double seconds)`` by token bucket."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        pdf = pd.concat(list(batches)).sort_values(["at", "request_id"])
        allowed, wait = [], []
        for at in pdf["at"]:
            tokens = min(capacity, tokens + max(0.0, at - (at if last is None else last)) * per_second)
            last = at if last is None else max(at, last)
            allowed.append(tokens >= 1)
            wait.append(0.0 if tokens >= 1 else (1 - tokens) / per_second)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({"client_id": key[0], "request_id": pdf["request_id"], "allowed": allowed, "retry_after": wait})

    return requests.groupBy("client_id").applyInPandasWithState(update, "client_id bigint, request_id bigint, allowed boolean, retry_after double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def upsert_to(path: str):
    """A ``foreachBatch`` sink: the newest rows of each touched session, one folder a batch, so a retried batch overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(spark, path: str) -> DataFrame:
    """What ``upsert_to`` holds: of each session, the rows of its last batch."""
    all_rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = all_rows.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return all_rows.join(last, ["session_id", "batch"], "left_semi").drop("batch")
