"""Arbitrary state over streams: which messages of a resent history are new, and a response cache with expiry.

Both are stateful processors of ``transformWithState`` (Spark keeps their state in RocksDB, see ``configure``). Their rules are
plain functions of state and rows, which the batch forms use, too.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_HASHES = 500


def configure(spark: SparkSession) -> None:
    """Processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# --- new messages of a history that every request sends again


def history_hashes(roles: list[str], texts: list[str]) -> list[str]:
    """A digest of each message; of messages that repeat, each has its own."""
    seen: Counter = Counter()
    out = []
    for role, text in zip(roles, texts, strict=True):
        seen[role, text] += 1
        out.append(hashlib.sha1(f"{role}:{seen[role, text]}:{text}".encode()).hexdigest()[:20])
    return out


def new_places(hashes: list[str], known: list[str], trimmed: bool) -> list[int]:
    """Places of messages that were not there before. Where the known digests were trimmed, what stands before the longest
    run of known messages was processed before the trim."""
    have = set(known)
    flags = [h in have for h in hashes]
    start = 0
    if trimmed and any(flags):
        best, k = (0, 0), 0
        while k < len(flags):
            end = k
            while end < len(flags) and flags[end]:
                end += 1
            best = max(best, (end - k, -k))
            k = max(end, k + 1)
        start = -best[1]
    return [k for k, f in enumerate(flags) if not f and k >= start]


def remembered(known: list[str], trimmed: bool, hashes: list[str], most: int = MOST_HASHES) -> tuple[list[str], bool]:
    """The known digests with those of a history, the newest ``most`` of them."""
    have = set(known)
    grown = [*known, *(h for h in hashes if h not in have)]
    return grown[-most:], trimmed or len(grown) > most


class NewMessages(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "hashes array<string>, trimmed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, trimmed = ([], False) if not self.known.exists() else (list(self.known.get()[0]), bool(self.known.get()[1]))
        for request, history in sorted(pd.concat(list(rows)).groupby("request_id"), key=lambda x: x[0]):
            history = history.sort_values("turn")
            hashes = history_hashes(history["role"].tolist(), history["text"].tolist())
            places = new_places(hashes, known, trimmed)
            known, trimmed = remembered(known, trimmed, [hashes[k] for k in places], self.most)
            if places:
                fresh = history.iloc[places]
                yield pd.DataFrame({"session_id": key[0], "request_id": request, "turn": fresh["turn"].to_numpy(), "role": fresh["role"].to_numpy(), "text": fresh["text"].to_numpy()})
        self.known.update((known, trimmed))

    def close(self) -> None:
        pass


def new_messages(requests: DataFrame, most: int = MOST_HASHES) -> DataFrame:
    """``(session_id, request_id, turn, role, text)`` of messages that a session's earlier requests did not hold.

    ``requests`` is a stream of histories: each request has all its messages again. What comes out goes to
    ``passes.message_facts``, which looks at one message at a time. A request has to arrive in one micro-batch.
    """
    rows = requests.select("session_id", "request_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("session_id").transformWithStateInPandas(NewMessages(most), "session_id bigint, request_id bigint, turn bigint, role string, text string", "Append", "None")


def new_messages_of_table(requests: DataFrame) -> DataFrame:
    """The same of a table: each message of a session at the first request that has it, by its text and how often it came before."""
    same = W.partitionBy("session_id", "request_id", "role", "text").orderBy("turn")
    own = requests.select("session_id", "request_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", F.row_number().over(same))
    first = W.partitionBy("session_id", "role", "text", "nth").orderBy("request_id")
    return own.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("nth", "place")


# --- a cache with expiry and a bound of bytes


def cache_step(entries: dict[str, tuple[int, int, int]], at: int, op: str, key: str, nbytes: int, ttl: int, most_bytes: int) -> bool:
    """Apply one operation to ``entries`` (key: made, used, bytes); whether a ``get`` finds a fresh entry.

    What is over its time is gone for a ``get`` and goes; beyond ``most_bytes`` the least recently used go first.
    """
    made, _, size = entries.get(key, (0, 0, 0))
    if op == "invalidate":
        entries.pop(key, None)
    elif op == "set":
        entries[key] = (at, at, nbytes)
        total = sum(n for _, _, n in entries.values())
        for old in sorted(entries, key=lambda k: (entries[k][1], k)):
            if total <= most_bytes:
                break
            if old != key:
                total -= entries.pop(old)[2]
        if total > most_bytes:
            entries.pop(key)
    elif key in entries:
        if at - made <= ttl:
            entries[key] = (made, at, size)
            return True
        entries.pop(key)
    return False


class Cache(StatefulProcessor):
    def __init__(self, ttl_ms: int, most_bytes: int):
        self.ttl, self.most = ttl_ms, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "made bigint, used bigint, bytes bigint")

    def _load(self) -> dict[str, tuple[int, int, int]]:
        return {k[0]: tuple(v) for k, v in self.entries.iterator()}

    def _save(self, before: dict, after: dict) -> None:
        for k in before.keys() - after.keys():
            self.entries.removeKey((k,))
        for k, v in after.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), tuple(int(x) for x in v))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at_ms", "op_id"])
        before = self._load()
        entries = dict(before)
        hit = [cache_step(entries, int(at), op, k, int(n), self.ttl, self.most) for at, op, k, n in zip(pdf["at_ms"], pdf["op"], pdf["key"], pdf["bytes"], strict=True)]
        self._save(before, entries)
        for k in entries.keys() - before.keys():
            self.handle.registerTimer(int(entries[k][0] + self.ttl + 1))
        yield pd.DataFrame({"scope": key[0], "op_id": pdf["op_id"].to_numpy(), "hit": hit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark has passed an entry's time: all that are over it go."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k, (made, _, _) in self._load().items():
            if now - made > self.ttl:
                self.entries.removeKey((k,))
        yield pd.DataFrame({"scope": pd.Series([], dtype=object), "op_id": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


CACHE_OUT = "scope string, op_id bigint, hit boolean"


def cache(operations: DataFrame, ttl_ms: int, most_bytes: int, late: str = "10 minutes") -> DataFrame:
    """``(scope, op_id, hit)`` of a stream of ``get``, ``set`` and ``invalidate``: ``ts, scope, op_id, op, key, bytes``."""
    rows = operations.select("ts", "scope", "op_id", "op", "key", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), F.unix_millis("ts").alias("at_ms"))
    return rows.withWatermark("ts", late).groupBy("scope").transformWithStateInPandas(Cache(ttl_ms, most_bytes), CACHE_OUT, "Append", "EventTime")


def cache_of_table(operations: DataFrame, ttl_ms: int, most_bytes: int) -> DataFrame:
    """The same of a table: Spark sorts the operations, and a task carries one scope's entries from row to row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, entries = None, {}
        for pdf in batches:
            hit = []
            for own, at, op, k, n in zip(pdf["scope"], pdf["at_ms"], pdf["op"], pdf["key"], pdf["bytes"], strict=True):
                if own != scope:
                    scope, entries = own, {}
                hit.append(cache_step(entries, int(at), op, k, int(n), ttl_ms, most_bytes))
            yield pd.DataFrame({"scope": pdf["scope"], "op_id": pdf["op_id"], "hit": hit})

    rows = operations.select("scope", F.unix_millis("ts").alias("at_ms"), "op_id", "op", "key", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    return rows.repartition("scope").sortWithinPartitions("scope", "at_ms", "op_id").mapInPandas(run, CACHE_OUT)
