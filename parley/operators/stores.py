"""Stored state: checkpoints, ownership, preferences, delta writes, recall across sessions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.requests import FILLER


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("session_id").agg(F.max(F.struct("ts_us", "checkpoint_id")).alias("m"), F.count("*").alias("n")).select("session_id", F.col("m.checkpoint_id").alias("checkpoint_id"), F.col("m.ts_us").alias("ts_us"), "n")


def retained_checkpoints(checkpoints: DataFrame, most: int = 20) -> DataFrame:
    """All manual checkpoints and the newest automatic ones of a session."""
    place = F.row_number().over(W.partitionBy("session_id", "trigger").orderBy(F.desc("ts_us"), F.desc("checkpoint_id")))
    return checkpoints.withColumn("place", place).filter((F.col("trigger") != "auto") | (F.col("place") <= most)).drop("place")


def first_claims(claims: DataFrame) -> DataFrame:
    """A session's owner is whoever claimed it first."""
    return claims.groupBy("session_id").agg(F.min(F.struct("ts_us", "claim_id", "principal")).alias("m")).select("session_id", F.col("m.principal").alias("owner"), F.col("m.ts_us").alias("since"))


def allowed(owners: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(session_id, principal)``: allowed if the session has no owner or this one."""
    return asked.join(owners, "session_id", "left").select("session_id", "principal", (F.col("owner").isNull() | (F.col("owner") == F.col("principal"))).alias("allowed"))


def sessions_of(owners: DataFrame, principal: int, k: int = 100) -> DataFrame:
    return owners.filter(F.col("owner") == principal).orderBy(F.desc("since"), "session_id").limit(k)


def latest_preferences(observed: DataFrame, most: int = 12) -> DataFrame:
    """The newest value of each key, the newest ``most`` keys of each principal."""
    one = observed.groupBy("principal", "key").agg(F.max(F.struct("ts_us", "value")).alias("m")).select("principal", "key", F.col("m.value").alias("value"), F.col("m.ts_us").alias("ts_us"))
    place = F.row_number().over(W.partitionBy("principal").orderBy(F.desc("ts_us"), "key"))
    return one.withColumn("place", place.cast("bigint")).filter(F.col("place") <= most)


def preference_context(observed: DataFrame, most: int = 4, longest: int = 60) -> DataFrame:
    """The newest preferences as one line, while they fit."""
    p = latest_preferences(observed)
    line = F.concat(F.col("key"), F.lit("="), F.col("value").cast("string"))
    w = W.partitionBy("principal").orderBy("place")
    p = p.withColumn("line", line).withColumn("used", F.sum(F.length("line") + 2).over(w)).filter((F.col("place") <= most) & (F.col("used") <= longest))
    rows = F.sort_array(F.collect_list(F.struct("place", "line")))
    return p.groupBy("principal").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "; ").alias("context"))


def delta(written: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What a write has to do: upserts of new or changed rows (null is a value like others), deletes of those that are gone."""
    a = written.select(key, F.struct(*columns).alias("old"))
    b = current.select(key, F.struct(*columns).alias("new"))
    j = a.join(b, key, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~same, "update")
    return j.withColumn("action", action).filter("action IS NOT NULL").select(key, "action")


def gone_elsewhere(persisted: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    return persisted.select(key).join(disk.select(key), key, "left_anti")


def recall_across(scored: DataFrame, owners: DataFrame, principal: int, current: int, sessions: int = 5, k: int = 10) -> DataFrame:
    """The best nodes of the current session and of the principal's newest other ones."""
    others = owners.filter((F.col("owner") == principal) & (F.col("session_id") != current)).orderBy(F.desc("since"), "session_id").limit(sessions).select("session_id")
    pool = others.unionAll(scored.sparkSession.createDataFrame([(current,)], "session_id bigint"))
    return scored.join(F.broadcast(pool), "session_id", "left_semi").orderBy(F.desc("score"), "node_id").limit(k).select("session_id", "node_id", "score")


def without_session(df: DataFrame, session: int) -> DataFrame:
    return df.filter(F.col("session_id") != session)


def deletion_counts(stores: dict[str, DataFrame], sessions: DataFrame) -> DataFrame:
    """``(session_id, store, removed)``: how many rows of each store the deletion of ``sessions`` takes, 0 included.

    Rows are counted by store before they meet the sessions; a null session is deleted with none.
    """
    doomed = sessions.select("session_id").filter("session_id IS NOT NULL").distinct()
    counts = reduce(DataFrame.unionByName, (df.groupBy("session_id").agg(F.count("*").alias("removed")).withColumn("store", F.lit(name)) for name, df in stores.items()))
    asked = doomed.withColumn("store", F.explode(F.array(*map(F.lit, stores))))
    return asked.join(counts, ["session_id", "store"], "left").select("session_id", "store", F.coalesce("removed", F.lit(0)).alias("removed"))


def without_sessions(stores: dict[str, DataFrame], sessions: DataFrame) -> dict[str, DataFrame]:
    """Every store without the rows of ``sessions``; rows without a session stay."""
    doomed = sessions.select("session_id").filter("session_id IS NOT NULL").distinct()
    return {name: df.join(doomed, "session_id", "left_anti") for name, df in stores.items()}


def expired_sessions(df: DataFrame, now: int | Column, ttl_us: int) -> DataFrame:
    return df.groupBy("session_id").agg(F.max("ts_us").alias("last_at")).filter(F.col("last_at") < now - ttl_us)


def released(owners: DataFrame, sessions: DataFrame) -> DataFrame:
    """The owners without sessions that are being deleted."""
    return owners.join(sessions.select("session_id"), "session_id", "left_anti")


def renamed(owners: DataFrame, old: int, new: int) -> DataFrame:
    """Every session of one principal goes to another."""
    return owners.withColumn("owner", F.when(F.col("owner") == old, new).otherwise(F.col("owner")))


def observed_preferences(said: DataFrame, most: int = 12) -> DataFrame:
    """``(principal, key, text, ts_us, n)``: what each principal prefers after all statements ``(principal, ts_us, id, text)`` in
    their order. A statement that restates a preference (``requests.same_preference``) takes its place and keeps its key; of
    more than ``most`` the one longest not restated goes.

    Spark sorts the statements, and a task carries one principal's preferences from row to row, however many there are.
    """
    significant = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(FILLER))
    rows = said.select("principal", "ts_us", "id", "text", significant.alias("words")).filter(F.size("words") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        principal, held = None, {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(principal, key, text, at, n) for key, (text, _, _, at, n) in held.items()], columns=["principal", "key", "text", "ts_us", "n"])

        for pdf in batches:
            for own, at, text, words in zip(pdf["principal"].tolist(), pdf["ts_us"].tolist(), pdf["text"].tolist(), pdf["words"].tolist(), strict=True):
                if own != principal:
                    if held:
                        yield out()
                    principal, held = own, {}
                head, mine = words[0], set(words)
                key = next((k for k, (_, other, theirs, _, _) in held.items() if other == head or len(mine & theirs) >= 0.6 * min(len(mine), len(theirs))), None)
                key = "-".join(words[:3]) if key is None else key
                n = held.pop(key)[4] if key in held else 0  # it becomes the newest
                held[key] = (text, head, mine, at, n + 1)
                if len(held) > most:
                    held.pop(next(iter(held)))
        if held:
            yield out()

    kind = said.schema["principal"].dataType.simpleString()
    ordered = rows.repartition("principal").sortWithinPartitions("principal", "ts_us", "id")
    return ordered.mapInPandas(run, f"principal {kind}, key string, text string, ts_us bigint, n bigint")
