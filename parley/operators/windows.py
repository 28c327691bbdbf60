"""The window of a long session with tools: where it may be cut, what takes the place of what goes, and what is sent then.

A tail opens only where a step does: at a user's turn, or at an assistant's that calls tools and so brings their results
along. The cut lies at the first step within the last ``protect`` turns, else at the newest step. With tool results and a
ceiling the tail is then shortened step by step to half the ceiling, so that it has room to grow; the newest step always
stays. If what is kept is below ``floor`` (the least that a provider caches) the cut moves back. All of it comes from one
running sum a session: tails only get shorter, so "step by step until" is "the first step that".

A session within its budget, without a step, with no more than ``protect`` turns or whose cut would move to its beginning is
sent as it is. What goes is told by a bridge: the session's context block and the paths that dropped tool calls and results
showed, both fenced, and how many turns went. A tail that opens on an assistant's step has a constant turn in front.

Null texts are empty; null ``calls`` are none; no messages, no rows. ``turn`` is unique in a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.compress import fenced
from parley.operators.messages import PER_SESSION, tokens

HEAD = "Paths seen in earlier tool output (contents omitted):"
LEAD = "[Earlier steps are summarised in the context above. Continue from the steps below.]"
# Endings by which a word without a slash is a file's name.
ENDINGS = "py js jsx ts tsx go rs java rb php cs cpp hpp c h md json yaml yml toml txt html css sql sh cfg ini lock xml csv".split()
SHORTEST_PATH, LONGEST_PATH = 4, 300
CALLS = "array<struct<name:string,arguments:string>>"


def steps(messages: DataFrame) -> DataFrame:
    """Turns that are not the system's, with their place from 0, the tokens from there on, and whether a step opens there."""
    conv = tokens(messages.filter("role <> 'system'"))
    by = W.partitionBy("session_id").orderBy("turn")
    calls = F.coalesce(F.size("calls"), F.lit(0)) > 0
    tail = F.sum("tokens").over(W.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, W.currentRow)) + PER_SESSION
    return conv.select("session_id", "turn", "role", (F.row_number().over(by) - 1).alias("at"), tail.alias("tail"), ((F.col("role") == "user") | ((F.col("role") == "assistant") & calls)).alias("opens"))


def cuts(messages: DataFrame, budget: int, protect: int, ceiling: int = 0, floor: int = 0) -> DataFrame:
    """``(session_id, split, split_turn, opens_with)`` of the sessions that are cut: turns before the ``split``-th go."""
    over = tokens(messages).groupBy("session_id").agg((F.sum("tokens") + PER_SESSION).alias("total"), F.coalesce(F.sum(F.when(F.col("role") == "system", F.col("tokens"))), F.lit(0)).alias("base"))
    s = steps(messages)
    sizes = s.groupBy("session_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("opens"), F.col("at"))).alias("last"), F.max((F.col("role") == "tool")).alias("tools"))
    wide = sizes.join(over, "session_id").filter((F.col("total") > budget) & (F.col("n") > protect) & F.col("last").isNotNull())
    at = s.filter("opens").join(wide, "session_id")

    def first(fits: Column) -> Column:
        return F.min(F.when(fits, F.col("at")))

    # The first step late enough that also fits half the ceiling; where none does, the newest.
    late = F.col("at") >= F.col("n") - protect
    short = (F.lit(ceiling) <= 0) | ~F.col("tools") | (F.col("tail") <= ceiling // 2)
    split = at.groupBy("session_id", "last", "base").agg(first(late & short).alias("split")).select("session_id", "base", F.coalesce("split", "last").alias("split"))
    # The latest step up to there that keeps the floor; where none does, the first.
    back = s.filter("opens").join(split, "session_id").filter(F.col("at") <= F.col("split"))
    enough = F.col("base") + PER_SESSION + F.col("tail") >= floor
    final = back.groupBy("session_id").agg(F.coalesce(F.max(F.when(enough, F.struct("at", "turn", "role"))), F.min(F.struct("at", "turn", "role"))).alias("c"))
    return final.filter("c.at > 0").select("session_id", F.col("c.at").cast("bigint").alias("split"), F.col("c.turn").alias("split_turn"), F.col("c.role").alias("opens_with"))


def paths(text: Column) -> Column:
    """The words of a text that are paths, in order: with a slash and a letter, or with an ending that files have."""
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[\"'`()\[\]{}<>,;:!?]+|[\"'`()\[\]{}<>,;:!?]+$", ""), r"\.+$", ""))
    sound = F.filter(bare, lambda w: F.length(w).between(SHORTEST_PATH, LONGEST_PATH) & w.rlike(r"^[\w./@+~][\w./@+~-]*$"))
    short = F.transform(sound, lambda w: F.regexp_replace(w, r"^\./", ""))
    return F.filter(short, lambda w: F.when(w.contains("/"), w.rlike("[A-Za-z]")).otherwise(w.rlike(r"[^.].*\.") & F.lower(F.substring_index(w, ".", -1)).isin(ENDINGS)))


def path_lines(dropped: DataFrame, budget: int) -> DataFrame:
    """``(session_id, index)``: paths of dropped tool calls and results by directory, the directories seen last, in a budget.

    Whether a directory's line fits is told by sums before its names are brought together.
    """
    spoken = F.concat(F.when(F.col("role") == "tool", F.array("text")).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce("calls", F.array().cast(CALLS)), lambda c: c["arguments"]))
    each = dropped.select("session_id", "turn", F.posexplode(F.flatten(F.transform(F.filter(spoken, lambda t: t.isNotNull()), paths))).alias("k", "path"))
    seen = each.groupBy("session_id", "path").agg(F.min(F.struct("turn", "k")).alias("place"))
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    named = seen.select("session_id", "place", F.when(folder == "", "(no directory)").otherwise(folder).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    sums = named.groupBy("session_id", "folder").agg(F.min("place").alias("first"), (F.sum(F.length("name")) + F.count("*") - 1).alias("length"))
    cost = F.greatest(F.lit(1), F.floor((F.length("folder") + 2 + F.col("length")) / 4)) + 1
    newest = W.partitionBy("session_id").orderBy(F.desc("first"), "folder").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = sums.withColumn("used", F.sum(cost).over(newest)).filter(F.col("used") + len(HEAD) // 4 <= budget).select("session_id", "folder", "first")
    lines = named.join(kept, ["session_id", "folder"]).groupBy("session_id", "folder", "first").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("names"))
    lines = lines.select("session_id", "first", "folder", F.concat("folder", F.lit(": "), F.array_join(F.transform("names", lambda n: n["name"]), " ")).alias("line"))
    all_ = lines.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("first", F.col("folder").alias("f"), "line"))).alias("own"))
    return all_.select("session_id", F.concat(F.lit(HEAD + "\n"), F.array_join(F.transform("own", lambda x: x["line"]), "\n")).alias("index"))


def applied(messages: DataFrame, contexts: DataFrame, budget: int, protect: int, ceiling: int = 0, floor: int = 0, index_budget: int = 0) -> DataFrame:
    """``(session_id, place, role, text)``: what is sent of every session.

    ``messages`` has ``session_id, turn, role, text, calls``; ``contexts`` has ``session_id, block``.
    """
    m = messages.select("session_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "calls")
    cut = cuts(m, budget, protect, ceiling, floor)
    both = m.join(cut, "session_id", "left")
    whole, of_system = F.col("split").isNull(), F.col("role") == "system"
    sent = both.filter(whole | of_system | (F.col("turn") >= F.col("split_turn"))).select("session_id", F.when(~whole & of_system, 0).otherwise(3).alias("part"), "turn", "role", "text")
    gone = both.filter(~whole & ~of_system & (F.col("turn") < F.col("split_turn")))
    told = cut.join(contexts.filter("block <> ''").select("session_id", "block"), "session_id", "left")
    told = told.join(path_lines(gone, index_budget), "session_id", "left") if index_budget else told.withColumn("index", F.lit(None).cast("string"))
    note = F.concat(F.lit("["), F.col("split").cast("string"), F.lit(" earlier messages omitted]"))
    bridge = F.array_join(F.array(F.when(F.col("block").isNotNull(), fenced(F.col("block"))), F.when(F.col("index").isNotNull(), fenced(F.col("index"))), note), "\n\n")
    turn = F.lit(None).cast("bigint").alias("turn")
    bridges = told.select("session_id", F.lit(1).alias("part"), turn, F.lit("system").alias("role"), bridge.alias("text"))
    leads = cut.filter("opens_with <> 'user'").select("session_id", F.lit(2).alias("part"), turn, F.lit("user").alias("role"), F.lit(LEAD).alias("text"))
    by = W.partitionBy("session_id").orderBy("part", "turn")
    return sent.unionByName(bridges).unionByName(leads).select("session_id", (F.row_number().over(by) - 1).cast("bigint").alias("place"), "role", "text")
