"""Relations between nodes of a session, and evaluation of labels and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.sources.tables import INACTIVE

# Other words for a subject, and the words that name a topic.
ALIASES = {"database": ["db", "storage", "schema"], "auth": ["login", "token", "session"], "deploy": ["release", "pipeline"], "billing": ["payment", "invoice"], "cache": ["redis", "timeout"]}
TOPICS = {"storage": ["database", "schema", "index", "query"], "identity": ["auth", "token", "session"], "delivery": ["deploy", "pipeline", "worker"], "money": ["billing"], "speed": ["cache", "timeout"]}
PREFERENCE = r"\b(i (prefer|like|always|never|want)|please (always|never)|from now on|don't ever)\b"
NO_PREFERENCE = r"\b(do you|would you|what|why)\b"


def expanded(words: Column) -> Column:
    """Words and the subject that each is another word for."""
    back = {alias: subject for subject, own in ALIASES.items() for alias in own}
    table = F.create_map(*(F.lit(x) for pair in back.items() for x in pair))
    return F.array_distinct(F.concat(words, F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda w: w.isNotNull())))


def _words(nodes: DataFrame, kind: str, name: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind).select("session_id", F.col("node_id").alias(name), F.explode(expanded(T.words(F.col("label"), 4))).alias("word"))


def part_of(nodes: DataFrame) -> DataFrame:
    """Every task belongs to the session's newest goal: one goal a session, so no pairs are formed."""
    goal = nodes.filter("type = 'goal'").groupBy("session_id").agg(F.max(F.struct("valid_from", "node_id")).alias("g")).select("session_id", F.col("g.node_id").alias("goal_id"))
    return nodes.filter("type = 'task'").join(goal, "session_id").select("session_id", F.col("node_id").alias("task_id"), "goal_id")


def related(nodes: DataFrame) -> DataFrame:
    """Decisions and tasks of a session with a word in common, other words for a subject counting as it."""
    joined = _words(nodes, "decision", "decision_id").join(_words(nodes, "task", "task_id"), ["session_id", "word"])
    return joined.groupBy("session_id", "decision_id", "task_id").agg(F.count_distinct("word").alias("shared"))


def slot_supersede(nodes: DataFrame) -> DataFrame:
    """Of each session and topic, the latest decision in force, and how many it stands over."""
    d = nodes.filter((F.col("type") == "decision") & ~F.col("status").isin(INACTIVE))
    return d.groupBy("session_id", "topic").agg(F.max(F.struct("valid_from", "node_id", "label")).alias("m"), F.count("*").alias("n")).select("session_id", "topic", F.col("m.node_id").alias("current_id"), F.col("m.label").alias("label"), (F.col("n") - 1).alias("superseded"))


def topics(nodes: DataFrame) -> DataFrame:
    own = F.filter(F.array(*(F.when(F.arrays_overlap(T.words(F.col("label")), F.array(*map(F.lit, ws))), F.lit(t)) for t, ws in TOPICS.items())), lambda t: t.isNotNull())
    tagged = nodes.select("node_id", F.when(F.size(own) == 0, F.array(F.lit("(unclassified)"))).otherwise(own).alias("topics"))
    return tagged.select("node_id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))


def not_in_payload(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes that no single message of their session says already: all words of the label in one message."""
    n = nodes.select("session_id", "node_id", F.size(T.words(F.col("label"))).alias("size"), F.explode(T.words(F.col("label"))).alias("word"))
    m = messages.select("session_id", "turn", F.explode(T.words(F.col("text"))).alias("word"))
    said = n.join(m, ["session_id", "word"]).groupBy("node_id", "turn", "size").agg(F.count("*").alias("shared")).filter("shared = size").select("node_id").distinct()
    return nodes.join(said, "node_id", "left_anti").select("session_id", "node_id")


def preferences_said(messages: DataFrame) -> DataFrame:
    low = F.lower("text")
    return messages.filter((F.col("role") == "user") & (F.length("text") >= 8) & low.rlike(PREFERENCE) & ~low.rlike(NO_PREFERENCE)).select("session_id", "turn")


def longest_runs(events: DataFrame, wanted: Column) -> DataFrame:
    """Each session's longest run of wanted nodes in order, the earliest of equal ones."""
    by = W.partitionBy("session_id").orderBy("valid_from", "node_id")
    marked = events.withColumn("wanted", wanted).withColumn("place", F.row_number().over(by))
    island = F.col("place") - F.row_number().over(W.partitionBy("session_id", "wanted").orderBy("valid_from", "node_id"))
    runs = marked.withColumn("island", island).filter("wanted").groupBy("session_id", "island").agg(F.count("*").alias("length"), F.min("place").alias("start"), F.min_by("node_id", "place").alias("first_id"))
    return runs.groupBy("session_id").agg(F.max(F.struct("length", (-F.col("start")).alias("earlier"), "first_id")).alias("m")).select("session_id", F.col("m.length").alias("length"), F.col("m.first_id").alias("first_id"))


def new_messages(known: DataFrame, resent: DataFrame) -> DataFrame:
    """Messages of a conversation sent again whose text the session has not seen."""
    key = F.substring(F.sha1("text"), 1, 16)
    return resent.withColumn("hash", key).join(known.select("session_id", key.alias("hash")).distinct(), ["session_id", "hash"], "left_anti").select("session_id", "turn", "hash")


def cache_billing(messages: DataFrame, least: int = 64) -> DataFrame:
    """Input cost of sending a conversation anew at every user turn: what was sent before is read at a tenth once it is
    ``least`` tokens long, the rest is written at five quarters.
    """
    by = W.partitionBy("session_id").orderBy("turn")
    m = messages.withColumn("upto", F.sum(T.count_tokens(F.col("text")) + 4).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sent = m.filter("role = 'user'").withColumn("before", F.coalesce(F.lag("upto").over(by), F.lit(0)))
    read = F.when(F.col("before") >= least, F.col("before")).otherwise(0)
    cost = sent.groupBy("session_id").agg(F.count("*").alias("requests"), F.sum("upto").cast("bigint").alias("uncached"), F.round(F.sum(0.1 * read + 1.25 * (F.col("upto") - read)), 4).alias("cached"))
    return cost


def retention(messages: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of a session's distinct words that what was kept of it still has."""
    words = lambda d: d.select("session_id", F.explode(T.words(F.col("text"))).alias("word")).distinct()
    all_words, left = words(messages), words(kept).withColumn("has", F.lit(1))
    j = all_words.join(left, ["session_id", "word"], "left")
    return j.groupBy("session_id").agg(F.count("*").alias("needed"), F.count("has").alias("kept"), F.round(F.count("has") / F.count("*"), 6).alias("retention"))


def recall_at(scored: DataFrame, cases: DataFrame, k: int = 6) -> DataFrame:
    """Cases ``(session_id, expected)`` whose word is in one of the session's best ``k`` nodes."""
    best = W.partitionBy("session_id").orderBy(F.desc("score"), "node_id")
    top = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    hit = cases.join(top, "session_id", "left").groupBy("session_id", "expected").agg(F.max(F.coalesce(F.col("label").contains(F.col("expected")), F.lit(False))).alias("hit"))
    return hit.groupBy("expected").agg(F.count("*").alias("cases"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"))


def label_quality(nodes: DataFrame, longest: int = 20) -> DataFrame:
    n = F.length("label")
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_chars"), F.count_if(n >= longest).alias("truncated"), F.count_distinct("label").alias("distinct_labels"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Overview of each session's graph: open and resolved errors, nodes without links."""
    linked = edges.select(F.col("source_id").alias("node_id")).union(edges.select(F.col("target_id").alias("node_id"))).distinct().withColumn("linked", F.lit(True))
    j = nodes.join(linked, "node_id", "left")
    error = F.col("type") == "error"
    return j.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(error & (F.col("status") == "completed")).alias("resolved"), F.count_if(error & (F.col("status") != "completed")).alias("open"), F.count_if(F.col("linked").isNull()).alias("unlinked"))


def relevant_texts(docs: DataFrame, question: list[str], k: int = 5) -> DataFrame:
    """The ``k`` texts with the most of the question's words, of equal ones the last."""
    shared = F.size(F.array_intersect(F.array(*map(F.lit, question)), T.words(F.col("text"))))
    return docs.select("doc_id", shared.cast("bigint").alias("shared")).filter("shared > 0").orderBy(F.desc("shared"), F.desc("doc_id")).limit(k)


def fences(docs: DataFrame) -> DataFrame:
    """Tabular lines of texts: how many, and the first such line's place, after at most three lines of introduction."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    wide = F.transform(lines, lambda line: F.size(F.split(line, r"\|")) >= 3)
    return docs.select("doc_id", F.size(F.filter(wide, lambda w: w)).cast("bigint").alias("n_table_lines"), F.array_position(F.slice(wide, 1, 4), F.lit(True)).cast("bigint").alias("table_start"))


def flatten_content(content: Column) -> Column:
    """Text of a message's content: a string, or an array of blocks of which those of type text count; malformed blocks are skipped."""
    blocks = F.from_json(content, "array<struct<type string, text string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return F.when(F.ltrim(content).startswith("[{"), F.coalesce(joined, F.lit(""))).otherwise(F.coalesce(content, F.lit("")))
