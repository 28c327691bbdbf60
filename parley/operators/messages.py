"""Order-dependent operators over the messages of a session: budgets, windows, repeats, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T

PER_MESSAGE, PER_SESSION = 4, 2
# Requests to override instructions, as a guard looks for them.
INJECTIONS = [r"ignore (all |any )?(previous|prior|above) (instructions|rules)", r"disregard (the )?(system|previous) (prompt|message)", r"you are now (in )?(developer|admin|dan) mode", r"reveal (your|the) (system )?prompt", r"</?(system|instructions?)>"]
ASSENT = r"^(yes|yep|sure|ok(ay)?|agreed|sounds good|good idea|great|done)\b"


def tokens(messages: DataFrame) -> DataFrame:
    """Tokens of each message: its text, its role and a constant."""
    return messages.withColumn("tokens", T.count_tokens(F.col("text")) + T.count_tokens(F.col("role")) + PER_MESSAGE)


def session_tokens(messages: DataFrame, budget: int) -> DataFrame:
    out = tokens(messages).groupBy("session_id").agg(F.count("*").alias("n_messages"), (F.sum("tokens") + PER_SESSION).alias("tokens"))
    return out.withColumn("needs_windowing", F.col("tokens") > budget)


def split_point(messages: DataFrame, budget: int, protect: int = 2) -> DataFrame:
    """Where a session is cut: the first user turn from which the rest fits the budget, at the latest ``protect`` from its end."""
    by = W.partitionBy("session_id").orderBy(F.desc("turn"))
    m = tokens(messages).withColumn("tail", F.sum("tokens").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("from_end", F.row_number().over(by))
    fits = (F.col("role") == "user") & (F.col("tail") <= budget)
    return m.groupBy("session_id").agg(F.min(F.when(fits, F.col("turn"))).alias("first_fitting"), F.min(F.when(F.col("from_end") <= protect, F.col("turn"))).alias("protected")).select("session_id", F.least(F.coalesce("first_fitting", "protected"), "protected").alias("split_turn"))


def windowed(messages: DataFrame, budget: int, protect: int = 2) -> DataFrame:
    """System turns and the tail from the split on, for sessions over the budget; others whole."""
    over = session_tokens(messages, budget).select("session_id", "needs_windowing")
    m = messages.join(over, "session_id").join(split_point(messages, budget, protect), "session_id")
    keep = ~F.col("needs_windowing") | (F.col("role") == "system") | (F.col("turn") >= F.col("split_turn"))
    return m.filter(keep).select("session_id", "turn", "role", "text")


def collapse_repeated_lines(df: DataFrame, key: str, text: str, least: int = 3, longer_than: int = 40) -> DataFrame:
    """Runs of ``least`` or more equal lines longer than ``longer_than`` characters, as one line and a note.

    The text is folded line by line in one expression: no explode, no shuffle.
    """
    kind = "struct<done:array<string>,line:string,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"), F.lit(0).alias("n"))

    def flush(acc: Column) -> Column:
        again = F.when((acc["n"] >= least) & (F.length(F.trim(acc["line"])) > longer_than), F.array(acc["line"], F.concat(F.lit("[previous line repeated "), (acc["n"] - 1).cast("string"), F.lit(" more times]"))))
        return F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.coalesce(again, F.array_repeat(acc["line"], acc["n"]))))

    def step(acc: Column, line: Column) -> Column:
        same = (acc["n"] > 0) & (acc["line"] == line)
        return F.when(same, F.struct(acc["done"].alias("done"), acc["line"].alias("line"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(flush(acc).alias("done"), line.alias("line"), F.lit(1).alias("n"))).cast(kind)

    out = F.aggregate(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), start.cast(kind), step, flush)
    return df.select(key, F.array_join(out, "\n").alias("collapsed"))


def repeated_replies(messages: DataFrame, longer_than: int = 200, least: int = 3) -> DataFrame:
    """Assistant replies equal to an earlier one of their session, white space and case aside, and the turn of that."""
    size = F.count("*").over(W.partitionBy("session_id"))
    m = messages.withColumn("size", size).filter((F.col("size") >= least) & (F.col("role") == "assistant") & (F.length("text") > longer_than))
    m = m.withColumn("folded", F.sha1(F.lower(F.regexp_replace("text", r"\s+", " "))))
    first = F.min("turn").over(W.partitionBy("session_id", "folded"))
    return m.withColumn("first_turn", first).filter("turn > first_turn").select("session_id", "turn", "first_turn")


def last_query(messages: DataFrame, least: int = 4) -> DataFrame:
    """The latest user turn with at least ``least`` words."""
    long_enough = messages.filter((F.col("role") == "user") & (F.size(F.split(F.trim("text"), r"\s+")) >= least))
    return long_enough.groupBy("session_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def guard_requests(messages: DataFrame) -> DataFrame:
    """User turns after the last assistant turn that try to override instructions."""
    answered = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("session_id"))
    m = messages.withColumn("answered", answered).filter((F.col("role") == "user") & (F.col("turn") > F.coalesce("answered", F.lit(-1))))
    hits = F.filter(F.array(*(F.when(F.lower("text").rlike(p), k) for k, p in enumerate(INJECTIONS))), lambda x: x.isNotNull())
    return m.select("session_id", "turn", F.size(hits).cast("bigint").alias("n_patterns"), (F.size(hits) > 0).alias("blocked"))


def accepted_proposals(messages: DataFrame) -> DataFrame:
    by = W.partitionBy("session_id").orderBy("turn")
    m = messages.withColumn("next_role", F.lead("role").over(by)).withColumn("next_text", F.lead("text").over(by))
    return m.filter((F.col("role") == "user") & (F.col("next_role") == "assistant") & F.lower(F.trim("next_text")).rlike(ASSENT)).select("session_id", "turn")


def archive_rows(messages: DataFrame, longest: int | None = None) -> DataFrame:
    """What the archive stores: each text of a session once, at its first turn; whole, or its first ``longest`` characters."""
    key = F.substring(F.sha1(F.concat(F.col("role"), F.lit(":"), F.col("text"))), 1, 20)
    first = F.row_number().over(W.partitionBy("session_id", "msg_hash").orderBy("turn"))
    m = messages.withColumn("msg_hash", key).withColumn("place", first).filter("place = 1")
    return m.select("session_id", "msg_hash", F.col("turn").alias("seq"), "role", (F.col("text") if longest is None else F.substring("text", 1, longest)).alias("content"))


def archive_search(archive: DataFrame, terms: list[str], k: int = 5, pool: int = 40) -> DataFrame:
    """Turns by the number of distinct terms they contain, then newest: the best ``k`` of each session's ``pool``."""
    matched = F.size(F.filter(F.array(*map(F.lit, sorted({t.lower() for t in terms if len(t) > 2}))), lambda t: F.lower("content").contains(t))).cast("bigint")
    w = W.partitionBy("session_id").orderBy(F.desc("matched"), F.desc("seq"), "msg_hash")
    ranked = archive.withColumn("matched", matched).filter("matched > 0").withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= min(k, pool)).select("session_id", "rank", "seq", "matched")


def head_tail(df: DataFrame, key: str, text: str, head: int = 5, tail: int = 5) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    n = F.size(lines)
    cut = F.concat(F.slice(lines, 1, head), F.array(F.concat(F.lit("["), (n - head - tail).cast("string"), F.lit(" lines omitted]"))), F.slice(lines, n - tail + 1, tail))
    return df.select(key, n.cast("bigint").alias("n_lines"), F.array_join(F.when(n > head + tail, cut).otherwise(lines), "\n").alias("shown"))


def truncate_to_budget(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """Whole lines up to the first that would exceed the budget of tokens."""
    kind = "struct<used:bigint,open:boolean,n:bigint>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("open"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, line: Column) -> Column:
        cost = T.count_tokens(line)
        fits = acc["open"] & (acc["used"] + cost <= budget)
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"), fits.alias("open"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n")).cast(kind)

    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = df.select(key, lines.alias("lines"), F.aggregate(lines, start.cast(kind), step).alias("r"))
    return out.select(key, F.col("r.n").alias("n_lines"), F.col("r.used").alias("tokens"), F.md5(F.array_join(F.slice("lines", 1, F.col("r.n").cast("int")), "\n")).alias("kept_md5"))


def path_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """Paths named in texts, grouped by directory."""
    paths = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+)"), F.lit(1))
    p = df.select(key, F.explode(F.array_distinct(paths)).alias("path"))
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return p.groupBy(directory.alias("directory")).agg(F.count_distinct("path").alias("n_paths"), F.count("*").alias("n_mentions"))


def inject_context(messages: DataFrame, context: DataFrame) -> DataFrame:
    """The last user turn of each session with its context (``session_id, block``) appended."""
    last = messages.filter("role = 'user'").groupBy("session_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    return last.join(context, "session_id", "left").select("session_id", "turn", F.when(F.col("block").isNotNull(), F.concat("text", F.lit("\n\n"), "block")).otherwise(F.col("text")).alias("text"))
