"""Facts from messages: files, endpoints, errors, dependencies, tasks, decisions; merging and evaluating them.

Each family is a set of our own patterns; facts come out in long form ``(session_id, turn, kind, label)``. Patterns run in
the JVM, a message at a time, and only what they find is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.settle import settled

# Patterns by kind; the first group is the label.
PATTERNS = {
    "file": r"(?i)\b((?:[\w.-]+/)*[\w-]+\.(?:py|js|ts|tsx|go|rs|java|sql|md|json|yaml|yml|toml|sh|css|html))\b",
    "endpoint": r"\b((?:GET|POST|PUT|PATCH|DELETE) /[\w/{}:.-]*)",
    "error": r"\b([A-Z]\w*(?:Error|Exception|Timeout|Warning))\b",
    "status": r"(?i)\b(?:http|status)(?: code)? ([45]\d\d)\b",
    "dependency": r"(?i)\b(?:pip|npm|cargo|brew|go) (?:install|add|get) ([\w@./-]+(?:==[\w.]+)?)",
    "environment": r"(?i)\b((?:python|node|java|postgres|redis|ubuntu|go|rust) v?\d+(?:\.\d+)*)\b",
    "task_done": r"(?i)\b(?:i|we|just|have|has)(?: have| has| just)? (?:added|fixed|implemented|finished|completed|created|updated|removed|wrote|migrated) ((?:the |a |an )?(?:[\w /-]|\.(?=\w)){3,60})",
    "task_todo": r"(?i)\b(?:need to|needs to|have to|todo:?|next(?: step)?:?|should|must|remember to) ((?:add|fix|implement|finish|create|update|remove|write|migrate|test|refactor|document|deploy)\b(?:[\w /-]|\.(?=\w)){2,60})",
    "decision": r"(?i)\b(?:decided (?:to use|on|to)|we will use|we'll use|let's use|going with|switch(?:ed|ing)? to|chose|settled on) ((?:[\w +#/-]|\.(?=\w)){2,50})",
    "goal": r"(?i)\b(?:goal is to|i want to|we want to|trying to|help me) ((?:[\w /-]|\.(?=\w)){4,80})",
}
PACKS = {
    "ops": {"incident": r"(?i)\b(sev ?[0-4]|outage|rollback|incident \d+)\b"},
    "product": {"metric": r"(?i)\b((?:conversion|retention|churn|activation)(?: rate)?)\b"},
    "research": {"result": r"(?i)\b((?:f1|accuracy|recall|precision|bleu|rouge)[ :=]+(?:of )?\d+(?:\.\d+)?%?)"},
}


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"[ .,;:!?]+$", "")))


#: What a text must have at all before a family of patterns is tried on it.
NEEDS = {
    "file": "[A-Za-z0-9_-]\\.[A-Za-z]", "endpoint": "/", "error": "Error|Exception|Timeout|Warning", "status": "[45][0-9][0-9]", "dependency": "(?i)install|add|get", "environment": "[0-9]",
    "task_done": "(?i)(?:add|fix|implement|finish|complet|creat|updat|remov|migrat)e?d|wrote", "task_todo": "(?i)need|have to|todo|next|should|must|remember", "decision": "(?i)decided|will use|'ll use|let's use|going with|switch|chose|settled", "goal": "(?i)goal|want to|trying|help me",
}


def facts(messages: DataFrame, packs: list[str] | None = None, longest: int | None = None, recurring: bool = False) -> DataFrame:
    """Facts of every message; with ``longest``, longer texts count with their first and last halves only. Where texts
    are ``recurring``, patterns run on each text once, and messages meet what it gave by an equi-join on the text.
    """
    patterns = dict(PATTERNS)
    for pack in packs or []:
        patterns |= PACKS[pack]
    if longest is not None:
        half = longest // 2
        short = F.when(F.length("text") <= longest, F.col("text")).otherwise(F.concat(F.substring("text", 1, half), F.lit("\n"), F.expr(f"right(text, {half})")))
        messages = messages.withColumn("text", short)
    text = F.col("text")
    # Clauses that negate or only suppose make no task or decision: they are dropped before those families look. They are
    # cut once a text, and only if one of these families may find something.
    cut = F.array_join(F.filter(F.split(text, r"(?<=[.!?\n])"), lambda c: ~c.rlike(r"(?i)\b(?:not|never|didn't|don't|won't|if we|would|could|might)\b") & ~c.rlike(r"\?\s*$")), "")
    prose = {"task_done", "task_todo", "decision", "goal"}

    none = F.array().cast("array<struct<kind:string,label:string>>")

    def rows_of(kind: str, source: Column) -> Column:
        own = F.transform(_found(source, patterns[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))
        return F.when(source.rlike(NEEDS[kind]), own).otherwise(none) if kind in NEEDS else own

    maybe = text.rlike("|".join(NEEDS[k] for k in sorted(prose)))
    said = F.transform(F.array(cut), lambda clauses: F.flatten(F.array(*(rows_of(k, clauses) for k in patterns if k in prose))))[0]
    rows = F.concat(F.flatten(F.array(*(rows_of(k, text) for k in patterns if k not in prose))), F.when(maybe, said).otherwise(none))
    if recurring:
        # By an aggregate, as what only uses a grouping key is computed below it, on every message.
        known = messages.groupBy("text").agg(F.first("text").alias("said")).select(F.col("text").alias("key"), F.col("said").alias("text")).select("key", rows.alias("rows")).withColumnRenamed("key", "text")
        messages, rows = messages.select("session_id", "turn", "role", "text").join(known, "text"), F.col("rows")
    # Spark looks for empty arrays before it explodes one, which computes them twice; explode_outer does not.
    out = messages.select("session_id", "turn", "role", F.explode_outer(rows).alias("f")).select("session_id", "turn", "role", "f.kind", "f.label").filter("label <> ''")
    return out.filter("kind <> 'goal' OR (role = 'user' AND turn <= 3)").drop("role")


def session_facts(messages: DataFrame, packs: list[str] | None = None, more: DataFrame | None = None) -> DataFrame:
    """Facts of a session once each, with the first and the last turn, and how often; TODOs that were done are gone.

    ``more`` are messages whose texts recur. Facts are settled in the shared folder: they are looked at several times, and
    patterns would run on every message each time.
    """
    key = F.lower(F.regexp_replace("label", r"^(?:the|a|an) ", ""))
    f = facts(messages, packs) if more is None else facts(messages, packs).unionByName(facts(more, packs, recurring=True))
    f = f.withColumn("norm", F.substring(key, 1, 60))
    one = f.groupBy("session_id", "kind", "norm").agg(F.min_by("label", "turn").alias("label"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))
    one = settled(one)
    stem = lambda c: F.regexp_replace(c, r"^\w+ (?:the |a |an )?", "")
    done = one.filter("kind = 'task_done'").select("session_id", F.col("norm").alias("what")).distinct()
    todo = one.filter("kind = 'task_todo'").withColumn("what", stem(F.col("norm"))).join(done, ["session_id", "what"], "left_anti").drop("what")
    return one.filter("kind <> 'task_todo'").unionByName(todo).drop("norm")


def drop_shadowed_paths(found: DataFrame) -> DataFrame:
    """Bare file names of a session that a longer path ends with are dropped."""
    files = found.filter("kind = 'file'")
    full = files.filter(F.col("label").contains("/")).select("session_id", F.regexp_extract("label", r"([^/]+)$", 1).alias("label")).distinct()
    return found.filter("kind <> 'file'").unionByName(files.join(full, ["session_id", "label"], "left_anti"))


def merge_tiers(heuristic: DataFrame, model: DataFrame) -> DataFrame:
    """Facts of two extractors: 0.95 where both have it, 0.80 the model's alone, 0.65 the heuristic's."""
    key = ["session_id", "kind", "norm"]
    norm = lambda d, c: d.select("session_id", "kind", F.substring(F.lower("label"), 1, 60).alias("norm"), F.col("label").alias(c)).dropDuplicates(key)
    j = norm(heuristic, "h").join(norm(model, "m"), key, "full_outer")
    confidence = F.when(F.col("h").isNotNull() & F.col("m").isNotNull(), 0.95).when(F.col("m").isNotNull(), 0.80).otherwise(0.65)
    return j.select("session_id", "kind", F.coalesce("m", "h").alias("label"), confidence.alias("confidence"))


def evaluate(found: DataFrame, truth: DataFrame, least: float = 0.6) -> DataFrame:
    """Precision, recall and F1 by kind. A found label covers a true one of its session with 60 % of its words.

    Candidates meet through shared words, so only pairs that can cover are formed.
    """
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    # A label that is there twice is one label, else its words would count twice.
    truth, found = (d.select("session_id", "kind", "label").distinct() for d in (truth, found))
    t = truth.withColumn("true_id", F.concat_ws("|", "session_id", "kind", "label")).withColumn("words", split("label"))
    f = found.withColumn("found_id", F.concat_ws("|", "session_id", "kind", "label")).withColumn("words", split("label"))
    tw = t.select("session_id", "kind", "true_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    fw = f.select("session_id", "kind", "found_id", F.explode("words").alias("word"))
    pairs = tw.join(fw, ["session_id", "kind", "word"]).groupBy("kind", "true_id", "found_id", "n").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least * F.col("n"))
    hit = pairs.groupBy("kind").agg(F.count_distinct("true_id").alias("covered"), F.count_distinct("found_id").alias("right"))
    n = t.groupBy("kind").agg(F.count_distinct("true_id").alias("n_true")).join(f.groupBy("kind").agg(F.count_distinct("found_id").alias("n_found")), "kind", "full_outer").join(hit, "kind", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    p = F.when(zero("n_found") > 0, zero("right") / zero("n_found")).otherwise(0.0)
    r = F.when(zero("n_true") > 0, zero("covered") / zero("n_true")).otherwise(0.0)
    out = n.select("kind", zero("n_true").alias("n_true"), zero("n_found").alias("n_found"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))
    return out.withColumn("f1", F.round(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0), 6))


def validate(candidates: DataFrame, least: float = 0.65) -> DataFrame:
    """Quality gate of ``(id, kind, label, role)``: an additive score from length, words and what the kind asks for."""
    n, w = F.length("label"), F.size(F.filter(F.split("label", " "), lambda x: x != ""))
    score = F.lit(0.5) + F.when(n < 8, -0.2).when(n < 15, -0.05).otherwise(0.0) + F.when(n > 20, 0.1).otherwise(0.0)
    score = score + F.when(w == 1, -0.1).when(w.between(2, 8), 0.1).when(w > 15, -0.1).otherwise(0.0)
    kind = F.when(F.col("kind") == "file", F.when(F.col("label").rlike(r"\.\w{1,5}$"), 0.25).otherwise(0.0) + F.when(F.col("label").contains("/"), 0.1).otherwise(0.0))
    kind = kind.when(F.col("kind") == "decision", F.when(F.lower("label").rlike("^(use|adopt|drop|migrate)"), 0.15).otherwise(-0.1))
    kind = kind.when(F.col("kind") == "task", F.when(F.lower("label").rlike("^(fix|add|test|review|migrate)"), 0.12).otherwise(-0.2))
    kind = kind.when(F.col("kind") == "error", 0.15).when(F.col("kind") == "goal", F.when(n < 20, -0.2).otherwise(0.15)).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + kind))
    return candidates.withColumn("score", F.round(total, 4)).withColumn("accepted", F.col("score") >= least)
