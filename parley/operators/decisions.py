"""What decisions are about, whether a later one replaces an earlier one or stands beside it, and changes that texts state.

Decisions meet through their session and topic (an equi-join); slot and scope decide over the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Technologies by topic: a parameter, with a small table as its default.
TOPIC_WORDS = {
    "database": ["postgres", "mysql", "sqlite", "mongo", "dynamodb"], "cache": ["redis", "memcached"], "queue": ["kafka", "rabbitmq", "sqs", "celery"],
    "auth": ["jwt", "oauth", "saml"], "frontend": ["react", "vue", "svelte"], "deploy": ["docker", "k8s", "heroku"],
}
NO_SLOT = "use uses using used the for our each every all and with from into over that this will should now switch move service services".split()
# Words that lead to what a decision covers, verbs that follow it, where it ends, and words in it that tell nothing.
DETERMINERS = ["the", "our", "each", "every", "all"]
VERBS = ["uses", "gets", "stores", "will use", "should use", "is using", "now uses", "runs on", "writes to", "reads from"]
SCOPE_ENDS = "we we'll i i'll let's let use uses it they you because since so and but with to as is are was will should instead rather which that this then now".split()
SCOPE_GENERIC = "service services module modules app apps component components layer system side part one thing things project team example instance code stuff".split()
# How texts state that one thing took another's place: old and new, by the place of the groups.
CHANGES = {
    r"(?i)\b(?:switch(?:ed|ing)?|mov(?:ed?|ing)|migrat(?:ed?|ing)) from ([\w.+#/-]+) to ([\w.+#/-]+)": (1, 2),
    r"(?i)\breplac(?:ed?|ing) ([\w.+#/-]+) with ([\w.+#/-]+)": (1, 2),
    r"(?i)\b(?:use|using|chose|picked) ([\w.+#/-]+) instead of ([\w.+#/-]+)": (2, 1),
}
# Units that make a number a measurement.
MEASURED = r"(?i)(?:^|[^\d.])(\d+(?:\.\d+)?\s*(?:ms|seconds?|minutes?|hours?|%|percent|mb|gb|tb|kb|rpm|rps|req/s))(?:[^A-Za-z0-9]|$)"
# Reports of work in Hindi in Latin script, by kind.
HINGLISH = {
    "task_done": r"(?i)\b([\w./-]+(?: [\w./-]+)?) (?:fix|add|test|deploy|update|merge) kar (?:diya|di|liya)\b",
    "task_todo": r"(?i)\b([\w./-]+(?: [\w./-]+)?) (?:fix|add|test|deploy|update|merge) karna (?:hai|hoga|padega)\b",
    "error": r"(?i)\b([\w./-]+) (?:nahi|nahin|nhi) chal (?:raha|rahi|rahe)\b",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\w.+#/-]+"), lambda w: w != "")


def keywords(label: Column, topics: dict[str, list[str]] = TOPIC_WORDS) -> Column:
    """The technologies that a label names."""
    every = F.array(*(F.lit(w) for own in topics.values() for w in own))
    return F.array_intersect(_words(label), every)


def topics_of(label: Column, topics: dict[str, list[str]] = TOPIC_WORDS) -> Column:
    own = _words(label)
    return F.filter(F.array(*(F.when(F.arrays_overlap(own, F.array(*map(F.lit, ws))), F.lit(t)) for t, ws in topics.items())), lambda t: t.isNotNull())


def slot_words(label: Column, topics: dict[str, list[str]] = TOPIC_WORDS) -> Column:
    """What a label says beside the technology: the purpose."""
    techs = [w for own in topics.values() for w in own]
    return F.array_distinct(F.filter(_words(label), lambda w: (F.length(w) > 2) & ~w.isin(NO_SLOT) & ~w.isin(techs)))


def scope(text: Column) -> Column:
    """The words of what a decision says that it covers; none if it says nothing about that."""

    own = F.filter(F.split(F.lower(text), r"[^\w-]+"), lambda w: w != "")

    def after_for(words: Column, i: Column) -> Column:
        """Of "for the ...", three words; of "for ...ing", what leads to the gerund."""
        led = F.coalesce(F.get(words, i + 1).isin(DETERMINERS), F.lit(False))
        three = F.slice(words, i + 2 + led.cast("int"), 3)
        gerund = F.array_position(F.transform(three, lambda w: w.rlike(r"^[a-z].{2,}ing$")), True).cast("int")
        return F.when(led, three).when(gerund > 0, F.slice(three, 1, gerund)).otherwise(F.slice(three, 1, 0))

    def before_verb(words: Column, i: Column) -> Column:
        """Of "the ... uses", up to three words."""
        verb = lambda k: F.get(words, i + k).isin([v for v in VERBS if " " not in v]) | F.concat_ws(" ", F.get(words, i + k), F.get(words, i + k + 1)).isin([v for v in VERBS if " " in v])
        n = F.when(verb(2), 1).when(verb(3), 2).when(verb(4), 3).otherwise(0)
        return F.slice(words, i + 2, n)

    def told(phrase: Column) -> Column:
        ends = F.array_min(F.filter(F.transform(phrase, lambda w, k: F.when(w.isin(SCOPE_ENDS), k)), lambda k: k.isNotNull()))
        return F.filter(F.slice(phrase, 1, F.coalesce(ends, F.size(phrase))), lambda w: (F.length(w) > 2) & ~w.isin(SCOPE_GENERIC))

    def walked(words: Column) -> Column:
        none = F.slice(words, 1, 0)
        found = F.transform(words, lambda w, i: told(F.when(w == "for", after_for(words, i)).when(w == "the", before_verb(words, i)).otherwise(none)))
        return F.array_distinct(F.flatten(found))

    return F.transform(F.array(own), walked)[0]


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def different_scope(a: Column, b: Column) -> Column:
    """Both say what they cover, and neither is part of the other."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~_within(a, b) & ~_within(b, a)


def verdicts(nodes: DataFrame, topics: dict[str, list[str]] = TOPIC_WORDS) -> DataFrame:
    """``(session_id, new_id, old_id, verdict)`` of decisions in force of one topic, the later one first: it supersedes the
    earlier one in the same slot, or both are contested. Same labels and different scopes leave each other alone."""
    own = nodes.filter("type = 'decision' AND status = 'completed'").select(
        "session_id", "node_id", "valid_from", "label", topics_of(F.col("label"), topics).alias("topics"), keywords(F.col("label"), topics).alias("techs"), slot_words(F.col("label"), topics).alias("slot"), scope(F.col("label")).alias("scope")
    )
    by_topic = own.withColumn("topic", F.explode("topics")).drop("topics")
    a, b = by_topic.alias("a"), by_topic.alias("b")
    later = F.struct("b.valid_from", "b.node_id") < F.struct("a.valid_from", "a.node_id")
    on = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.topic") == F.col("b.topic")) & later & (F.lower("a.label") != F.lower("b.label"))
    shared = F.size(F.array_intersect("a.slot", "b.slot")) / F.least(F.size("a.slot"), F.size("b.slot"))
    same = F.arrays_overlap("a.techs", "b.techs") | (F.size("a.slot") == 0) | (F.size("b.slot") == 0) | (shared >= 0.5)
    pairs = a.join(b, on).filter(~different_scope(F.col("a.scope"), F.col("b.scope")))
    return pairs.select(F.col("a.session_id").alias("session_id"), F.col("a.node_id").alias("new_id"), F.col("b.node_id").alias("old_id"), F.when(same, "supersedes").otherwise("contested").alias("verdict")).distinct()


def stated_changes(messages: DataFrame) -> DataFrame:
    """``(session_id, turn, old, new)``: what texts say took another's place, each pair of a turn once."""
    found = []
    for pattern, (old, new) in CHANGES.items():
        before, after = (F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (old, new))
        found.append(F.zip_with(before, after, lambda x, y: F.struct(_bare(x).alias("old"), _bare(y).alias("new"))))
    rows = messages.select("session_id", "turn", F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("c")).select("session_id", "turn", "c.old", "c.new")
    return rows.filter("length(old) >= 2 AND length(new) >= 2 AND lower(old) <> lower(new)").distinct()


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"[.]+$", "")


def measurements(messages: DataFrame) -> DataFrame:
    """Numbers with a unit that texts give as evidence."""
    return messages.select("session_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MEASURED), F.lit(1)))).alias("evidence"))


def hinglish_facts(messages: DataFrame) -> DataFrame:
    """Work and failures reported in Hindi in Latin script."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))

    rows = F.flatten(F.array(*(of(k, p) for k, p in HINGLISH.items())))
    return messages.select("session_id", "turn", F.explode(F.array_distinct(rows)).alias("f")).select("session_id", "turn", "f.kind", "f.label")
