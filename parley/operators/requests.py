"""Rules around a request and what is kept of it: labels' types, keys, sizes, breakpoints, headings, stored blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import sets

# Names under which a domain's pack is asked for; coding is the default.
DOMAINS = {"coding": "coding", "code": "coding", "dev": "coding", "ops": "ops", "sre": "ops", "incident": "ops", "product": "product", "pm": "product", "research": "research", "ml": "research"}
# Words in the reason of a change, by what set it off, the first that fits.
TRIGGERS = {"performance": r"(?i)\b(slow|latency|timeouts?|memory|throughput)\b", "failure": r"(?i)\b(bugs?|broke|crash\w*|errors?|fail\w*)\b", "cost": r"(?i)\b(cost|price|expensive|budget)\b", "security": r"(?i)\b(security|leak\w*|vulnerab\w*)\b"}
PROBLEM_HEADING = r"(?i)^\s*(?:#+\s*)?(?:known |open )?(?:issues?|problems?|bugs?|errors?|failures?)\s*:?\s*$"
FIXED_HEADING = r"(?i)^\s*(?:#+\s*)?(?:fixed|resolved|done|completed)\s*:?\s*$"
HEADING = r"^\s*(?:#+\s*\S.*|[A-Za-z][\w ]{0,40}:)\s*$"
BULLET = r"^\s*(?:[-*+]|\d+[.)])\s+(.+)$"
LISTING = r"^\s*(?:[-*+]|\d+[.)])\s+|^\s*[\w./-]+/[\w.-]+\s*$"
FILLER = "the a an and or of to in on for with is are be it this that i we you my our please can could would do does".split()


def corrected_type(kind: Column, label: Column) -> Column:
    """A label's type by its shape: a path of at most two words is a file, a pinned package a dependency, a route an endpoint."""
    words = F.size(F.filter(F.split(F.trim(label), r"\s+"), lambda w: w != ""))
    path = (words <= 2) & label.rlike(r"[\w-]+/[\w./-]+\.\w{1,5}$|^[\w-]+\.(?:py|js|ts|go|rs|java|sql|md|json|ya?ml|toml)$")
    return F.when(label.rlike(r"^(?:GET|POST|PUT|PATCH|DELETE) /"), "endpoint").when(label.rlike(r"^[\w.-]+==[\w.]+$"), "dependency").when(path, "file").otherwise(kind)


def net_layers(requests: DataFrame) -> DataFrame:
    """The layers' savings with what the proxy itself added: what was saved in all, less all layers."""
    known = F.aggregate(F.map_values("layers"), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return requests.select("request_id", known.alias("by_layers"), (F.col("input_original") - F.col("input_sent") - known).alias("added_by_proxy"))


def cache_context(session: Column, parameters: list[Column], digest: Column) -> Column:
    """What an answer depends on beside its prompt: the conversation and the parameters that shape answers."""
    return F.substring(F.sha2(F.concat_ws("|", session, *(F.coalesce(p.cast("string"), F.lit("-")) for p in parameters), digest), 256), 1, 16)


def limit_key(key: Column, address: Column) -> Column:
    """Whose bucket a request takes from: its key's digest, else its address."""
    return F.coalesce(F.concat(F.lit("key:"), F.substring(F.sha2(key, 256), 1, 16)), F.concat(F.lit("ip:"), address), F.lit("ip:unknown"))


def breakpoints(messages: DataFrame) -> DataFrame:
    """The turn of each session that is marked as the end of the cached prefix: the last but one."""
    by = W.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("from_end", F.row_number().over(by)).filter("from_end = 2").select("session_id", "turn")


def transition_line(before: Column, after: Column, delta: Column, least: float = 0.05) -> Column:
    """One line of a change; the confidence is told where it moved by a twentieth or more."""
    moved = F.concat(F.lit(" (confidence "), F.when(delta > 0, "+").otherwise("-"), F.round(F.abs(delta) * 100).cast("int").cast("string"), F.lit("%)"))
    return F.concat(before, F.lit(" -> "), after, F.when(F.abs(delta) >= least, moved).otherwise(""))


def domain_pack(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in DOMAINS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit("coding"))


def trigger(reason: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in TRIGGERS.items():
        out = out.when(reason.rlike(pattern), F.lit(name))
    return out.otherwise("preference")


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("place", "line"))


def listings(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` lines that are items of a list or bare paths."""
    marked = text_lines(df, key, text).withColumn("listed", F.col("line").rlike(LISTING))
    island = F.col("place") - F.row_number().over(W.partitionBy(key).orderBy("place"))
    runs = marked.filter("listed").withColumn("island", island).groupBy(key, "island").agg(F.min("place").cast("bigint").alias("first_line"), F.count("*").alias("n_lines"))
    return runs.filter(F.col("n_lines") >= least).drop("island")


def problem_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """Items under a heading of problems, and under one of what was fixed; a heading counts up to the next one."""
    kind = F.when(F.col("line").rlike(PROBLEM_HEADING), "open").when(F.col("line").rlike(FIXED_HEADING), "resolved").when(F.col("line").rlike(HEADING) & ~F.col("line").rlike(BULLET), "other")
    under = F.last(kind, ignorenulls=True).over(W.partitionBy(key).orderBy("place"))
    items = text_lines(df, key, text).withColumn("under", under).withColumn("item", F.trim(F.regexp_extract("line", BULLET, 1)))
    return items.filter(F.col("under").isin("open", "resolved") & (F.col("item") != "")).select(key, F.col("place").cast("bigint"), "under", "item")


def entry_size(prompt: Column, response: Column) -> Column:
    """Bytes that a cache entry counts for: the response, the start of the prompt, and what every entry has."""
    return (F.octet_length(response) + F.octet_length(F.substring(prompt, 1, 500)) + 700).cast("bigint")


def from_blobs(blobs: DataFrame, schema: str) -> DataFrame:
    """Rows of sessions that were stored as one JSON text each; malformed ones give none."""
    return blobs.select("session_id", F.explode(F.from_json("blob", f"array<struct<{schema}>>")).alias("r")).select("session_id", "r.*")


def preference_key(text: Column, least: int = 3) -> Column:
    """The first three significant words."""
    own = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: (F.length(w) >= least) & ~w.isin(FILLER))
    return F.array_join(F.slice(own, 1, 3), "-")


def same_preference(a: Column, b: Column) -> Column:
    """Two preferences of one head word, or of words that overlap by six tenths of the smaller."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(FILLER)))
    shared = F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.least(F.size(words(a)), F.size(words(b))), F.lit(1))
    return (F.get(words(a), F.lit(0)) == F.get(words(b), F.lit(0))) | (shared >= 0.6)


def conflicting_errors(errors: DataFrame) -> DataFrame:
    """Pairs of errors of a session with a word in common that are not one: their named classes are disjoint."""
    classes = F.array_distinct(F.regexp_extract_all("label", F.lit(r"\b([A-Z]\w*(?:Error|Exception))\b"), F.lit(1)))
    own = errors.select("session_id", "node_id", classes.alias("classes"), F.explode(T.words(F.col("label"), 4)).alias("word"))
    a, b = own.alias("a"), own.alias("b")
    on = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.node_id") < F.col("b.node_id"))
    pairs = a.join(b, on).filter((F.size("a.classes") > 0) & (F.size("b.classes") > 0) & ~F.arrays_overlap("a.classes", "b.classes"))
    return pairs.select(F.col("a.session_id").alias("session_id"), F.col("a.node_id").alias("first_id"), F.col("b.node_id").alias("second_id")).distinct()


def subsumed(facts: DataFrame, least: float = 0.75) -> DataFrame:
    """Facts of a session whose words another, longer one has for the most part; not those where a word between shared
    ones is another."""
    own = facts.select("session_id", "node_id", T.words(F.col("label")).alias("words"))
    met = sets.meeting(own, ["session_id"], lambda n: n - F.ceil(least * n).cast("int") + 1)
    small, large = F.col("small.words"), F.col("large.words")
    most = (F.size(small) < F.size(large)) & (F.size(F.array_intersect(small, large)) >= least * F.size(small))
    found = met.filter(most & ~sets.swapped_inside(small, large))
    return found.groupBy("session_id", F.col("small.node_id").alias("node_id")).agg(F.min("large.node_id").alias("by"))


def latest_first(nodes: DataFrame) -> DataFrame:
    """The order of a resume: by turn, those without a turn by their last change, then importance, then arrival."""
    turn = F.coalesce("turn", F.lit(0))
    by = W.partitionBy("session_id").orderBy(F.desc(turn), F.desc(F.when(turn == 0, F.col("updated_at"))), F.desc("importance"), "node_id")
    return nodes.select("session_id", F.row_number().over(by).cast("bigint").alias("place"), "node_id")


def prefix_digest(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """``(session_id, split_turn, digest)``: a digest of what stands before each session's cut."""
    before = messages.join(cuts, "session_id").filter("turn < split_turn")
    own = F.sort_array(F.collect_list(F.struct("turn", F.sha1(F.concat("role", F.lit(":"), "text")).alias("h"))))
    digests = before.groupBy("session_id").agg(F.sha1(F.array_join(F.transform(own, lambda x: x["h"]), "")).alias("digest"))
    return cuts.join(digests, "session_id", "left").select("session_id", "split_turn", F.coalesce("digest", F.lit("")).alias("digest"))


def frozen_cuts(messages: DataFrame, stored: DataFrame, fresh: DataFrame, limit: int) -> DataFrame:
    """Each session's cut: the stored one while what stands before it is unchanged and what is kept fits; else a fresh one."""
    now = prefix_digest(messages, stored.select("session_id", "split_turn")).withColumnRenamed("digest", "current")
    kept = messages.join(stored.select("session_id", "split_turn"), "session_id").filter("turn >= split_turn").groupBy("session_id").agg(F.sum(T.count_tokens(F.col("text")) + T.count_tokens(F.col("role")) + 4).alias("kept"))
    old = stored.join(now.select("session_id", "current"), "session_id").join(kept, "session_id", "left").select("session_id", F.col("split_turn").alias("old_turn"), ((F.col("current") == F.col("digest")) & (F.coalesce("kept", F.lit(0)) <= limit)).alias("good"))
    joined = fresh.select("session_id", F.col("split_turn").alias("new_turn")).join(old, "session_id", "left")
    return joined.select("session_id", F.when(F.col("good"), F.col("old_turn")).otherwise(F.col("new_turn")).alias("split_turn"), F.coalesce("good", F.lit(False)).alias("reused"))


def canvas(nodes: DataFrame, width: int = 260, height: int = 80, columns: int = 4) -> DataFrame:
    """Each session's nodes as cards of a canvas, in rows of ``columns``, as one JSON text."""
    by = W.partitionBy("session_id").orderBy("node_id")
    placed = nodes.withColumn("k", (F.row_number().over(by) - 1).cast("bigint"))
    card = F.struct(
        F.col("k"), F.to_json(F.struct(F.col("node_id").cast("string").alias("id"), F.lit("text").alias("type"), F.col("label").alias("text"), (F.col("k") % columns * (width + 40)).alias("x"), (F.floor(F.col("k") / columns) * (height + 40)).alias("y"))).alias("card")
    )
    return placed.groupBy("session_id").agg(F.sort_array(F.collect_list(card)).alias("cards")).select("session_id", F.concat(F.lit('{"nodes":['), F.array_join(F.transform("cards", lambda c: c["card"]), ","), F.lit("]}")).alias("json"))
