"""Relations inferred from labels, and changes to the graph that a caller asks for.

Pairs are found by equi-joins on a session and a word, never by comparing all labels of a session; what is left is
checked in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import sets

# Endings that a file's name may carry in a text that mentions it.
INFLECTIONS = ["s", "es", "d", "ed", "r", "er", "ers", "ing", "ment", "ql"]
# Words of a decision's label that say nothing about its subject.
DECISION_STOPS = "use using the a an for to in on with and or of is are we our this that it be have will".split()
# Statuses in which something is still in force.
LIVE_DECISION = "completed"


def spaced(text: Column) -> Column:
    """Lower case, underscores and hyphens as spaces."""
    return F.regexp_replace(F.lower(text), r"[_\-]+", " ")


def stem(path: Column) -> Column:
    """A file's base name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")


def _forms(text: Column) -> Column:
    """Every word of a text, as it is and without an ending that it carries."""
    shorter = [lambda w, e=e: F.when(w.endswith(e), w.substr(F.lit(1), F.length(w) - len(e))) for e in INFLECTIONS]
    each = F.transform(_words(text), lambda w: F.array(w, *(f(w) for f in shorter)))
    return F.array_distinct(F.filter(F.flatten(each), lambda w: w.isNotNull() & (w != "")))


def names_file(mentions: DataFrame, files: DataFrame, name: Column = None) -> DataFrame:
    """``(session_id, source_id, file_id)``: nodes whose label has a file's name as a whole word, with an ending perhaps.

    ``mentions`` and ``files`` have ``session_id, node_id, label``; ``name`` is what a mention has to have (the stem).
    """
    own = files.select("session_id", F.col("node_id").alias("file_id"), F.trim(spaced(stem(F.col("label")) if name is None else name)).alias("name"))
    own = own.filter(F.length("name") > 2).withColumn("word", F.get(_words(F.col("name")), F.lit(0)))
    said = mentions.select("session_id", F.col("node_id").alias("source_id"), spaced(F.col("label")).alias("text"))
    said = said.withColumn("word", F.explode(_forms(F.col("text"))))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("name"), F.lit(rf"\E(?:{'|'.join(INFLECTIONS)})?(?![a-z0-9])"))
    return said.join(own, ["session_id", "word"]).filter(F.rlike("text", quoted)).select("session_id", "source_id", "file_id").distinct()


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind)


def file_links(nodes: DataFrame) -> DataFrame:
    """Tasks IMPLEMENT and decisions are RELATED_TO the files that they name."""
    files = of_type(nodes, "file")
    tasks = names_file(of_type(nodes, "task"), files).withColumn("relation", F.lit("IMPLEMENTS"))
    return tasks.unionAll(names_file(of_type(nodes, "decision"), files).withColumn("relation", F.lit("RELATED_TO")))


def error_files(nodes: DataFrame) -> DataFrame:
    """Errors whose label has a file's base name."""
    files = of_type(nodes, "file").select("session_id", F.col("node_id").alias("file_id"), base_name(F.col("label")).alias("name")).withColumn("word", F.get(_words(F.lower("name")), F.lit(0)))
    errors = of_type(nodes, "error").select("session_id", F.col("node_id").alias("error_id"), "label", F.explode(F.array_distinct(_words(F.lower("label")))).alias("word"))
    return errors.join(files, ["session_id", "word"]).filter(F.col("label").contains(F.col("name"))).select("session_id", "error_id", "file_id").distinct()


def meaningful(label: Column) -> Column:
    """Words of over three letters, without outer punctuation."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(label), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.regexp_replace(w, r"^[.,!?:;()\[\]]+|[.,!?:;()\[\]]+$", "")))


def depends_on(nodes: DataFrame) -> DataFrame:
    """Decisions, tasks and files DEPEND ON a dependency that is a word of their label."""
    deps = of_type(nodes, "dependency").filter(F.length("label") > 1).select("session_id", F.col("node_id").alias("dependency_id"), F.lower(F.trim("label")).alias("word"))
    others = nodes.filter(F.col("type").isin("decision", "task", "file")).select("session_id", F.col("node_id").alias("source_id"), F.explode(meaningful(F.col("label"))).alias("word"))
    return others.join(deps, ["session_id", "word"]).select("session_id", "source_id", "dependency_id").distinct()


def implements(nodes: DataFrame) -> DataFrame:
    """Endpoints with the files that share a part of the path, and with the tasks whose label has the route."""
    ends = of_type(nodes, "endpoint").select("session_id", F.col("node_id").alias("endpoint_id"), F.lower("label").alias("route"))
    parts = ends.withColumn("word", F.explode(F.array_distinct(_split(F.col("route")))))
    files = of_type(nodes, "file").select("session_id", F.col("node_id").alias("source_id"), F.explode(F.array_distinct(F.filter(_split(F.lower("label")), lambda w: F.length(w) > 3))).alias("word"))
    by_part = files.join(parts, ["session_id", "word"]).select("session_id", "source_id", "endpoint_id")
    # The route's parts are in the task's label, too: its last one is the key.
    tasks = of_type(nodes, "task").select("session_id", F.col("node_id").alias("source_id"), F.lower("label").alias("text")).withColumn("word", F.explode(F.array_distinct(_split(F.col("text")))))
    last = ends.withColumn("word", F.element_at(_split(F.col("route")), -1))
    by_route = tasks.join(last, ["session_id", "word"]).filter(F.col("text").contains(F.col("route"))).select("session_id", "source_id", "endpoint_id")
    return by_part.unionAll(by_route).distinct()


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"[/\s]+"), lambda w: w != "")


def overlapping_decisions(nodes: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of decisions in force that share most of their words, the later one first: what it would supersede where no
    topic is known."""
    words = F.array_distinct(F.filter(F.split(F.lower("label"), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(DECISION_STOPS)))
    own = of_type(nodes, "decision").filter(F.col("status") == LIVE_DECISION).select("session_id", "node_id", "valid_from", "label", words.alias("words"))
    met = sets.meeting(own, ["session_id"], lambda n: n - F.ceil(least * n).cast("int") + 1)
    # Either may be the larger one; the smaller by number of words is looked up.
    a, b = (F.struct(f"{side}.valid_from", f"{side}.node_id") for side in ("small", "large"))
    shared = F.size(F.array_intersect("small.words", "large.words")).cast("bigint")
    pairs = met.filter(F.col("small.label") != F.col("large.label")).withColumn("shared", shared)
    pairs = pairs.filter(F.col("shared") / F.greatest(F.size("small.words"), F.size("large.words")) >= least)
    pick = lambda later: F.when(a > b if later else a < b, F.col("small.node_id")).otherwise(F.col("large.node_id"))
    return pairs.select("session_id", pick(True).alias("new_id"), pick(False).alias("old_id"), "shared").distinct()


def resolved(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(session_id, name, node_id)``: the decision that a bare name means, the one so called or else the shortest that has
    the name as whole words; null if there is none."""
    key = F.trim(F.regexp_replace(F.lower("label"), r"\s+", " "))
    own = of_type(nodes, "decision").select("session_id", "node_id", key.alias("key"))
    asked = names.select("session_id", "name", F.trim(F.regexp_replace(F.lower("name"), r"\s+", " ")).alias("wanted")).distinct()
    first = asked.withColumn("word", F.get(F.split("wanted", r"[^a-z0-9]+"), F.lit(0)))
    worded = own.withColumn("word", F.explode(F.array_distinct(F.split("key", r"[^a-z0-9]+"))))
    whole = F.rlike("key", F.concat(F.lit(r"\b\Q"), F.col("wanted"), F.lit(r"\E\b")))
    hits = first.join(worded, ["session_id", "word"]).filter(whole)
    best = hits.groupBy("session_id", "name").agg(F.min_by("node_id", F.struct((F.col("key") != F.col("wanted")).alias("part"), F.length("key").alias("size"), F.col("node_id").alias("id"))).alias("node_id"))
    return asked.select("session_id", "name").join(best, ["session_id", "name"], "left")


def with_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edges with new ones; of one source, target and type the first weight stays, and no node is linked to itself."""
    key = ["session_id", "source_id", "target_id", "type"]
    all_ = edges.select(*key, "weight", F.lit(0).alias("later")).unionAll(new.select(*key, "weight", F.lit(1).alias("later"))).filter("source_id <> target_id")
    # Plain numbers are aggregated in place; a smallest pair would have to be sorted for.
    of = lambda k: F.min(F.when(F.col("later") == k, F.col("weight"))).alias(f"w{k}")
    missing = F.min(F.when(F.col("weight").isNull(), F.col("later"))).alias("missing")
    one = all_.groupBy(*key).agg(F.min("later").alias("first"), missing, of(0), of(1))
    weight = F.when(F.col("missing") == F.col("first"), F.lit(None)).when(F.col("first") == 0, F.col("w0")).otherwise(F.col("w1"))
    return one.select(*key, weight.alias("weight"))


def invalidated(nodes: DataFrame, label: str | None = None, node_id: int | None = None, reason: str = "", now: int | Column = 0) -> DataFrame:
    """The nodes with decisions in force withdrawn, by id or by whole words of the label (three characters at least)."""
    if node_id is None and len((label or "").strip()) < 3:
        raise ValueError("a label of three characters or a node id is needed")
    low = (label or "").lower().strip()
    pattern = r"\b" + "".join(c if c.isalnum() or c == "_" else "\\" + c for c in low) + r"\b"
    hit = F.col("node_id") == node_id if node_id is not None else F.lower("label").rlike(pattern)
    own = (F.col("type") == "decision") & (F.col("status") == LIVE_DECISION) & hit
    clock = now if isinstance(now, Column) else F.lit(now)
    summary = F.lit(f"Invalidated: {reason[:100]}" if reason else "Explicitly invalidated")
    return nodes.withColumns({
        "status": F.when(own, "invalidated").otherwise(F.col("status")),
        "valid_until": F.when(own, clock).otherwise(F.col("valid_until")),
        "summary": F.when(own, summary).otherwise(F.col("summary") if "summary" in nodes.columns else F.lit(None).cast("string")),
    })


def restated_errors(errors: DataFrame) -> DataFrame:
    """Errors of a session that another one of the same class says more exactly: its label has all their words and more."""
    kind = F.regexp_extract("label", r"\b([A-Z]\w*(?:Error|Exception|Timeout)|[45]\d\d)\b", 1)
    own = errors.select("session_id", "node_id", kind.alias("kind"), T.words(F.col("label"), 1).alias("words")).filter("kind <> ''")
    met = sets.meeting(own, ["session_id", "kind"], lambda n: F.lit(1))
    whole = (F.size("small.words") < F.size("large.words")) & (F.size(F.array_except("small.words", "large.words")) == 0)
    return met.filter(whole).groupBy("session_id", F.col("small.node_id").alias("node_id")).agg(F.min("large.node_id").alias("stated_by"))


def contained_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks whose words, counted as often as they occur, are all in another task of the session with more words."""
    every = F.filter(F.split(F.lower("label"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    own = tasks.select("session_id", "node_id", every.alias("all"), F.array_distinct(every).alias("words"))
    met = sets.meeting(own, ["session_id"], lambda n: F.lit(1))
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    inside = F.forall("small.words", lambda w: times(F.col("small.all"), w) <= times(F.col("large.all"), w))
    found = met.filter((F.size("small.all") < F.size("large.all")) & inside)
    return found.select("session_id", F.col("small.node_id").alias("small_id"), F.col("large.node_id").alias("large_id"))


def merged_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(session_id, place, label)``: the first list, then what the second adds, each label once, in order."""
    both = reduce(DataFrame.unionAll, (d.select("session_id", "label", F.lit(k).alias("part"), F.col("place")) for k, d in enumerate((first, second))))
    once = both.groupBy("session_id", "label").agg(F.min(F.struct("part", "place")).alias("at"))
    by = W.partitionBy("session_id").orderBy("at", "label")
    return once.select("session_id", F.row_number().over(by).cast("bigint").alias("place"), "label")
