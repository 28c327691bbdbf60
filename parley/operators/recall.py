"""Recall: an index of archived turns that is appended to, passages grown around what was asked, and notes of dropped spans."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.weave import let
from parley.operators.vocabulary import distinctive

BUCKETS = 64
LEAST = 3  # characters of a term
LEAD = 200  # characters that are shown before the first term of a line that is too long

QUANTITY = r"(?i)\d+(?:\.\d+)?\s*(?:%|percent|ms|milliseconds?|s\b|seconds?|minutes?|hours?|days?|weeks?|[kmgt]b\b|bytes?|users?|requests?|rows?|times|x\b)|[<>]=?\s*\d|\bunder \d|\bat (?:most|least) \d"
CONSTRAINT = r"(?i)\b(?:must|never|always|cannot|can't|only|required?|forbidden|has to|have to|should not|shouldn't|do not|don't|no more than|at most|at least|unless)\b"
FILLER = r"(?i)^(?:ok(?:ay)?|sure|thanks?|thank you|great|yes|no|sounds good|let me|i'll|i will|here(?:'s| is))\b"
LEAST_SENTENCE, LONGEST_SENTENCE = 20, 160


# --- index


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(archive: DataFrame) -> DataFrame:
    """``(term, session_id, msg_hash, seq, bucket)`` of turns ``(session_id, msg_hash, seq, content)``: each term of a turn once."""
    terms = archive.select("session_id", "msg_hash", "seq", F.explode(T.words(F.col("content"), LEAST)).alias("term"))
    return terms.withColumn("bucket", _bucket(F.col("term")))


def append(archive: DataFrame, path: str) -> None:
    """Add the turns that the index at ``path`` does not have. Turns are written last: if that fails, the next call adds the
    postings again, and a search counts a turn's term once."""
    spark = archive.sparkSession
    fresh = archive.select("session_id", "msg_hash", "seq", "content")
    try:
        known = spark.read.parquet(f"{path}/turns").select("session_id", "msg_hash")
        known.schema
    except Exception as e:  # the first call finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        fresh = fresh.join(known, ["session_id", "msg_hash"], "left_anti")
    postings(fresh).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    fresh.write.mode("append").parquet(f"{path}/turns")


def searched(spark, path: str, questions: DataFrame, k: int = 5) -> DataFrame:
    """``(question_id, session_id, rank, seq, msg_hash, matched)``: a session's turns by how many of the question's terms they
    have, then newest. ``questions`` has ``question_id, session_id, question``. Only the folders of asked terms are read."""
    asked = questions.select("question_id", "session_id", F.explode(T.words(F.col("question"), LEAST)).alias("term")).withColumn("bucket", _bucket(F.col("term")))
    buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())
    own = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets)) if buckets else spark.read.parquet(f"{path}/postings").limit(0)
    met = own.select("term", "session_id", "msg_hash", "seq").join(asked.drop("bucket"), ["session_id", "term"])
    matched = met.groupBy("question_id", "session_id", "msg_hash", "seq").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    by = W.partitionBy("question_id", "session_id").orderBy(F.desc(F.size("terms")), F.desc("seq"), "msg_hash")
    ranked = matched.withColumn("rank", F.row_number().over(by).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.select("question_id", "session_id", "rank", "seq", "msg_hash", "terms", F.size("terms").cast("bigint").alias("matched"))


# --- passages


def excerpt(content: Column, terms: Column, budget: int) -> Column:
    """The lines around the one with most terms, grown a line after and a line before in turn while the budget of tokens
    lasts. A text that fits is whole; of a first line that does not fit, what is around its first term."""
    kind = "struct<lo:int,hi:int,used:bigint>"

    def grown(given: Column) -> Column:
        rows, terms = given["rows"], given["terms"]
        hits = lambda line: F.size(F.filter(terms, lambda t: F.lower(line).contains(t)))
        scores = F.transform(rows, hits)
        best = let(scores, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))
        return let(best, lambda at: around(rows, terms, at))

    def around(rows: Column, terms: Column, best: Column) -> Column:
        first = T.count_tokens(F.get(rows, best))

        def step(s: Column, k: Column) -> Column:
            at = F.when(k % 2 == 1, s["hi"] + 1).otherwise(s["lo"] - 1)
            cost = T.count_tokens(F.get(rows, at)) + 1
            ok = (at >= 0) & (at < F.size(rows)) & (s["used"] + cost <= budget)
            return F.struct(F.when(ok, F.least(s["lo"], at)).otherwise(s["lo"]).alias("lo"), F.when(ok, F.greatest(s["hi"], at)).otherwise(s["hi"]).alias("hi"), F.when(ok, s["used"] + cost).otherwise(s["used"]).alias("used")).cast(kind)

        window = F.aggregate(F.sequence(F.lit(1), 2 * F.size(rows)), F.struct(best.alias("lo"), best.alias("hi"), first.alias("used")).cast(kind), step)
        shown = F.transform(F.array(window), lambda w: F.concat(F.when(w["lo"] > 0, "…\n").otherwise(""), F.array_join(F.slice(rows, w["lo"] + 1, w["hi"] - w["lo"] + 1), "\n"), F.when(w["hi"] < F.size(rows) - 1, "\n…").otherwise("")))[0]
        line = F.get(rows, best)
        places = F.filter(F.transform(terms, lambda t: F.call_function("locate", t, F.lower(line))), lambda p: p > 0)
        at = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - 1 - LEAD, F.lit(0))
        return F.when(first > budget, F.concat(F.lit("…"), line.substr(at + 1, F.lit(3 * budget)), F.lit("…"))).otherwise(shown)

    given = F.struct(F.split(content, "\n", -1).alias("rows"), terms.alias("terms"))
    return let(content, lambda c: F.when(T.count_tokens(c) <= budget, c).otherwise(let(given, grown)))


def recalled(hits: DataFrame, archive: DataFrame, sent: DataFrame, budget: int) -> DataFrame:
    """``(question_id, session_id, seq, excerpt)``: of each question's hits the first that is a clear match (a term that pins a
    passage, or two terms) and is not among what is sent anyway (``session_id, payload``)."""
    clear = F.exists("terms", distinctive) | (F.size("terms") >= 2)
    rows = hits.filter(clear).join(archive.select("session_id", "msg_hash", "content"), ["session_id", "msg_hash"]).join(sent, "session_id", "left")
    rows = rows.withColumn("excerpt", excerpt(F.col("content"), F.col("terms"), budget)).filter("excerpt <> '' AND NOT contains(coalesce(payload, ''), excerpt)")
    return rows.groupBy("question_id", "session_id").agg(F.min_by(F.struct("seq", "excerpt"), "rank").alias("m")).select("question_id", "session_id", "m.seq", "m.excerpt")


# --- notes of dropped spans


def sentences(messages: DataFrame) -> DataFrame:
    """``(session_id, turn, place, sentence)`` of messages of persons and assistants."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n+|;\s+"), lambda s: F.length(s) > 0)
    rows = messages.filter("role <> 'tool'").select("session_id", "turn", F.posexplode(parts).alias("place", "s"))
    sentence = F.regexp_replace(F.regexp_replace("s", r"\s+", " "), r"^[ .!?]+|[ .!?]+$", "")
    return rows.select("session_id", "turn", "place", sentence.alias("sentence")).filter((F.length("sentence") >= LEAST_SENTENCE) & ~F.col("sentence").rlike(FILLER))


def span_notes(dropped: DataFrame, known: DataFrame, limit: int = 4, covered: float = 0.6, restated: float = 0.7) -> DataFrame:
    """``(session_id, place, sentence)``: what dropped turns say that must not be lost: sentences with a quantity, then those
    with a constraint, the newest first; none that a known label (``session_id, label``) covers, and no point twice.

    A session's sentences are sorted by Spark and go by one after the other; what was kept is held, not what goes by.
    """
    weight = F.when(F.col("sentence").rlike(QUANTITY), 2).when(F.col("sentence").rlike(CONSTRAINT), 1)
    told = sentences(dropped).withColumn("weight", weight).withColumn("words", T.words(F.col("sentence"), LEAST)).filter("weight IS NOT NULL AND size(words) >= 4")
    own = told.withColumn("word", F.explode("words"))
    labels = known.select("session_id", F.col("label"), F.explode(T.words(F.col("label"), LEAST)).alias("word")).distinct()
    shared = own.join(labels, ["session_id", "word"]).groupBy("session_id", "turn", "place", "label", F.size("words").alias("n")).agg(F.count("*").alias("m"))
    gone = shared.filter(F.col("m") >= covered * F.col("n")).select("session_id", "turn", "place").distinct()
    rest = told.join(gone, ["session_id", "turn", "place"], "left_anti").select("session_id", "turn", "place", "sentence", "weight", "words")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, kept, at = None, [], defaultdict(list)
        for pdf in batches:
            take = []
            for own, words in zip(pdf["session_id"].tolist(), pdf["words"].tolist(), strict=True):
                if own != session:
                    session, kept, at = own, [], defaultdict(list)
                mine = set(words)
                met: dict[int, int] = defaultdict(int)
                for w in mine:
                    for k in at[w]:
                        met[k] += 1
                fresh = not any(n >= restated * len(mine) for n in met.values())
                take.append(fresh)
                if fresh:
                    kept.append(mine)
                    for w in mine:
                        at[w].append(len(kept) - 1)
            yield pdf.loc[take, ["session_id", "turn", "place", "sentence", "weight"]]

    kind = dropped.schema["session_id"].dataType.simpleString()
    ordered = rest.repartition("session_id").sortWithinPartitions("session_id", "turn", "place")
    kept = ordered.mapInPandas(once, f"session_id {kind}, turn bigint, place int, sentence string, weight int")
    by = W.partitionBy("session_id").orderBy(F.desc("weight"), F.desc("turn"), F.desc("place"))
    best = kept.withColumn("rank", F.row_number().over(by).cast("bigint")).filter(F.col("rank") <= limit)
    cut = F.when(F.length("sentence") > LONGEST_SENTENCE, F.concat(F.substring("sentence", 1, LONGEST_SENTENCE - 1), F.lit("…"))).otherwise(F.col("sentence"))
    return best.select("session_id", F.col("rank").alias("place"), cut.alias("sentence"))
