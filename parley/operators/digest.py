"""Digests of pasted files: type, a summary that fits a budget, and what it saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.profile import detect_file_type

SIGNAL = r"(?i)\b(error|exception|fail(ed|ure)?|fatal|traceback|panic|warn(ing)?)\b"
CODE = r"^\s*(import |from \S+ import |def |class |async def |function |export |package |func |public |private |struct |impl |fn |const |[A-Z_]{3,} ?=)"
HEADING = r"^(#{1,6} .+|\d+(\.\d+)*\.? [A-Z].{3,70}|[A-Z][A-Z ]{8,70})$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _ends(lines: Column, head: int, tail: int, keep: Column) -> Column:
    """The first and last lines, those between that are kept, and a note of how many are left out."""
    n, middle = F.size(lines), keep
    note = F.concat(F.lit("["), (n - head - tail - F.size(middle)).cast("string"), F.lit(" lines left out]"))
    return F.when(n <= head + tail, lines).otherwise(F.concat(F.slice(lines, 1, head), middle, F.array(note), F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), tail)))


def _between(lines: Column, head: int, tail: int) -> Column:
    n = F.size(lines)
    return F.when(n > head + tail, F.slice(lines, head + 1, F.greatest(n - head - tail, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def summary(kind: Column, text: Column) -> Column:
    """By type: a table's header and first rows, JSON as it starts, a log's ends and signals, a file's skeleton."""
    lines = _lines(text)
    table = F.concat(F.slice(lines, 1, 11), F.when(F.size(lines) > 11, F.array(F.concat(F.lit("["), (F.size(lines) - 11).cast("string"), F.lit(" more rows]")))).otherwise(F.array().cast("array<string>")))
    log = _ends(lines, 25, 25, F.filter(_between(lines, 25, 25), lambda x: x.rlike(SIGNAL)))
    code = _ends(lines, 30, 10, F.filter(_between(lines, 30, 10), lambda x: x.rlike(CODE)))
    prose = _ends(lines, 20, 10, F.filter(_between(lines, 20, 10), lambda x: x.rlike(HEADING) | x.rlike(SIGNAL)))
    chosen = F.when(kind.isin("csv", "tsv"), table).when(kind == "log", log).when(kind == "code", code).otherwise(prose)
    return F.array_join(chosen, "\n")


def whole_lines(text: Column, budget: int) -> Column:
    """Whole lines while they fit a budget of tokens, and a note of how many are left out; a text that fits as it is."""
    lines = _lines(text)
    kind = "struct<used:bigint,n:int,open:boolean>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        cost = T.count_tokens(line) + 1
        fits = acc["open"] & (acc["used"] + cost <= budget)
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), fits.alias("open")).cast(kind)

    kept = F.aggregate(lines, start, step)["n"]
    note = F.concat(F.lit("["), (F.size(lines) - kept).cast("string"), F.lit(" lines left out]"))
    return F.when(T.count_tokens(text) <= budget, text).otherwise(F.array_join(F.concat(F.slice(lines, 1, kept), F.array(note)), "\n"))


def analyze(files: DataFrame, budget: int = 2000) -> DataFrame:
    """``(name, kind, tokens, digest, digest_tokens, was_digested)`` of files ``(name, content)``.

    A file that fits the budget, or whose digest saves less than three tenths, passes as it is.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    out = files.select("name", detect_file_type(F.coalesce("name", F.lit("")), content).alias("kind"), T.count_tokens(content).alias("tokens"), content.alias("content"))
    out = out.withColumn("short", summary(F.col("kind"), F.col("content")))
    digested = (F.col("tokens") > budget) & (T.count_tokens(F.col("short")) <= 0.7 * F.col("tokens"))
    out = out.withColumn("was_digested", digested).withColumn("digest", F.when(digested, whole_lines(F.col("short"), budget)).otherwise(F.col("content")))
    return out.select("name", "kind", "tokens", "digest", T.count_tokens(F.col("digest")).alias("digest_tokens"), "was_digested")


def json_paths(df: DataFrame, key: str, text: str, depth: int = 4) -> DataFrame:
    """``(key, path, kind)`` of the values of JSON texts, arrays by their first element; malformed texts give no rows."""
    level = df.select(key, F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("v")).filter("v IS NOT NULL")
    found = level.select(key, "path", F.schema_of_variant("v").alias("kind"))
    for _ in range(depth):
        # One lateral step a level: members of objects, first elements of arrays.
        level = level.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("member"), F.col("value")))
        level = level.filter("value IS NOT NULL AND (member IS NOT NULL OR pos = 0)")
        level = level.select(key, F.when(F.col("member").isNotNull(), F.concat("path", F.lit("."), "member")).otherwise(F.concat("path", F.lit("[0]"))).alias("path"), F.col("value").alias("v"))
        found = found.unionByName(level.select(key, "path", F.schema_of_variant("v").alias("kind")))
    return found
