"""What tool calls tell: files that were edited and errors that came back, from messages as JSON of four shapes.

A message is parsed to a VARIANT, and each step goes one level down by a lateral explode: calls beside the text, calls and
results among the blocks, function calls of parts, and results of the role "tool". Arguments are an object or a JSON text of
one. What does not parse, or is of another type than it should be, gives no rows and hides nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.mentions import reports_error

# Members whose value is a path, words of tools that only read.
PATH_KEYS = ["path", "file", "file_path", "filepath", "filename", "target_file", "notebook_path"]
READING = r"(?i)(?:^|[^a-z])(?:read|view|list|ls|search|grep|glob|find|fetch|get|open|cat|show)(?:[^a-z]|$)"
LONGEST = 160


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _exploded(df: DataFrame, v: Column, keep: list[str]) -> DataFrame:
    """One row for each member or element of ``v``: ``member`` (null in arrays), ``value``."""
    parts = df.sparkSession.tvf.variant_explode(v.outer()).select(F.col("key").alias("member"), F.col("value"))
    return df.lateralJoin(parts).select(*keep, "member", "value")


def _calls(messages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, name, arguments)`` of the calls of all shapes that do not only read."""
    beside = _exploded(messages.withColumn("v", _get(F.col("message"), "$.tool_calls", "variant")), F.col("v"), keys)
    own = F.coalesce(F.try_parse_json(_get(F.col("value"), "$.function.arguments", "string")), _get(F.col("value"), "$.function.arguments", "variant"))
    beside = beside.select(*keys, _get(F.col("value"), "$.function.name", "string").alias("name"), own.alias("arguments"))
    blocks = _exploded(messages.withColumn("v", _get(F.col("message"), "$.content", "variant")), F.col("v"), keys)
    used = blocks.filter(_get(F.col("value"), "$.type", "string") == "tool_use").select(*keys, _get(F.col("value"), "$.name", "string").alias("name"), _get(F.col("value"), "$.input", "variant").alias("arguments"))
    called = blocks.select(*keys, _get(F.col("value"), "$.functionCall.name", "string").alias("name"), _get(F.col("value"), "$.functionCall.args", "variant").alias("arguments"))
    spaced = F.regexp_replace("name", "([a-z])([A-Z])", "$1_$2")
    return beside.unionByName(used).unionByName(called).filter(F.col("name").isNotNull() & ~spaced.rlike(READING))


def edited_files(messages: DataFrame, keys: list[str], depth: int = 4) -> DataFrame:
    """``(keys, label)``: paths among the arguments of calls that do not only read, up to ``depth`` levels down."""
    level = _calls(messages, keys).select(*keys, F.col("arguments").alias("v"))
    found = None
    for _ in range(depth):
        level = _exploded(level, F.col("v"), keys)
        here = level.filter(F.lower("member").isin(PATH_KEYS) & (F.schema_of_variant("value") == "STRING")).select(*keys, F.col("value").cast("string").alias("label"))
        found = here if found is None else found.unionByName(here)
        level = level.select(*keys, F.col("value").alias("v"))
    return found.filter(F.trim("label") != "").distinct()


def _texts(v: Column) -> Column:
    """The text of a block's content: a string, a list of strings and text blocks, or one such block."""
    parts = _get(v, "$", "array<variant>")
    each = F.transform(parts, lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", p.cast("string")), _get(p, "$.text", "string"), F.lit("")))
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", v.cast("string")), F.array_join(each, "\n"), _get(v, "$.text", "string"), F.lit(""))


def error_label(text: Column) -> Column:
    """The first line that reads like an error, else the first that is not empty."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.coalesce(F.get(F.filter(lines, reports_error), F.lit(0)), F.get(lines, F.lit(0)))), 1, LONGEST)


def tool_errors(messages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, label)``: results marked as errors, and results of the role "tool" that begin with an error."""
    blocks = _exploded(messages.withColumn("v", _get(F.col("message"), "$.content", "variant")), F.col("v"), keys)
    marked = blocks.filter((_get(F.col("value"), "$.type", "string") == "tool_result") & _get(F.col("value"), "$.is_error", "boolean"))
    marked = marked.select(*keys, error_label(_texts(_get(F.col("value"), "$.content", "variant"))).alias("label"))
    said = messages.filter(_get(F.col("message"), "$.role", "string") == "tool").select(*keys, _texts(_get(F.col("message"), "$.content", "variant")).alias("t"))
    first = F.get(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    plain = said.filter(reports_error(first)).select(*keys, error_label(F.col("t")).alias("label"))
    return marked.unionByName(plain).filter("label <> ''").distinct()


def signals(raw: DataFrame, keys: list[str], json: str = "raw") -> DataFrame:
    """``(keys, kind, label)`` of messages as JSON texts."""
    messages = raw.select(*keys, F.try_parse_json(F.col(json)).alias("message")).filter("message IS NOT NULL")
    files = edited_files(messages, keys).withColumn("kind", F.lit("file"))
    return files.unionByName(tool_errors(messages, keys).withColumn("kind", F.lit("error"))).select(*keys, "kind", "label")


def whole_objects(text: Column) -> Column:
    """The complete objects at the outermost level of a reply that may break off: brackets are counted outside of strings."""
    kind = "struct<at:int,depth:int,quoted:boolean,escaped:boolean,start:int,out:array<struct<start:int,stop:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(-1).alias("start"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")).cast(kind)

    def step(s: Column, c: Column) -> Column:
        escape = s["quoted"] & ~s["escaped"] & (c == "\\")
        quote = (c == '"') & ~s["escaped"] & (s["quoted"] | (s["depth"] > 0))
        opens, closes = ~s["quoted"] & (c == "{"), ~s["quoted"] & (c == "}") & (s["depth"] > 0)
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        ends = closes & (depth == 0)
        return F.struct(
            (s["at"] + 1).alias("at"), depth.alias("depth"), (s["quoted"] != quote).alias("quoted"), escape.alias("escaped"), F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["start"]).alias("start"),
            F.when(ends, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), (s["at"] + 1).alias("stop"))))).otherwise(s["out"]).alias("out"),
        ).cast(kind)

    spans = F.aggregate(F.split(text, ""), start, step, lambda s: s["out"])
    objects = F.transform(spans, lambda p: text.substr(p["start"] + 1, p["stop"] - p["start"]))
    return F.filter(objects, lambda o: F.try_parse_json(o).isNotNull())
