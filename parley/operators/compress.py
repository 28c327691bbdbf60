"""Compression of prompts and replies: code is kept as it is, prose loses filler, trailing white space and repeats.

A text is cut into code (fenced blocks and inline spans) and prose in one expression; the pieces laid end to end are the
text. Everything stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.weave import rewritten

CODE = r"(?s)```[^\n]*\n.*?```|`[^`\n]+`"
FENCE = r"(?s)```([^\n]*)\n(.*?)```"
# Phrases that are a whole sentence without content, from tables of their parts.
QUALITIES = ["great", "excellent", "good", "wonderful", "fantastic"]
WHOLE = [
    "certainly", "of course", "sure", "absolutely",
    *(f"{lead}{q} question" for q in QUALITIES for lead in ("", "that's a ", "that is a ", "that's an ", "that is an ")),
    *(f"I{be} {mood} to help{tail}" for be in ("'d be", " would be") for mood in ("happy", "glad", "pleased") for tail in ("", " with that", " you with that")),
    *(f"I hope {it} {does}" for it in ("this", "that") for does in ("helps", "answers your question", "clarifies things")),
    *(f"{thanks} {what}" for thanks in ("thank you for", "thanks for") for what in ("asking", "your question", "reaching out")),
]
# Phrases that open such a sentence.
OPEN = [*(f"feel free to {do}" for do in ("ask", "reach out")), *(f"please {ask} if you {have}" for ask in ("let me know", "don't hesitate to ask") for have in ("have", "need"))]
# Leads that say nothing of the sentence that they stand before.
LEADS = ["as an AI", "as an AI language model", "as an AI assistant"]
_any = lambda phrases: "|".join(p.replace(" ", r"\s+") for p in sorted(phrases, key=len, reverse=True))
FILLER = rf"(?i)(^|\n|[.!?]\s)(?:(?:{_any(WHOLE)})[.!](?:\s+|$)|(?:{_any(OPEN)})[^.!?\n]{{0,60}}[.!](?:\s+|$)|(?:{_any(LEADS)}),\s+(?=I\b))+"
# What opens and closes a record of the session inside a prompt.
RECORD_OPEN, RECORD_CLOSE = "<<<SESSION_RECORD>>>", "<<<END_SESSION_RECORD>>>"
INFORMATION = r"[0-9]|https?://|--?[a-z]|[A-Za-z0-9_]+/[A-Za-z0-9_]+|\w\.\w"


def segments(text: Column) -> Column:
    """``array<struct<code boolean, text string>>``: prose and code in turn, empty pieces left out."""
    prose, code = F.split(text, CODE, -1), F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    of = lambda piece, is_code: F.struct(F.lit(is_code).alias("code"), piece.alias("text"))
    both = F.flatten(F.zip_with(prose, code, lambda p, c: F.array(of(p, False), of(c, True))))
    return F.filter(both, lambda s: s["text"].isNotNull() & (s["text"] != ""))


def on_prose(text: Column, rule: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(segments(text), lambda s: F.when(s["code"], s["text"]).otherwise(rule(s["text"]))), "")


def without_filler(text: Column) -> Column:
    """Sentences of the tables above go; a lead goes only where "I" follows."""
    return F.regexp_replace(F.regexp_replace(text, FILLER, "$1"), r"\n{3,}", "\n\n")


def normal_space(text: Column) -> Column:
    """Trailing spaces and tabs of lines and runs of blank lines go; indentation stays."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


#: Strings (triple ones first), lines that are only a comment, and block comments.
CODE_PARTS = (
    r'(?sm)"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""' r"|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|`[^`]*+`|^[ \t]*+(?:#(?!!)|//)[^\n]*+\n?|/\*.*?\*/"
)


def without_comments(code: Column) -> Column:
    """Lines that are only a comment go, and block comments; what stands in a string stays, and so do comments behind code."""
    return rewritten(code, CODE_PARTS, lambda hit: F.when(F.substring(hit, 1, 1).isin('"', "'", "`"), hit).otherwise(""))


def compressed(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``(key, compressed, tokens, saved, strategies)``; a strategy counts where it changed something."""
    source = F.coalesce(F.col(text), F.lit(""))
    # A text is cut once; both rules go over its pieces.
    one = lambda s: F.when(s["code"], s["text"]).otherwise(without_filler(s["text"]))
    two = lambda s: F.when(s["code"], s["text"]).otherwise(normal_space(s["text"]))
    out = df.select(*key, source.alias("source"), F.transform(segments(source), lambda s: F.struct(s["code"].alias("code"), one(s).alias("text"))).alias("pieces"))
    out = out.select(*key, "source", F.array_join(F.transform("pieces", lambda s: s["text"]), "").alias("one"), F.array_join(F.transform("pieces", two), "").alias("two"))
    names = F.filter(F.array(F.when(F.col("one") != F.col("source"), "filler_removal"), F.when(F.col("two") != F.col("one"), "whitespace_normalization")), lambda s: s.isNotNull())
    before, after = T.count_tokens(F.col("source")), T.count_tokens(F.col("two"))
    return out.select(*key, F.col("two").alias("compressed"), after.alias("tokens"), F.greatest(before - after, F.lit(0)).cast("bigint").alias("saved"), F.array_join(names, ",").alias("strategies"))


def trimmed_output(text: Column) -> Column:
    """A reply without an opening pleasantry before its first and a sign-off after its last prose; what tells something
    specific (a number, a path, a flag) stays. An unchanged reply keeps its outer white space."""
    opening = r"(?i)^(?:certainly|of course|sure|absolutely|great question|thanks for asking)[!.,]\s+"
    closing = r"(?i)\s*(?:i hope (?:this|that) helps|let me know if you (?:have|need)[^.!?\n]{0,60}|feel free to ask[^.!?\n]{0,60})[.!]?\s*$"
    cut = lambda t, pattern: F.when(F.regexp_extract(t, f"({pattern})" if not pattern.startswith("(?i)") else "(?i)(" + pattern[4:] + ")", 1).rlike(INFORMATION), t).otherwise(F.regexp_replace(t, pattern, ""))
    short = F.trim(cut(cut(text, opening), closing))
    return F.when((F.length(text) < 20) | (short == F.trim(text)), text).otherwise(short)


def inline_blocks(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Fenced blocks of texts: their place, language, lines and tokens."""
    whole = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(FENCE), F.lit(0))
    rows = df.select(*key, F.posexplode(whole).alias("place", "block"))
    body = F.regexp_extract("block", FENCE, 2)
    return rows.select(*key, F.col("place").cast("bigint"), F.trim(F.regexp_extract("block", FENCE, 1)).alias("language"), (F.size(F.split(body, "\n")) - 1).cast("bigint").alias("n_lines"), T.count_tokens(body).alias("tokens"))


def fenced(record: Column) -> Column:
    """A record between its marks, with marks inside it broken, so that a record can't end itself."""
    inner = F.replace(F.replace(record, F.lit(RECORD_OPEN), F.lit("<<SESSION_RECORD>>")), F.lit(RECORD_CLOSE), F.lit("<<END_SESSION_RECORD>>"))
    return F.concat(F.lit(RECORD_OPEN + "\n"), inner, F.lit("\n" + RECORD_CLOSE))


def scrubbed(text: Column) -> Column:
    """A reply without the marks of records."""
    return F.replace(F.replace(text, F.lit(RECORD_OPEN), F.lit("")), F.lit(RECORD_CLOSE), F.lit(""))


def rendered(messages: DataFrame) -> DataFrame:
    """Turns as the prose a person would read: the text, then one line a tool call (``calls``: array of name and arguments)."""
    lines = F.transform("calls", lambda c: F.concat(F.lit("[called "), c["name"], F.lit(": "), c["arguments"], F.lit("]")))
    parts = F.filter(F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce(lines, F.array().cast("array<string>"))), lambda p: p != "")
    return messages.withColumn("prose", F.array_join(parts, "\n"))


def jsonl_digest(df: DataFrame, key: str, text: str, head: int = 3) -> DataFrame:
    """Of texts of JSON lines: how many lines there are, how many parse, their members in all, and the first ones."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    good = F.filter(lines, lambda x: F.try_parse_json(x).isNotNull())
    members = F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))))
    return df.select(key, F.size(lines).cast("bigint").alias("n_lines"), F.size(good).cast("bigint").alias("n_good"), F.array_join(members, ",").alias("members"), F.array_join(F.slice(lines, 1, head), "\n").alias("head"))


def csv_records(text: Column, separator: str = ",") -> Column:
    """``array<array<string>>``: the records of a table in a text and their cells. A cell that begins with a quotation mark
    goes on to the next single one, line ends and separators included; doubled marks in it are one."""
    sep = re.escape(separator)
    quoted = rf'(?:(?<=[{sep}\n])|(?<![\s\S]))"[^"]*+(?:""[^"]*+)*+"(?=[{sep}\n]|\r\n|(?![\s\S]))'
    # Line ends inside cells are put aside while records are cut.
    aside = rewritten(text, quoted, lambda cell: F.replace(cell, F.lit("\n"), F.lit("\x01")))
    lines = F.filter(F.split(aside, r"\r?\n"), lambda x: F.trim(x) != "")

    def cell(raw: Column) -> Column:
        bare = F.trim(raw)
        inner = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
        return F.replace(F.when((F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"'), inner).otherwise(bare), F.lit("\x01"), F.lit("\n"))

    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(line, F.lit(separator)), F.lit(rf'("[^"]*+(?:""[^"]*+)*+"|[^{sep}]*+){sep}'), F.lit(1)), cell)
    return F.transform(lines, cells)


def csv_digest(df: DataFrame, key: str, text: str, separator: str = ",") -> DataFrame:
    """Of small tables in texts, by column: how many cells have a value, how many are numbers, and their range. The header is
    the first record; a text without rows gives no columns."""
    rows = df.select(key, csv_records(F.coalesce(F.col(text), F.lit("")), separator).alias("records")).filter(F.size("records") > 1)
    cells = rows.select(key, F.col("records")[0].alias("names"), F.explode(F.slice("records", 2, F.size("records"))).alias("cells"))
    cells = cells.select(key, F.posexplode(F.arrays_zip("names", "cells")).alias("place", "c")).select(key, "place", F.col("c.names").alias("name"), F.col("c.cells").alias("cell"))
    value = F.expr("try_cast(regexp_replace(cell, '[$%]', '') AS double)")
    out = cells.filter("name IS NOT NULL").withColumn("value", value).groupBy(key, "place", "name")
    filled = F.coalesce(F.col("cell"), F.lit("")) != ""
    return out.agg(F.count("*").alias("n"), F.count_if(filled).alias("n_filled"), F.count("value").alias("n_numbers"), F.min("value").alias("lowest"), F.max("value").alias("highest")).withColumn("place", F.col("place").cast("bigint"))
