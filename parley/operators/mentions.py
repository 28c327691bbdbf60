"""Mentions: what a text only shows (code, tables, listings, quotations) is blanked, and every other place stays where it is.

Spans of all kinds are united; what they cover becomes spaces, line ends stay, so a place in the masked text is the same
place in the original. Lines of a code block that report an error stay readable, and so does a quotation that names one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.weave import let, rewritten

BLOCK = r"(?s)```[^\n]*+\n(?:.*?```|.*+)|~~~[^\n]*+\n(?:.*?~~~|.*+)"
# What lines of logs begin with where they report an error, and how an exception's name ends.
REPORTS = ["Traceback", "FAILED", "ERROR", "FATAL", "panic:", "fatal:", "error:", "Error:", "error[", "npm ERR", "Uncaught"]
NAMES = ["Error", "Exception"]
QUOTATION = '["“][^"“”\n]++["”]'
LONGEST_QUOTATION, LEAST_LISTING = 300, 3


def reports_error(line: Column) -> Column:
    """Whether a line of a log tells of an error: by what it begins with, or as an exception's name and a colon."""
    own = F.ltrim(F.regexp_replace(line, r"^\s+", ""))
    named = F.substring_index(F.substring_index(own, ":", 1), " ", 1)
    starts = F.exists(F.array(*map(F.lit, REPORTS)), lambda r: F.startswith(own, r))
    return starts | (own.contains(":") & (F.length(named) == F.length(F.substring_index(own, ":", 1))) & F.exists(F.array(*map(F.lit, NAMES)), lambda n: F.endswith(named, n)))


def names_error(text: Column) -> Column:
    """Whether a text has an exception's name, a status of 400 to 599, or a code such as ECONNREFUSED."""
    words = F.split(text, "[^A-Za-z0-9_]+")
    status = lambda w: (F.length(w) == 3) & (w >= "400") & (w <= "599")
    return F.exists(words, lambda w: F.exists(F.array(*map(F.lit, NAMES)), lambda n: F.endswith(w, n)) | status(w) | ((F.length(w) > 4) & w.startswith("E") & (w == F.upper(w)) & ~w.rlike("[0-9_]")))


def table_row(line: Column) -> Column:
    own = F.btrim(line, F.lit(" \t"))
    return (F.length(own) > 1) & own.startswith("|") & own.endswith("|")


def numbered(line: Column) -> Column:
    """Whether a line is shown with its number: up to six digits, then a colon, a tab or a bar."""
    own = F.ltrim(line, F.lit(" \t"))
    n = F.length(own) - F.length(F.ltrim(own, F.lit("0123456789")))
    rest = own.substr(n + 1, F.lit(3))
    return n.between(1, 6) & (rest.startswith(":") | rest.startswith("\t") | (rest == " | "))


def finds(text: Column, pattern: str) -> Column:
    """``array<struct<start, stop, text>>`` of what a pattern finds, places counted from 0."""

    def laid(text: Column) -> Column:
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pieces = F.filter(F.zip_with(between, found, lambda b, f: F.struct(F.length(b).alias("gap"), f.alias("text"))), lambda p: p["text"].isNotNull())
        none = F.array().cast("array<struct<start:int,stop:int,text:string>>")

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["gap"]
            stop = start + F.length(p["text"])
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), p["text"].alias("text")))).alias("out"))

        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return let(text, laid)


def blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def _by_lines(text: Column) -> Column:
    """Rows of tables, and numbered lines where three or more follow each other."""

    def masked(lines: Column) -> Column:
        marks = F.transform(lines, numbered)

        def in_run(marks: Column, i: Column) -> Column:
            at = lambda k: F.coalesce(F.get(marks, i + k), F.lit(False))
            return at(0) & ((at(1) & at(2)) | (at(-1) & at(1)) | (at(-1) & at(-2)))

        return let(marks, lambda marks: F.array_join(F.transform(lines, lambda x, i: F.when(table_row(x) | in_run(marks, i), F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "\n"))

    return let(F.split(text, "\n", -1), masked)


def mask(text: Column) -> Column:
    """``text`` at equal length with its mentions blanked; null stays null."""
    block = lambda hit: F.array_join(F.transform(F.split(hit, "\n", -1), lambda x: F.when(reports_error(x), x).otherwise(F.repeat(F.lit(" "), F.length(x)))), "\n")
    quotation = lambda hit: F.when((F.length(hit) - 2 > LONGEST_QUOTATION) | names_error(hit), hit).otherwise(F.repeat(F.lit(" "), F.length(hit)))
    out = let(text, lambda t: F.when(t.rlike("```|~~~"), rewritten(t, BLOCK, block)).otherwise(t))
    out = let(out, lambda t: F.when(t.rlike(r"(?m)^[ \t]*(?:[|]|[0-9])"), _by_lines(t)).otherwise(t))
    return let(out, lambda t: F.when(t.rlike('["“]'), rewritten(t, QUOTATION, quotation)).otherwise(t))
