r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn between control strings, reparsed by a deterministic grammar, and compared to
its source. Content that conflicts is escaped, and more thoroughly, until the recovered turns are identical:

* level 0: texts as they are;
* level 1: a backslash before each control string inside a text, after the header ``<<ESC 1>>``;
* level 2: ``\``, ``<`` and ``[`` of every text as ``\b``, ``\l`` and ``\q``, after the header ``<<ESC 2>>``. No control
  string can be left then, nor a backslash before one, so level 2 always succeeds.

Grammar: ``[header] turn*`` with ``turn = "[INST]" text "[/INST]"`` (user) ``| "<s>" text "</s>"`` (assistant) ``|
"<<SYS>>" text "<</SYS>>"`` (system) ``| "<<ROLE " hex ">>" text "<</ROLE>>"`` (any other role); a close is the first one
without a backslash before it.

Defined cases: a null text is empty and a null role is the empty role; rows go by turn, ties by role and then text;
repeated rows are repeated turns; a null conversation id is a conversation; an empty table gives no rows; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE|<<ESC)"
OPEN = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
TURN = (
    r"(?s)\G(?:\[INST\].*?(?<!\\)\[/INST\]|<s>.*?(?<!\\)</s>|<<SYS>>.*?(?<!\\)<</SYS>>|<<ROLE [0-9A-F]*>>.*?(?<!\\)<</ROLE>>)"
)
RUN = 64
HEADER = {0: "", 1: "<<ESC 1>>", 2: "<<ESC 2>>"}


def _opening(role: Column) -> Column:
    other = F.concat(F.lit("<<ROLE "), F.hex(F.encode(role, "UTF-8")), F.lit(">>"))
    return F.coalesce(*(F.when(role == r, F.lit(m)) for r, m in OPEN.items()), other)


def _closing(role: Column) -> Column:
    return F.coalesce(*(F.when(role == r, F.lit(m)) for r, m in CLOSE.items()), F.lit("<</ROLE>>"))


def escape(text: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(text, CONTROL, r"\\$1")
    if level == 2:
        return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\q"))
    return text


def unescape(text: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(text, r"\\" + CONTROL, "$1")
    if level == 2:
        return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\q"), F.lit("[")), F.lit("\\b"), F.lit("\\"))
    return text


def render(turns: Column, level: int) -> Column:
    """The formatted text of ``array<struct<role, text>>``."""
    shown = F.transform(turns, lambda t: F.concat(_opening(t["role"]), escape(t["text"], level), _closing(t["role"])))
    return F.concat(F.lit(HEADER[level]), F.array_join(shown, ""))


def level_of(formatted: Column) -> Column:
    """The level that the header of a formatted text names."""
    return F.when(formatted.startswith(HEADER[1]), 1).when(formatted.startswith(HEADER[2]), 2).otherwise(0)


def parse(formatted: Column, level: int) -> Column:
    """``array<struct<role, text>>`` as the grammar reads it after the level's header, up to the first place that is no turn."""
    body = F.substring(formatted, len(HEADER[level]) + 1, 2**31 - 1)

    def turn(piece: Column) -> Column:
        known = [F.when(piece.startswith(mark), F.lit(role)) for role, mark in OPEN.items()]
        other = F.decode(F.unhex(F.regexp_extract(piece, r"^<<ROLE ([0-9A-F]*)>>", 1)), "UTF-8")
        marks = [F.when(piece.startswith(mark), F.lit(len(mark))) for mark in OPEN.values()]
        start = F.coalesce(*marks, F.instr(piece, ">>") + 1)
        closes = [F.when(piece.startswith(mark), F.lit(len(CLOSE[role]))) for role, mark in OPEN.items()]
        text = piece.substr(start + 1, F.length(piece) - start - F.coalesce(*closes, F.lit(len("<</ROLE>>"))))
        return F.struct(F.coalesce(*known, other).alias("role"), unescape(text, level).alias("text"))

    return F.transform(F.regexp_extract_all(body, F.lit(TURN), F.lit(0)), turn)


def _spans(turns: Column, level: int) -> Column:
    """``array<struct<role, start, size>>``: where each turn's text stands in the formatted text, from 1."""
    sizes = F.transform(
        turns,
        lambda t: F.struct(
            t["role"].alias("role"), F.length(_opening(t["role"])).alias("lead"), F.length(escape(t["text"], level)).alias("size"), F.length(_closing(t["role"])).alias("tail")
        ),
    )
    # Running totals from the start would be quadratic in the turns: sums of runs of RUN turns come first.
    return _let(sizes, lambda own: _placed(own, len(HEADER[level]) + 1))


def _placed(own: Column, first: int) -> Column:
    whole = lambda t: t["lead"] + t["size"] + t["tail"]
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, t: s + whole(t))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / RUN).cast("int")), lambda k: total(F.slice(own, k * RUN + 1, RUN)))

    def placed(runs: Column) -> Column:
        before = F.transform(runs, lambda _, k: F.aggregate(F.slice(runs, 1, k), F.lit(first), lambda s, n: s + n))
        return _let(before, lambda at: F.transform(own, lambda t, i: F.struct(
            t["role"].alias("role"),
            (F.get(at, F.floor(i / RUN).cast("int")) + total(F.slice(own, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + t["lead"]).alias("start"),
            t["size"].alias("size"),
        )))

    return _let(runs, placed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _by_level(level: Column, make: Callable[[int], Column]) -> Column:
    return F.when(level == 0, make(0)).when(level == 1, make(1)).otherwise(make(2))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turns, level, formatted, loss_spans)``: one row a conversation; loss on the assistant's texts only."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_rows = F.sort_array(F.collect_list(row))
    turns = F.transform(sorted_rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = df.groupBy(F.col(conv)).agg(turns.alias("turns"))
    # What most conversations need is made once and referred to; the other levels are made where they are needed.
    out = out.withColumn("plain", render(F.col("turns"), 0))
    identical = lambda text, k: parse(text, k) == F.col("turns")
    escaped = F.when(identical(render(F.col("turns"), 1), 1), 1).otherwise(2)
    out = out.withColumn("level", F.when(identical(F.col("plain"), 0), 0).otherwise(escaped))
    out = out.withColumn("formatted", F.when(F.col("level") == 0, F.col("plain")).when(F.col("level") == 1, render(F.col("turns"), 1)).otherwise(render(F.col("turns"), 2))).drop("plain")
    spans = _by_level(F.col("level"), lambda k: _spans(F.col("turns"), k))
    return out.withColumn("loss_spans", F.filter(spans, lambda s: s["role"] == "assistant"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``parsed`` turns, read from the formatted text alone, and the unescaped ``loss_text`` under the loss spans."""
    level = level_of(F.col("formatted"))
    parsed = _by_level(level, lambda k: parse(F.col("formatted"), k))
    loss = _by_level(level, lambda k: F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"], s["size"]), k)), ""))
    return formatted.withColumn("parsed", parsed).withColumn("loss_text", loss)


def digests(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    back = read_back(format_conversations(df, conv))
    lines = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv,
        F.size("parsed").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
