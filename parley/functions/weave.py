"""Texts taken apart at what a pattern finds and put together again, with each find rewritten by an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def rewritten(text: Column, pattern: str, rule: Callable[[Column], Column]) -> Column:
    """``text`` with ``rule(find)`` in place of every find of ``pattern`` (which must not find empty strings)."""

    def woven(text: Column) -> Column:
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        # split() gives one piece more than there are finds.
        return F.array_join(F.zip_with(between, found, lambda piece, hit: F.concat(piece, F.coalesce(F.when(hit.isNotNull(), rule(hit)), F.lit("")))), "")

    return let(text, woven)
