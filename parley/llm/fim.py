"""Fill-in-the-middle: a text cut at two places of its own and written in another order, so that the middle comes last.

A pandas UDF takes Arrow batches of ids and texts. ``regex`` finds the units (white space, then what follows it up to the
next), whose end offsets go to an array of unsigned integers; two lookups in it slice the text. ``hashlib`` gives the seeds
from a key and the document's id, so a row has the same result wherever and however often it is computed.

The text is rebuilt from output and form alone: no mark occurs in a text that is cut, and no mark begins as another (or
itself) ends, so the first mark of each kind is the one that was written.

Defined cases: a null text is empty; an empty text, and one that holds a mark, stays plain; a null id is seeded like an
empty one; white space at the end of a text is a unit; rows that repeat get equal results; an empty table gives no rows;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive: a run of white space is never gone through twice.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SHAPE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def unit_ends(text: str) -> array:
    return array("I", (m.end() for m in UNIT.finditer(text)))


def seeds(key: str, name: str) -> list[int]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{key}:{name}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def arranged(name: str, text: str, key: str, percent: int, percent_spm: int) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, code points of the prefix, of the middle, output)``."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = seeds(key, name)
    if not text or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < percent_spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    second = output.index(SUFFIX if form == "psm" else PREFIX, len(PREFIX))
    third = output.index(MIDDLE, second + len(PREFIX))
    one, two, middle = output[len(PREFIX) : second], output[second + len(PREFIX) : third], output[third + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def arrange(name: Column, text: Column, key: str = "42", percent: int = 50, percent_spm: int = 80) -> Column:
    """A struct of ``SHAPE``; ``percent`` of the texts are cut, ``percent_spm`` of these with the suffix first."""

    @F.pandas_udf(SHAPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, texts in batches:
            rows = [arranged(i or "", t or "", key, percent, percent_spm) for i, t in zip(names.tolist(), texts.tolist(), strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(F.coalesce(name.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for each row."""
    return df.select(F.col(id_col), arrange(F.col(id_col), F.col(text_col), **how).alias("_f")).select(F.col(id_col), "_f.*")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([rebuilt(o, f) for o, f in zip(outputs.tolist(), forms.tolist(), strict=True)], dtype=object)

    return run(output, form)


def sums(output: Column, form: Column) -> Column:
    """Digests of the output and of the text that is rebuilt from it."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for outputs, forms in batches:
            rows = [(digest(o), digest(rebuilt(o, f))) for o, f in zip(outputs.tolist(), forms.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])

    return run(output, form)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``transform`` with digests in place of the output."""
    made = transform(df, id_col, text_col, **how).withColumn("_s", sums(F.col("output"), F.col("form")))
    return made.select(F.col(id_col), "n", "form", "prefix_chars", "middle_chars", "_s.*")
