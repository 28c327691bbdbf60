"""Word sets that contain or overlap each other, found by their rarest words, and the alignment of word lists.

Two sets that share at least ``s`` words of ``n`` have one of the smaller one's ``n - s + 1`` rarest words in common. So a
set is looked up by these only, and a word that every set of a group has pairs nothing unless a set has no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.weave import let


def meeting(sets: DataFrame, group: list[str], looked_up: Column, key: str = "node_id") -> DataFrame:
    """``(group, small, large)``: structs of each set and another that has one of its ``looked_up`` rarest words.

    ``sets`` has ``words``, an array without repeats; all its columns are in the structs.
    """
    own = sets.withColumn("row", F.struct(*(F.col(c) for c in sets.columns)))
    each = own.select(*group, "row", F.explode("words").alias("word"))
    df = each.groupBy(*group, "word").agg(F.count("*").alias("df"))
    ranked = each.join(df, [*group, "word"]).groupBy(*group, "row").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("by_df"))
    rare = ranked.select(*group, F.col("row").alias("small"), F.explode(F.slice("by_df", F.lit(1), F.greatest(looked_up(F.size("by_df")), F.lit(1)))).alias("r")).select(*group, "small", F.col("r.word").alias("word"))
    met = rare.join(each.withColumnRenamed("row", "large"), [*group, "word"]).filter(F.col(f"small.{key}") != F.col(f"large.{key}"))
    return met.select(*group, "small", "large").distinct()


def aligned(a: Column, b: Column) -> Column:
    """``array<struct<i,j>>``: the places of a longest common subsequence of two word lists, counted from 0.

    The table is folded row by row; a cell holds the places of its best alignment, of equal ones that which drops the last
    word of ``b``.
    """
    kind = "array<struct<i:int,j:int>>"
    none = F.array().cast(kind)

    def row(above: Column, x: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            before = F.coalesce(F.get(left, j - 1), none)
            met = F.concat(F.when(j > 0, F.get(above, j - 1)).otherwise(none), F.array(F.struct(x["i"].alias("i"), j.alias("j"))))
            best = F.when(F.get(b, j) == x["w"], met).when(F.size(F.get(above, j)) > F.size(before), F.get(above, j)).otherwise(before)
            return F.concat(left, F.array(best))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast(f"array<{kind}>"), cell)

    first = F.transform(b, lambda _: none)
    table = F.aggregate(F.transform(a, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), first, row)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(table, -1)).otherwise(none)


def swapped_inside(a: Column, b: Column) -> Column:
    """Whether between two words that both lists share each has words of its own: another thing is told."""

    def gaps(pairs: Column) -> Column:
        return F.exists(
            F.zip_with(F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))), F.slice(pairs, 2, F.size(pairs)), lambda p, q: (q["i"] - p["i"] > 1) & (q["j"] - p["j"] > 1)),
            lambda g: F.coalesce(g, F.lit(False)),
        )

    return let(aligned(a, b), gaps)
