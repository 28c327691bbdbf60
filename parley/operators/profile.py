"""Profiles of tables and files: types, statistics, breakdowns, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# File types by extension.
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "xlsx": "excel", "pdf": "pdf", "html": "xml", "xml": "xml", "log": "log", "py": "code", "js": "code", "md": "text", "txt": "text", "yaml": "yaml", "toml": "toml"}


def detect_file_type(name: Column, content: Column) -> Column:
    """By extension, else by the first 512 characters."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for ext, kind in EXTENSIONS.items():
        out = out.when(extension == ext, kind)
    head = F.substring(F.ltrim(content), 1, 512)
    first = F.substring(head, 1, 1)
    return (
        out.when(first.isin("{", "["), "json").when(first == "<", "xml")
        .when(head.contains("\t") & head.contains("\n"), "tsv").when(head.contains(",") & head.contains("\n"), "csv").otherwise("text")
    )


def number(column: Column) -> Column:
    """The number that a cell holds, commas, dollar signs and percent signs aside."""
    return F.regexp_replace(column.cast("string"), "[,$%]", "").try_cast("double")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, n, lowest, highest, mean)``: all columns in one pass, then turned to rows."""
    aggregates = [f(F.col(c)).alias(f"{c}__{name}") for c in columns for name, f in (("n", F.count), ("lowest", F.min), ("highest", F.max), ("mean", F.avg))]
    one = df.agg(*aggregates)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__lowest").cast("double").alias("lowest"), F.col(f"{c}__highest").cast("double").alias("highest"), F.round(F.col(f"{c}__mean"), 4).alias("mean")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, kind)``: number if over 80 % of the non-empty cells are, date if any looks like one, else text."""
    aggregates = []
    for c in columns:
        cell = F.col(c).cast("string")
        filled = F.coalesce(F.length(F.trim(cell)) > 0, F.lit(False))
        aggregates += [F.count_if(filled).alias(f"{c}__n"), F.count_if(filled & number(cell).isNotNull()).alias(f"{c}__numbers"), F.count_if(filled & cell.rlike(r"^\d{4}-\d{2}-\d{2}")).alias(f"{c}__dates")]
    one = df.agg(*aggregates)
    kind = lambda c: F.when(F.col(f"{c}__numbers") > 0.8 * F.col(f"{c}__n"), "number").when(F.col(f"{c}__dates") > 0, "date").otherwise("text")
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in columns))).alias("r")).select("r.*")


def identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, is_identifier)``: named like one, or distinct consecutive integers."""
    aggregates = [f.alias(f"{c}__{n}") for c in columns for n, f in (("n", F.count(c)), ("d", F.count_distinct(c)), ("lo", F.min(c)), ("hi", F.max(c)))]
    one = df.agg(*aggregates)
    consecutive = lambda c: (F.col(f"{c}__n") > 0) & (F.col(f"{c}__d") == F.col(f"{c}__n")) & (F.col(f"{c}__hi") - F.col(f"{c}__lo") + 1 == F.col(f"{c}__n"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.lit(c.lower().endswith("id")) | consecutive(c)).alias("is_identifier")) for c in columns))).alias("r")).select("r.*")


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    aggregates = [F.round(F.avg(F.when(F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) == 0, 1.0).otherwise(0.0)) * 100, 4).alias(c) for c in columns]
    one = df.agg(*aggregates)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_pct")) for c in columns))).alias("r")).select("r.*")


def categoricals(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """Columns of 2 to ``most`` values, and these: collect_set holds one entry a value, and counting comes first."""
    parts = []
    for c in columns:
        values = df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).filter("value IS NOT NULL")
        # One value more than listed is enough to know that there are too many.
        few = values.orderBy("value").limit(most + 1)
        parts.append(few.agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("values")).filter(F.col("n_values").between(2, most)).select(F.lit(c).alias("column"), "n_values", "values"))
    return reduce(DataFrame.unionAll, parts)


def breakdown(df: DataFrame, dimensions: list[str], measures: list[str]) -> DataFrame:
    """Sums and means of measures by each dimension: grouping sets, so the table is read once."""
    # Expand makes a row for each dimension before the partial aggregation, which leaves a row a group and task.
    sets = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    long = df.select(F.explode(sets).alias("g"), *measures).select("g.*", *measures)
    aggregates = [a for m in measures for a in (F.round(F.sum(m), 2).alias(f"sum_{m}"), F.round(F.avg(m), 4).alias(f"avg_{m}"))]
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"), *aggregates)


def spread(df: DataFrame, dimension: str, measures: list[str]) -> DataFrame:
    """How far a measure's group means lie apart, relative to their mean; 0 with one group."""
    means = df.groupBy(dimension).agg(*(F.avg(m).alias(m) for m in measures))

    def of(m: str) -> Column:
        middle = F.abs(F.avg(m))
        return F.when(F.count("*") < 2, 0.0).otherwise((F.max(m) - F.min(m)) / F.when(middle == 0, 1.0).otherwise(middle))

    one = means.agg(*(F.round(of(m), 6).alias(m) for m in measures))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("spread")) for m in measures))).alias("r")).select("r.*")


def stratified_sample(df: DataFrame, key: str, numbers: list[str], category: str, rare: int = 3) -> DataFrame:
    """First and last row, the rows with the extremes of each number, and those of rare categories."""
    ends = [F.min(key).alias("first"), F.max(key).alias("last")]
    extremes = [f(key, F.struct(F.col(c), (-F.col(key) if f is F.max_by else F.col(key)))).alias(f"{c}_{n}") for c in numbers for n, f in (("low", F.min_by), ("high", F.max_by))]
    one = df.agg(*ends, *extremes)
    why = ["first", "last", *(f"{c}_{n}" for c in numbers for n in ("low", "high"))]
    picked = one.select(F.explode(F.array(*(F.struct(F.lit(w).alias("reason"), F.col(w).alias(key)) for w in why))).alias("r")).select("r.*")
    few = df.groupBy(category).agg(F.count("*").alias("n")).filter(F.col("n") <= rare).select(category)
    rows = df.join(few, category, "left_semi").select(F.lit("rare").alias("reason"), key)
    return picked.unionAll(rows).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def looks_tabular(text: Column, least: int = 50) -> Column:
    """Many lines, and one number of fields (3 or more) shared by most of the first 20."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    counts = F.transform(F.slice(lines, 1, 20), lambda line: F.size(F.split(line, r"[,|\t]")))
    common = F.array_max(F.transform(F.array_distinct(F.filter(counts, lambda c: c >= 3)), lambda c: F.size(F.filter(counts, lambda d: d == c))))
    return (F.size(lines) >= least) & (F.coalesce(common, F.lit(0)) >= 0.8 * F.size(counts))


def ranked_groups(df: DataFrame, dimension: str, measure: str, k: int = 5) -> DataFrame:
    groups = df.groupBy(F.col(dimension).cast("string").alias("value")).agg(F.round(F.avg(measure), 4).alias("mean"), F.count("*").alias("n"))
    return groups.orderBy(F.desc("mean"), "value").limit(k)


def even_fill(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Every row whose rank by key is at a multiple of the table's size over ``parts``: evenly spread over the order.

    The step comes from one count; ranks come from counts of key ranges, so no task sorts the table.
    """
    total = df.count()
    step = max(1, total // parts)
    ordered = df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    before = ordered.groupBy("part").agg(F.count("*").alias("size"))
    offsets = before.withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return ordered.withColumn("place", place).join(F.broadcast(offsets.select("part", "before")), "part").filter((F.col("place") + F.col("before")) % step == 0).select(key)
