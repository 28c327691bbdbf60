"""Usage and cost over the request log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.sources.tables import DAY_US

# US dollars per 1,000 tokens (input, output) by what a model's or provider's name contains.
PRICES = {"claude": (0.003, 0.015), "anthropic": (0.003, 0.015), "openai": (0.005, 0.020), "gpt": (0.005, 0.020), "gemini": (0.001, 0.004), "deepseek": (0.0014, 0.0028), "mistral": (0.002, 0.006)}
DEFAULT_PRICE = (0.003, 0.015)
PERIODS = {"daily": 1, "weekly": 7, "monthly": 30}
# Context windows in tokens by what a model's name contains; the longest such key counts.
CONTEXTS = {
    "claude-fable-5": 200_000, "claude-opus-4-8": 200_000, "claude-sonnet": 200_000, "claude-opus": 200_000, "claude-haiku": 200_000, "claude": 200_000,
    "gpt-4.1": 1_000_000, "gpt-4o": 128_000, "gpt-4": 128_000, "gpt-3.5": 16_000, "gpt-5": 400_000, "o1": 200_000, "o3": 200_000, "o4": 200_000,
    "gemini": 1_000_000, "deepseek": 128_000, "mistral": 128_000, "codestral": 256_000, "grok": 128_000, "command-r": 128_000,
    "llama": 32_000, "qwen": 32_000, "mixtral": 32_000, "phi": 16_000,
}
DEFAULT_CONTEXT = 128_000


def longest_match(name: Column, keys: list[str]) -> Column:
    """The longest key that the name contains, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for key in sorted(keys, key=lambda k: (-len(k), k)):
        out = out.when(name.contains(key), F.lit(key))
    return out


def priced(requests: DataFrame) -> DataFrame:
    """Add ``price_key``, ``cost`` and ``cost_saved``; local models are free."""
    key = F.coalesce(longest_match(F.lower("model"), list(PRICES)), longest_match(F.lower("provider"), list(PRICES)), F.lit("default"))

    def rate(k: int) -> Column:
        out = F.when(F.col("provider") == "ollama", 0.0)
        for name, price in PRICES.items():
            out = out.when(F.col("price_key") == name, price[k])
        return out.otherwise(DEFAULT_PRICE[k])

    out = requests.withColumn("price_key", key)
    return out.withColumn("cost", F.col("input_sent") / 1000 * rate(0) + F.col("output_tokens") / 1000 * rate(1)).withColumn("cost_saved", F.col("saved") / 1000 * rate(0))


def period_stats(requests: DataFrame, now: int | Column) -> DataFrame:
    """One row a period, all periods in one pass over the log."""
    p = priced(requests)
    inside = {name: F.col("ts_us") >= now - days * DAY_US for name, days in PERIODS.items()}
    measures = {"requests": F.lit(1), "tokens_saved": F.col("saved"), "tokens_used": F.col("input_sent") + F.col("output_tokens"), "cost_saved": F.col("cost_saved"), "cost_actual": F.col("cost")}
    wide = p.filter(F.col("ts_us") >= now - max(PERIODS.values()) * DAY_US).agg(*(F.sum(F.when(cond, value).otherwise(0)).alias(f"{name}_{m}") for name, cond in inside.items() for m, value in measures.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("period"), *(F.coalesce(F.col(f"{name}_{m}"), F.lit(0)).alias(m) for m in measures)) for name in PERIODS))
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    total = F.col("tokens_saved") + F.col("tokens_used")
    return out.select(
        "period", F.col("requests").cast("bigint"), F.col("tokens_saved").cast("bigint"), F.col("tokens_used").cast("bigint"),
        F.round("cost_saved", 4).alias("cost_saved"), F.round("cost_actual", 4).alias("cost_actual"),
        F.round(F.when(total == 0, 0.0).otherwise(F.col("tokens_saved") / total * 100), 4).alias("savings_pct"),
    )


def layer_breakdown(requests: DataFrame) -> DataFrame:
    return requests.select(F.explode("layers").alias("layer", "tokens")).groupBy("layer").agg(F.sum("tokens").alias("tokens"))


def provider_totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("provider").agg(F.count("*").alias("requests"), F.sum("saved").alias("saved"))


def context_windows(requests: DataFrame) -> DataFrame:
    key = longest_match(F.lower("model"), list(CONTEXTS))
    out = F.when(F.lit(False), F.lit(0))
    for name, size in CONTEXTS.items():
        out = out.when(key == name, size)
    return requests.select("model", out.otherwise(DEFAULT_CONTEXT).cast("bigint").alias("context_window")).distinct()


def retained(requests: DataFrame, now: int | Column, days: int = 31, newest: int = 50_000) -> DataFrame:
    """The log after trimming: by age, then the newest; one global top-k, which Spark keeps per task before merging."""
    return requests.filter(F.col("ts_us") >= now - days * DAY_US).orderBy(F.desc("ts_us"), F.desc("request_id")).limit(newest)


def sliding_usage(requests: DataFrame, days: int = 7) -> DataFrame:
    """Per day, requests and tokens saved over the trailing days, from daily sums rather than from the log."""
    daily = requests.groupBy(F.floor(F.col("ts_us") / DAY_US).cast("bigint").alias("day")).agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))
    # Each day's sum is sent to the days that it counts for; a window over all days would need one task.
    spread = daily.select(F.explode(F.sequence("day", F.col("day") + days - 1)).alias("for_day"), "n", "saved", "day")
    sums = spread.groupBy("for_day").agg(F.sum("n").alias("requests"), F.sum("saved").alias("saved"))
    return sums.join(daily.select(F.col("day").alias("for_day")), "for_day").withColumnRenamed("for_day", "day")


def percentiles(requests: DataFrame) -> DataFrame:
    return requests.groupBy("provider").agg(*(F.expr(f"percentile(output_tokens, {q})").alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)))


def busiest_sessions(requests: DataFrame, k: int = 10) -> DataFrame:
    own = requests.groupBy("session_id").agg(F.count("*").alias("requests"), F.max("ts_us").alias("last_at"), F.sum("saved").alias("saved"))
    return own.orderBy(F.desc("requests"), "session_id").limit(k)


def token_buckets(requests: DataFrame, capacity: float = 4.0, per_second: float = 1 / 7200) -> DataFrame:
    """Admission of each request by its session's token bucket, replayed over the time-ordered log.

    The bucket is a fold over a session's requests: a running state that no window frame expresses. Spark sorts the
    requests (spilling where it must), and a task carries one bucket from row to row, however many a session has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, tokens, last = None, capacity, 0
        for pdf in batches:
            allowed, left = [], []
            for own, at in zip(pdf["session_id"].tolist(), pdf["ts_us"].tolist(), strict=True):
                if own != session:
                    session, tokens, last = own, capacity, at
                tokens, last = min(capacity, tokens + (at - last) / 1e6 * per_second), at
                allowed.append(tokens >= 1)
                tokens -= tokens >= 1
                left.append(tokens)
            yield pd.DataFrame({"session_id": pdf["session_id"], "request_id": pdf["request_id"], "allowed": allowed, "left": left})

    kind = requests.schema["session_id"].dataType.simpleString()
    ordered = requests.select("session_id", "ts_us", "request_id").repartition("session_id").sortWithinPartitions("session_id", "ts_us", "request_id")
    out = ordered.mapInPandas(run, f"session_id {kind}, request_id bigint, allowed boolean, left double")
    return out.select("session_id", "request_id", "allowed", F.round("left", 6).alias("tokens"))
