"""Token, cost and time accounting over a log of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prices for 1000 tokens (prompt, completion); a table of the caller's own replaces it.
PRICES = {"small": (0.00015, 0.0006), "large": (0.0025, 0.01)}


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost``; calls without tokens are left out, models without a price cost nothing."""
    rows = usage.filter("prompt_tokens + completion_tokens > 0").join(prices, "model", "left")
    return rows.withColumn("cost", F.coalesce((F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")) / 1000, F.lit(0.0)))


def price_table(spark, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in (prices or PRICES).items()], "model string, prompt_price double, completion_price double")


def token_costs(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"), F.sum("completion_tokens").cast("bigint").alias("completion_tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def stage_deltas(stages: DataFrame, order: str, budget: float) -> DataFrame:
    """Of running totals (order, tokens, cost), the change since the stage before and the state of the budget.

    One row for each stage: few by nature, so one ordered window serves.
    """
    window = Window.orderBy(order)
    rows = stages.withColumn("tokens_delta", F.col("tokens") - F.coalesce(F.lag("tokens").over(window), F.lit(0))).withColumn("cost_delta", F.round(F.col("cost") - F.coalesce(F.lag("cost").over(window), F.lit(0.0)), 6))
    return rows.withColumn("budget_state", F.when(F.col("cost") >= budget, "exceeded").when(F.col("cost") >= 0.8 * budget, "warning").otherwise("ok"))


def timers(events: DataFrame, name: str, seconds: str) -> DataFrame:
    """Total, count, mean and share of the whole of each timer."""
    sums = events.groupBy(name).agg(F.sum(seconds).alias("total"), F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean"))
    return sums.crossJoin(sums.agg(F.sum("total").alias("_all"))).withColumn("percent", F.when(F.col("_all") > 0, 100 * F.col("total") / F.col("_all")).otherwise(0.0)).drop("_all")


def final_report(rows: DataFrame, answers: DataFrame, seconds: float) -> DataFrame:
    """One row: totals, means, rates, cost for 1000 tokens, and rule-based advice."""
    used = rows.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    judged = answers.agg(F.count(F.lit(1)).alias("questions"), F.round(F.count_if("correct") / F.count(F.lit(1)), 6).alias("accuracy"))
    out = used.crossJoin(judged).withColumn("tokens_per_call", F.round(F.col("tokens") / F.col("calls"), 4)).withColumn("cost_per_1k", F.round(1000 * F.col("cost") / F.col("tokens"), 6)).withColumn("questions_per_minute", F.round(F.col("questions") * 60 / F.lit(float(seconds)), 4))
    return out.withColumn("advice", F.when(F.col("accuracy") < 0.5, "improve retrieval").when(F.col("tokens_per_call") > 4000, "shorten prompts").otherwise("none"))
