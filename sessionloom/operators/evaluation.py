"""Answer and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_match


def judged(answers: DataFrame) -> DataFrame:
    """Adds ``answered`` and ``correct`` to (expected, output)."""
    return answers.withColumn("answered", F.coalesce(F.trim("output"), F.lit("")) != "").withColumn("correct", answer_match("expected", "output"))


def _metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"), F.count_if("answered").alias("answered"), F.count_if("correct").alias("correct"),
        F.round(F.count_if("correct") / F.count(F.lit(1)), 6).alias("accuracy"), F.round(F.count_if("answered") / F.count(F.lit(1)), 6).alias("answer_rate"),
    ]


def metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(*_metrics())


def metrics_by_type(rows: DataFrame) -> DataFrame:
    """Metrics of each question type and, with type ``all``, of the whole."""
    return rows.rollup("question_type").agg(*_metrics()).withColumn("question_type", F.coalesce("question_type", F.lit("all")))


def matching_score(origin: Column, top: Column) -> Column:
    """The share of the origin's entries, repeats included, among the top sessions; 0 without any."""
    return F.when(F.size(origin) > 0, F.size(F.filter(origin, lambda x: F.array_contains(top, x))) / F.size(origin)).otherwise(0.0)


def running_accuracy(rows: DataFrame, order: str, part: str) -> DataFrame:
    """Adds the accuracy up to each row, over all rows in order.

    ``part`` is a coarse prefix of the order: only one row for each part meets in one task, the rest is summed within parts.
    """
    one = F.col("correct").cast("long")
    sums = rows.groupBy(part).agg(F.sum(one).alias("_c"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_ic", F.sum(one).over(inside)).withColumn("_in", F.count(F.lit(1)).over(inside)).join(offsets, part)
    return joined.withColumn("running_accuracy", (F.col("_c") + F.col("_ic")) / (F.col("_n") + F.col("_in"))).drop("_c", "_n", "_ic", "_in")


def judge_prompt_kind(question_type: Column) -> Column:
    """The family of judge prompts that a question type takes."""
    kinds = {"temporal": "(?i)temporal", "update": "(?i)update", "preference": "(?i)preference", "abstention": "(?i)abst|_abs"}
    return F.coalesce(*(F.when(question_type.rlike(pattern), kind) for kind, pattern in kinds.items()), F.lit("default"))


def judge_label(response: Column, expected: Column, output: Column) -> Column:
    """Yes in the judge's answer; without an answer, the expected one in the output."""
    return F.when(F.coalesce(response, F.lit("")) != "", F.contains(F.lower(response), F.lit("yes"))).otherwise(F.contains(F.lower(F.trim(output)), F.lower(F.trim(expected))))
