"""Re-ranking of triples by session summaries and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import decay
from ..functions.text import query_time, time_gap
from .topk import ranked

_ORDER = ("ordinal", "src", "dst")


class Weights:
    """Named weights; their sum is held to at most 1.5 by scaling."""

    def __init__(self, **weights: float):
        self.weights = dict(weights)

    def add(self, name: str, weight: float) -> None:
        self.weights[name] = weight

    def normalized(self) -> dict[str, float]:
        total = sum(self.weights.values())
        return {k: v * 1.5 / total for k, v in self.weights.items()} if total > 1.5 else dict(self.weights)


def _with_summary(triples: DataFrame, summaries: DataFrame) -> DataFrame:
    return triples.join(summaries.select("query_id", "session_id", F.col("score").alias("summary")), ["query_id", "session_id"], "left")


def _decay_over(rows: DataFrame, stamp: str, question: str, exponent: float) -> tuple[DataFrame, Column]:
    """Rows with ``gap`` (0 without a time) and its median over the question's rows, 1 at least; the decay."""
    gapped = rows.withColumn("gap", F.when(F.coalesce(stamp, F.lit("")) != "", time_gap(query_time(F.lit(question)), stamp, strict=True)).otherwise(0.0))
    gapped = gapped.withColumn("median", F.greatest(F.median("gap").over(Window.partitionBy("query_id")), F.lit(1.0)))
    return gapped, decay("gap", "median", exponent)


def simplerank(triples: DataFrame, summaries: DataFrame, summary_weight: float) -> DataFrame:
    """(1 - s) * similarity + s * the session's summary score, 0 without one."""
    rows = _with_summary(triples, summaries).withColumn("final", (1 - summary_weight) * F.col("score") + summary_weight * F.coalesce("summary", F.lit(0.0)))
    return ranked(rows, ["query_id"], [F.desc(F.round("final", 9)), *map(F.col, _ORDER)], "place")


def cognirank(triples: DataFrame, summaries: DataFrame, question: str, summary_weight: float, exponent: float = 0.5, floor: float = 0.01) -> DataFrame:
    """Weighted summary score (a floor where 0 or missing) and similarity, times the decay of the triple's age."""
    rows = _with_summary(triples, summaries)
    rows = rows.withColumn("summary", F.when(F.coalesce("summary", F.lit(0.0)) == 0, floor).otherwise(F.col("summary")))
    rows, fade = _decay_over(rows, "session_time", question, exponent)
    rows = rows.withColumn("final", (summary_weight * F.col("summary") + (1 - summary_weight) * F.col("score")) * fade)
    return ranked(rows, ["query_id"], [F.desc(F.round("final", 9)), *map(F.col, _ORDER)], "place")


def ppr_temporal(triples: DataFrame, question: str | None, exponent: float = 0.5) -> DataFrame:
    """Rank times the decay of the triple's age; without a question's time, the rank alone."""
    if not question:
        rows, fade = triples, F.lit(1.0)
    else:
        rows, fade = _decay_over(triples, "session_time", question, exponent)
    return ranked(rows.withColumn("final", F.col("ppr") * fade), ["query_id"], [F.desc(F.round("final", 12)), *map(F.col, _ORDER)], "place")
