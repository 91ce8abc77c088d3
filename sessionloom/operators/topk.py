"""Ranking, limits and first-seen rows with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place, from 1, of each row among those of its key; the order is total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def top_k(rows: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k of each key. Spark limits each partition before the shuffle (window group limit)."""
    return ranked(rows, by, order, name).filter(F.col(name) <= k)


def first_seen(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The row of the smallest ordinal for each key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in key]
    least = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_r"))
    return least.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def number_rows(rows: DataFrame, name: str) -> DataFrame:
    """Adds a running number from 0 in the order of the input's partitions, by prefix sums over the partitions' sizes."""
    marked = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return marked.join(offsets, "_part").withColumn(name, (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).cast("bigint")).drop("_at", "_part", "_before")
