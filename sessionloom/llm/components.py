"""Connected components by alternating star contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Workspace


def _contracted(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges from the greater node ``a`` to the smaller ``b``."""
    down = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    large = edges.join(down, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    hung = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return hung.select("e.a", "e.b").filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node with an edge down has just one, to a node that has none."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))).alias("r"))
    seen = roles.select("r.*").groupBy("node").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.max(F.col("up").isNull()).alias("root"))
    return seen.filter("lo <> hi or (root and lo is not null)").isEmpty()


def connected_components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round writes its edges to the shared folder. Edges that are stars already take no round. Null ends and self-loops
    are ignored; no edges give no rows.
    """
    down = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state, round_no = work.save(down.distinct(), f"{name}-0"), 0
    while not _stars(state):
        round_no += 1
        state = work.save(_contracted(state), f"{name}-{round_no}")
        work.drop(f"{name}-{round_no - 1}")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
