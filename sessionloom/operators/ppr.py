"""Seeds, personalised PageRank and rankings from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import decay, harmonic, minmax, share
from ..functions.text import time_gap
from .graph import node_degree
from .topk import first_seen, top_k


def nodes_of(graph: DataFrame) -> DataFrame:
    return graph.select("query_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def phrase_seeds(top: DataFrame, nodes: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(query_id, node, score, rank): the k best ends of the top triples, by their greatest score, 0 at least."""
    ends = top.select("query_id", "score", F.explode(F.array("src", "dst")).alias("node"))
    best = ends.groupBy("query_id", "node").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    if nodes is not None:
        best = best.join(nodes, ["query_id", "node"], "left_semi")
    return top_k(best, k, ["query_id"], [F.desc("score"), F.col("node")])


def anchor_seeds(entities: DataFrame, ordered: DataFrame, graph: DataFrame, mass: float = 0.2) -> DataFrame:
    """(query_id, node, score): for each named entity its node, else the first whose name contains it or is in it.

    ``ordered(query_id, node, ordinal)``: entity nodes by first appearance. The mass is shared over a node's edges.
    """
    named = entities.filter(F.trim("entity") != "").select("query_id", F.trim("entity").alias("entity")).distinct()
    a, b = F.lower("entity"), F.lower("node")
    pairs = ordered.join(named, "query_id").filter(F.contains(a, b) | F.contains(b, a)).withColumn("order", F.struct((F.col("node") != F.col("entity")).alias("other"), "ordinal", "node"))
    picked = first_seen(pairs.select("query_id", "entity", "node", "order"), ["query_id", "entity"], "order").select("query_id", "node").distinct()
    return picked.join(node_degree(graph, ["query_id"]), ["query_id", "node"]).select("query_id", "node", (F.lit(mass) / F.greatest("degree", F.lit(1))).alias("score"))


def anchor_argmax(scores: DataFrame, nodes: DataFrame, mass: float = 0.2) -> DataFrame:
    """(query_id, node, score): each named entity's most similar node gets the mass; masses of one node add up.

    ``scores(query_id, entity, id, score)``: similarities of the questions' entities and the vectors.
    """
    rows = nodes.join(scores, F.col("vec") == F.col("id"))
    best = top_k(rows, 1, ["query_id", "entity"], [F.desc("score"), F.col("node")])
    return best.groupBy("query_id", "node").agg((F.count(F.lit(1)) * mass).alias("score"))


def session_seeds(fused: DataFrame, latest: DataFrame, question_time: str | DataFrame, weight: float = 0.5, exponent: float = 0.2) -> DataFrame:
    """(query_id, node, score): selected sessions by fusion score and the decay of their age relative to the median's.

    ``question_time``: one for all questions, or (query_id, question_time); a blank or missing one gives no age.
    """
    rows = fused.select("query_id", F.concat(F.lit("sess:"), "session_id").alias("node"), "fusion").join(latest.select("query_id", F.col("session").alias("node"), "latest"), ["query_id", "node"], "left")
    rows = rows.withColumn("question_time", F.lit(question_time)) if isinstance(question_time, str) else rows.join(question_time, "query_id", "left")
    rows = rows.withColumn("gap", F.when(F.col("latest").isNotNull(), time_gap("question_time", "latest")).otherwise(0.0))
    rows = rows.withColumn("median", F.greatest(F.median("gap").over(Window.partitionBy("query_id")), F.lit(1.0)))
    return rows.select("query_id", "node", (weight * F.col("fusion") * decay("gap", "median", exponent)).alias("score")).filter("score > 0")


def seeds(phrases: DataFrame, anchors: DataFrame, sessions: DataFrame) -> DataFrame:
    """(query_id, node, mass), summing to 1: the greater of phrase and anchor, then sessions; even if all are 0."""
    names = phrases.select("query_id", "node", "score").unionByName(anchors.select("query_id", "node", "score")).groupBy("query_id", "node").agg(F.max("score").alias("score"))
    rows = names.unionByName(sessions.select("query_id", "node", "score"))
    return rows.select("query_id", "node", share("score", Window.partitionBy("query_id")).alias("mass"))


def reset_probabilities(top: DataFrame) -> DataFrame:
    """(query_id, node, mass): the mean score of the triples at a node, as a share of all."""
    ends = top.select("query_id", "score", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("query_id", "node").agg(F.avg("score").alias("score")).select("query_id", "node", share("score", Window.partitionBy("query_id")).alias("mass"))


def pagerank_local(graph: DataFrame, seed: DataFrame, damping: float = 0.8, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(query_id, node, score): power iteration of each question's local graph in one task.

    Local graphs are small by construction (a few selected sessions). Parallel edges add up; nodes without out-edges
    pass to the seeds; without convergence the last iterate counts.
    """

    def rank(key: tuple, edges: pd.DataFrame, masses: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([edges["src"], edges["dst"], masses["node"]]).astype(str)) if len(edges) or len(masses) else np.array([], str)
        n = len(names)
        s, d, w = np.searchsorted(names, edges["src"].astype(str)), np.searchsorted(names, edges["dst"].astype(str)), edges["weight"].to_numpy(float)
        p = np.zeros(n)
        np.add.at(p, np.searchsorted(names, masses["node"].astype(str)), masses["mass"].to_numpy(float))
        p = p / p.sum() if p.sum() > 0 else np.full(n, 1 / max(n, 1))
        out = np.bincount(s, w, n)
        w = w / out[s]
        x = np.full(n, 1 / max(n, 1))
        for _ in range(iterations):
            last, x = x, damping * (np.bincount(d, x[s] * w, n) + x[out == 0].sum() * p) + (1 - damping) * p
            if np.abs(x - last).sum() < n * tolerance:
                break
        return pd.DataFrame({"query_id": key[0], "node": names, "score": x})

    return graph.select("query_id", "src", "dst", "weight").groupBy("query_id").cogroup(seed.select("query_id", "node", "mass").groupBy("query_id")).applyInPandas(rank, "query_id bigint, node string, score double")


def pagerank(graph: DataFrame, seed: DataFrame, damping: float = 0.8, iterations: int = 30, checkpoint_every: int = 5) -> DataFrame:
    """The same as joins and sums, for graphs of any size; all questions take each step together.

    Lineage is cut with checkpoint() every few steps.
    """
    out = graph.groupBy("query_id", "src").agg(F.sum("weight").alias("_out"))
    moves = graph.join(out, ["query_id", "src"]).groupBy("query_id", "src", "dst").agg(F.sum(F.col("weight") / F.col("_out")).alias("move")).checkpoint()
    total = seed.groupBy("query_id").agg(F.sum("mass").alias("_all"))
    restart = seed.join(total, "query_id").groupBy("query_id", "node").agg(F.sum(F.col("mass") / F.col("_all")).alias("restart"))
    nodes = nodes_of(graph).unionByName(seed.select("query_id", "node")).distinct()
    sinks = nodes.join(out.select("query_id", F.col("src").alias("node")).distinct(), ["query_id", "node"], "left_anti").withColumn("sink", F.lit(True))
    base = nodes.join(restart, ["query_id", "node"], "left").join(sinks, ["query_id", "node"], "left").fillna(0.0, ["restart"]).fillna(False, ["sink"]).checkpoint()
    rows = base.join(base.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id").select("query_id", "node", (1.0 / F.col("_n")).alias("score"))
    for k in range(iterations):
        flow = rows.withColumnRenamed("node", "src").join(moves, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("move")).alias("flow"))
        lost = rows.join(base.filter("sink"), ["query_id", "node"]).groupBy("query_id").agg(F.sum("score").alias("lost"))
        step = base.join(flow, ["query_id", "node"], "left").join(lost, "query_id", "left").fillna(0.0, ["flow", "lost"])
        rows = step.select("query_id", "node", (damping * (F.col("flow") + F.col("lost") * F.col("restart")) + (1 - damping) * F.col("restart")).alias("score"))
        if (k + 1) % checkpoint_every == 0:
            rows = rows.checkpoint()
    return rows


def _both_ends(triples: DataFrame, ranks: DataFrame) -> DataFrame:
    out = triples
    for end in ("src", "dst"):
        out = out.join(ranks.select("query_id", F.col("node").alias(end), F.col("score").alias(f"ppr_{end}")), ["query_id", end], "left").fillna(0.0, [f"ppr_{end}"])
    return out


def rank_by_ends(triples: DataFrame, ranks: DataFrame, k: int, combine: str = "harmonic") -> DataFrame:
    """Triples (query_id, ordinal, src, dst, ..) by the harmonic mean, or the least, of their ends' rank."""
    score = harmonic("ppr_src", "ppr_dst") if combine == "harmonic" else F.least("ppr_src", "ppr_dst")
    return top_k(_both_ends(triples, ranks).withColumn("ppr", score), k, ["query_id"], [F.desc(F.round("ppr", 9)), F.col("ordinal"), F.col("src"), F.col("dst")])


def rank_triples(triples: DataFrame, ranks: DataFrame, k: int, beta_ppr: float = 0.8, beta_semantic: float = 0.2) -> DataFrame:
    """Triples by scaled harmonic rank and similarity to the question (``score``)."""
    rows = _both_ends(triples, ranks).withColumn("ppr", harmonic("ppr_src", "ppr_dst")).withColumn("ppr_norm", minmax("ppr", Window.partitionBy("query_id"), 1e-12))
    rows = rows.withColumn("final", beta_ppr * F.col("ppr_norm") + beta_semantic * F.col("score"))
    return top_k(rows, k, ["query_id"], [F.desc(F.round("final", 9)), F.col("ordinal"), F.col("src"), F.col("dst")])


def rank_sessions(ranks: DataFrame, k: int) -> DataFrame:
    """(query_id, session_id, score, rank) of the session nodes."""
    rows = ranks.filter("node LIKE 'sess:%'").select("query_id", F.expr("substr(node, 6)").alias("session_id"), "score")
    return top_k(rows, k, ["query_id"], [F.desc(F.round("score", 9)), F.col("session_id")])
