"""Similarity search and session selection; every operator carries the query's id, so questions run as one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import dot, minmax, norm
from .topk import ranked, top_k


def _heads(rows: DataFrame, key: str, dim: int, *more: str) -> DataFrame:
    """(key, _v, _norm, more): the first ``dim`` numbers of the embedding, null if there are not so many, and its norm."""
    whole = (F.size("embedding") >= dim) & ~F.exists(F.slice("embedding", 1, dim), lambda x: x.isNull())
    return rows.select(key, F.when(whole, F.slice("embedding", 1, dim).cast("array<double>")).alias("_v"), norm("embedding").alias("_norm"), *more)


def _matrix(vectors: pa.Array, norms: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, norms and which rows have none (0 there)."""
    out = np.zeros((len(vectors), dim))
    out[vectors.is_valid().to_numpy(zero_copy_only=False)] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, norms.fill_null(0.0).to_numpy(zero_copy_only=False), ~(pc.and_(vectors.is_valid(), norms.is_valid()).to_numpy(zero_copy_only=False))


def _summed(parts) -> np.ndarray:
    """The parts' sum in the order of ``dot``, one by one: equal vectors have equal scores wherever they stand."""
    parts = iter(parts)
    out = next(parts)
    for x in parts:
        out += x
    return out


def _divided(dots: np.ndarray, norms: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The quotients and which are null."""
    none = none | (norms == 0)
    with np.errstate(all="ignore"):
        return np.divide(dots, norms, out=np.zeros_like(dots), where=~none), none


def _compared(questions: DataFrame, items: DataFrame, dim: int, k: int | None = None) -> DataFrame:
    """(query_id, id, score) of questions (query_id, embedding) with items (id, embedding).

    With ``k``, items have ``n``, and scores (then with ``_n``) are left out that k items of the same batch score higher than.
    The questions go to every task; a batch of items is compared with some of them at a time.
    """
    asked = _heads(questions, "query_id", dim).toArrow().combine_chunks()
    rows = _heads(items.filter("embedding IS NOT NULL"), "id", dim, *(["n"] if k else []))
    kinds = dict(questions.dtypes)["query_id"], dict(items.dtypes)["id"]
    parts = -(-rows.count() * len(asked) // 2**19)

    def score(batches):
        q_ids, (q, q_norm, q_none) = asked["query_id"].combine_chunks(), _matrix(asked["_v"].combine_chunks(), asked["_norm"].combine_chunks(), dim) if len(asked) else (None, None, None)
        for whole in batches if len(asked) else ():
            for lo in range(0, len(whole), size := 1024 if k is None else 4096):
                batch = whole.slice(lo, size)
                e, e_norm, e_none = _matrix(batch["_v"], batch["_norm"], dim)
                e = np.ascontiguousarray(e.T)
                for at in range(0, len(q), 32):
                    own = q[at : at + 32]
                    found, none = _divided(_summed(own[:, j, None] * e[j] for j in range(dim)), q_norm[at : at + 32, None] * e_norm, q_none[at : at + 32, None] | e_none)
                    x, y = np.divmod(np.arange(found.size), len(batch)) if k is None else np.nonzero(_leading(found, none, batch["n"].to_numpy(), k))
                    columns = [q_ids.take(pa.array(at + x)), batch["id"].take(pa.array(y)), pa.array(found[x, y], mask=none[x, y])]
                    yield pa.RecordBatch.from_arrays([*columns, batch["n"].take(pa.array(y))], ["query_id", "id", "score", "_n"]) if k else pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

    spread = rows.repartition(parts) if parts > 1 else rows
    return spread.mapInArrow(score, f"query_id {kinds[0]}, id {kinds[1]}, score double" + (", _n bigint" if k else ""))


def _leading(scores: np.ndarray, none: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Where, row by row, the columns of greater scores count fewer than k (nulls are least, what is no number is greatest)."""
    order = np.where(none, -np.inf, np.where(np.isnan(scores), np.inf, scores))
    places = np.argsort(-order, axis=1)
    upto = np.cumsum(sizes[places], axis=1) >= k
    last = np.where(upto.any(axis=1), upto.argmax(axis=1), order.shape[1] - 1)
    rows = np.arange(len(order))
    return order >= order[rows, places[rows, last]][:, None]


def cosine_scores(questions: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """(query_id, id, score) of questions (query_id, embedding) with all items (id, embedding).

    Questions are a stated, small set; each scan of the items serves all of them.
    """
    return _compared(questions, items, dim)


def nearest(questions: DataFrame, items: DataFrame, sizes: DataFrame, k: int, dim: int) -> DataFrame:
    """What ``within`` keeps of all cosine scores, without making the others: batches of items leave out what their own best exceed."""
    counted = items.join(sizes.select(F.col("vec").alias("id"), "n"), "id", "left").fillna(0, ["n"])
    return _counted_within(_compared(questions, counted.select("id", "embedding", F.col("n").cast("bigint").alias("n")), dim, k), k)


def with_scores(rows: DataFrame, questions: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """The rows (query_id, vec, ..) that have an item, with its ``score``: of ``cosine_scores`` only these pairs are made."""

    @F.arrow_udf("double")
    def score(q: pa.Array, q_norm: pa.Array, e: pa.Array, e_norm: pa.Array) -> pa.Array:
        (a, x, none), (b, y, no) = _matrix(q, q_norm, dim), _matrix(e, e_norm, dim)
        found, none = _divided(_summed(a[:, j] * b[:, j] for j in range(dim)), x * y, none | no)
        return pa.array(found, mask=none)

    e = _heads(items.filter("embedding IS NOT NULL").withColumnRenamed("id", "vec"), "vec", dim).withColumnsRenamed({"_v": "_e", "_norm": "_ne"})
    q = _heads(questions, "query_id", dim).withColumnsRenamed({"_v": "_q", "_norm": "_nq"})
    return rows.join(e, "vec").join(F.broadcast(q), "query_id").select(*rows.columns, score("_q", "_nq", "_e", "_ne").alias("score"))


def similar_within(nodes: DataFrame, items: DataFrame, threshold: float, dim: int, block: int = 1024) -> DataFrame:
    """(query_id, a, b, score) with a < b of items (id, embedding) whose cosine similarity reaches the threshold, among the
    vectors that one question's nodes (query_id, vec) have.

    Matrix products of a question's vectors find the pairs near or above the threshold; the score of these decides.
    """

    def close(rows: pa.Table) -> pa.Table:
        v, size, none = _matrix(rows["_v"].combine_chunks(), rows["_norm"].combine_chunks(), dim)
        some = ~none & (size != 0)
        ids, v, size, found = rows["vec"].to_numpy()[some], v[some], size[some], []
        with np.errstate(all="ignore"):
            heads = v / size[:, None]
            for lo in range(0, len(ids), block):
                x, y = np.nonzero(~(heads[lo : lo + block] @ heads.T < threshold - 1e-6))  # what is no number is left to the score
                x, y = (z[ids[lo + x] < ids[y]] for z in (lo + x, y))
                score = _summed(v[x, j] * v[y, j] for j in range(dim)) / (size[x] * size[y])
                near = ~(score < threshold)
                found.append((ids[x[near]], ids[y[near]], score[near]))
        a, b, score = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (ids, ids, size)
        return pa.table({"query_id": pa.array([rows["query_id"][0].as_py()] * len(a), rows["query_id"].type), "a": a, "b": b, "score": score})

    heads = _heads(items.filter("embedding IS NOT NULL").withColumnRenamed("id", "vec"), "vec", dim)
    near = nodes.select("query_id", "vec").distinct().join(heads, "vec").select("query_id", "vec", "_v", "_norm")
    return near.groupBy("query_id").applyInArrow(close, "query_id bigint, a bigint, b bigint, score double")


def channel_b(scored: DataFrame, k: int) -> DataFrame:
    """The k most similar triples of each question, ranked."""
    return top_k(scored, k, ["query_id"], [F.desc("score"), F.col("ordinal"), F.col("src"), F.col("dst")])


def within(scores: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The scores (query_id, id, score) that fewer than k items score higher than, of ``sizes(vec, n)`` or more items a vector."""
    return _counted_within(scores.join(sizes.select(F.col("vec").alias("id"), F.col("n").alias("_n")), "id", "left").fillna(0, ["_n"]), k)


def _counted_within(rows: DataFrame, k: int) -> DataFrame:
    upto = Window.partitionBy("query_id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("query_id", "score")
    rows = rows.withColumn("_higher", F.sum("_n").over(upto) - F.sum("_n").over(level))
    return rows.filter(F.col("_higher") < k).select("query_id", "id", "score")


def channel_b_sessions(top: DataFrame) -> DataFrame:
    """(query_id, session_id, score, triples): the greatest score of each session, above 0, and its triples."""
    rows = top.groupBy("query_id", "session_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("triples"))
    return rows.filter("score > 0")


def session_scores_multi(top: DataFrame, edge_mentions: DataFrame) -> DataFrame:
    """(query_id, session_id, score): the greatest score over all sessions that mention a triple."""
    return top.select("query_id", "src", "dst", "score").join(edge_mentions, ["src", "dst"]).groupBy("query_id", "session_id").agg(F.max("score").alias("score"))


def dual_channel_fusion(a: DataFrame, b: DataFrame, pool: int = 15, alpha: float = 0.5, keep: int = 15) -> DataFrame:
    """Sessions of the first ``pool`` of channel A or in channel B, by ``alpha`` * scaled A + (1 - ``alpha``) * B.

    A is scaled within the union; a session only in B has its own A score, 0 if it has none. (query_id, session_id,
    a_raw, b_raw, a_norm, fusion, source, rank).
    """
    pooled = ranked(a, ["query_id"], [F.desc("score"), F.col("session_id")], "_r").select("query_id", "session_id", F.col("score").alias("a_raw"), (F.col("_r") <= pool).alias("in_a"))
    union = pooled.join(b.select("query_id", "session_id", F.col("score").alias("b_raw")), ["query_id", "session_id"], "full").filter("coalesce(in_a, false) OR b_raw IS NOT NULL")
    source = F.when(F.coalesce("in_a", F.lit(False)) & F.col("b_raw").isNotNull(), "AB").when(F.coalesce("in_a", F.lit(False)), "A").otherwise("B")
    rows = union.select("query_id", "session_id", F.coalesce("a_raw", F.lit(0.0)).alias("a_raw"), source.alias("source"), F.coalesce("b_raw", F.lit(0.0)).alias("b_raw"))
    rows = rows.withColumn("a_norm", minmax("a_raw", Window.partitionBy("query_id"))).withColumn("fusion", alpha * F.col("a_norm") + (1 - alpha) * F.col("b_raw"))
    return top_k(rows, keep, ["query_id"], [F.desc(F.round("fusion", 9)), F.col("session_id")])


def linear_merge(a: DataFrame, b: DataFrame, pools: tuple[int, int] = (10, 8), weights: tuple[float, float] = (0.7, 0.3), keep: int = 15) -> DataFrame:
    """Sessions of two pools: weighted sum for those of the second, the whole score for those only in the first."""
    order = [F.desc("score"), F.col("session_id")]
    x = top_k(a, pools[0], ["query_id"], order).select("query_id", "session_id", F.col("score").alias("x"))
    y = top_k(b, pools[1], ["query_id"], order).select("query_id", "session_id", F.col("score").alias("y"))
    score = F.when(F.col("y").isNotNull(), weights[0] * F.coalesce("x", F.lit(0.0)) + weights[1] * F.col("y")).otherwise(F.col("x"))
    rows = x.join(y, ["query_id", "session_id"], "full").select("query_id", "session_id", score.alias("score"))
    return top_k(rows, keep, ["query_id"], [F.desc(F.round("score", 9)), F.col("session_id")])


def rrf_fusion(a: DataFrame, b: DataFrame, k: int = 60, pools: tuple[int, int] = (15, 10), weights: tuple[float, float] = (0.6, 0.4), keep: int = 15) -> DataFrame:
    """Weighted reciprocal-rank fusion of two pools."""
    order = [F.desc("score"), F.col("session_id")]
    parts = [top_k(rows, pool, ["query_id"], order).select("query_id", "session_id", (F.lit(weight) / (k + F.col("rank"))).alias("score")) for rows, pool, weight in zip((a, b), pools, weights, strict=True)]
    rows = parts[0].unionByName(parts[1]).groupBy("query_id", "session_id").agg(F.sum("score").alias("score"))
    return top_k(rows, keep, ["query_id"], [F.desc(F.round("score", 9)), F.col("session_id")])


def rank_based(rows: DataFrame) -> DataFrame:
    """Scores by place: 0.9, then nine tenths of the one before."""
    return ranked(rows, ["query_id"], [F.desc("score"), F.col("session_id")]).withColumn("place_score", 0.9 * F.pow(F.lit(0.9), F.col("rank") - 1))


def similar_entities(scores: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, node, score, rank): the greatest of 0.7 * cosine + 0.3 * equal type over the wanted (query_id, entity_type), 0 at least."""
    rows = nodes.join(scores, F.col("vec") == F.col("id")).join(wanted.select("query_id", F.col("entity_type").alias("_t")), "query_id")
    score = 0.7 * F.col("score") + 0.3 * (F.col("entity_type") == F.col("_t")).cast("double")
    best = rows.groupBy("query_id", "node").agg(F.greatest(F.max(score), F.lit(0.0)).alias("score"))
    return top_k(best, k, ["query_id"], [F.desc("score"), F.col("node")])


def fuzzy_entities(terms: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(term, node, score, rank): names equal to a term, or one within the other, apart from case. Empty terms match nothing."""
    t, n = F.lower("term"), F.lower("node")
    pairs = nodes.join(terms.filter(F.trim("term") != ""), F.contains(n, t) | F.contains(t, n)).withColumn("score", F.when(n == t, 1.0).otherwise(0.8))
    return top_k(pairs.select("term", "node", "score"), k, ["term"], [F.desc("score"), F.col("node")])


def entity_triples(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that touch a ranked entity of (query_id, node, rank), with the best rank: two joins, no OR."""
    ends = [edges.join(entities.select("query_id", F.col("node").alias(end), F.col("rank").alias("_r")), end).select("query_id", *edges.columns, "_r") for end in ("src", "dst")]
    return ends[0].unionByName(ends[1]).groupBy("query_id", *edges.columns).agg(F.min("_r").alias("entity_rank"))


def relevant_triples(touching: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Of triples that touch ranked entities, the best by cosine + 0.2 / (rank + 1), a pool of at least 20; rank from 0."""
    rows = touching.join(scores.withColumnRenamed("id", "vec"), ["query_id", "vec"]).withColumn("final", F.col("score") + 0.2 / F.col("entity_rank"))
    return top_k(rows, max(2 * k, 20), ["query_id"], [F.desc("final"), F.col("ordinal"), F.col("src"), F.col("dst")])


def session_triples(edges: DataFrame, selected: DataFrame, questions: DataFrame, items: DataFrame, dim: int, k: int) -> DataFrame:
    """The k most similar triples of the selected sessions, by each edge's own session."""
    rows = with_scores(edges.join(selected.select("query_id", "session_id"), "session_id"), questions, items, dim)
    return top_k(rows, k, ["query_id"], [F.desc("score"), F.col("ordinal"), F.col("src"), F.col("dst")])


def _mean_direction(texts: DataFrame, vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean): the mean of the unit vectors of (by, text); a text without a vector counts as zero."""
    rows = texts.join(vectors, "text", "left").select(*by, F.transform("vec", lambda x: F.try_divide(x.cast("double"), norm("vec"))).alias("unit"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sums = rows.select(*by, F.posexplode("unit").alias("_p", "_x")).groupBy(*by, "_p").agg(F.sum("_x").alias("_x")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda e: e["_x"]).alias("_s"))
    return counts.join(sums, by, "left").select(*by, F.transform("_s", lambda x: x / F.col("_n")).alias("mean"))


def summary_key_similarity(summaries: DataFrame, terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, session_id, score): the mean cosine of a query's terms and its summaries' keys; 0 without keys.

    ``summaries(query_id, session_id, keys)``: each query's relevant ones; ``vectors(text, vec)``: embeddings of lower-case
    texts. The mean over all pairs is the inner product of the mean unit vectors, so no pairs are made.
    """
    keys = summaries.select("session_id", F.explode(F.filter(F.transform(F.split(F.lower("keys"), ","), lambda k: F.trim(k)), lambda k: k != "")).alias("text")).distinct()
    listed = _mean_direction(keys, vectors, ["session_id"]).withColumnRenamed("mean", "_keys")
    asked = _mean_direction(terms.select("query_id", F.lower(F.trim("term")).alias("text")).filter("text <> ''"), vectors, ["query_id"]).withColumnRenamed("mean", "_terms")
    rows = summaries.select("query_id", "session_id").join(listed, "session_id", "left").join(asked, "query_id", "left")
    return rows.select("query_id", "session_id", F.coalesce(dot("_keys", "_terms"), F.lit(0.0)).alias("score"))


def summary_entity_max(scores: DataFrame, sessions: DataFrame, k: int) -> DataFrame:
    """(query_id, session_id, score, rank): sessions by their summary's greatest similarity, 0 at least."""
    rows = sessions.join(scores, F.col("vec") == F.col("id")).groupBy("query_id", "session_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return top_k(rows, k, ["query_id"], [F.desc("score"), F.col("session_id")])


def lookup_entities(wanted: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, entity, place): the first k requested names (query_id, place, entity) that are nodes, in order of request."""
    found = wanted.join(nodes.select(F.col("node").alias("entity")).distinct(), "entity", "left_semi")
    return top_k(found.select("query_id", "entity", F.col("place").alias("_p")), k, ["query_id"], [F.col("_p"), F.col("entity")], "place").drop("_p")
