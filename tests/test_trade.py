"""Queries over the trade views make only the mentions and pairs that they need."""

import math
import os

import pytest
from pyspark.sql import functions as F

from sessionloom import catalogue
from sessionloom.fixtures import Tables
from sessionloom.functions import similarity
from sessionloom.operators import retrieval

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")

#: Findings on the table of all mentions, which was written for each of these.
MENTIONS = [
    "anchor_argmax",
    "entity_triples",
    "phrase_seeds",
    "relevant_triples",
    "session_edges",
    "session_triples",
    "similar_entities",
    "context_edges",
    "cognirank",
    "dual_channel_fusion",
    "rank_based_summary",
    "relevant_summaries",
]


@pytest.mark.parametrize("name", MENTIONS)
def test_mentions_are_not_made_whole(spark, name, monkeypatch):
    whole, view = [], Tables.__getitem__

    def seen(self, key):
        if key in ("mentions", "entities", "edges", "edge_mentions") and "l_quantity" in view(self, "lineitem").columns:
            whole.append(key)  # a view over base tables that nothing has cut down
        return view(self, key)

    monkeypatch.setattr(Tables, "__getitem__", seen)
    assert not catalogue.queries()[name](spark, DATA).isEmpty()
    assert not whole


#: Findings on the pairs of all vectors, which were compared for each of these.
PAIRS = [
    "anchor_seeds",
    "harmonic_rank",
    "local_graph",
    "local_multigraph",
    "min_rank",
    "ppr_rank_sessions",
    "ppr_scores",
    "ppr_rank_triples",
    "ppr_seeds",
    "session_latest_ts",
    "synonym_edges",
    "ppr_temporal_rerank",
]


@pytest.mark.parametrize("name", PAIRS)
def test_only_vectors_of_one_question_meet(spark, name, monkeypatch):
    met, own = [], retrieval.similar_within
    monkeypatch.setattr(retrieval, "similar_within", lambda nodes, *x: met.append(nodes.columns) or own(nodes, *x))
    assert not catalogue.queries()[name](spark, DATA).isEmpty()
    assert met and all("query_id" in columns for columns in met)


def test_similar_within_agrees_with_all_pairs(spark):
    vecs = [[math.cos(k), math.sin(k), (k % 3) / 2] for k in range(40)] + [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]
    items = spark.createDataFrame(list(enumerate(vecs)), "id bigint, embedding array<double>")
    nodes = [(q, k) for q in (1, 2) for k in range(len(vecs)) if k % (q + 1) == 0 or k > 39]
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (math.hypot(*x) * math.hypot(*y)) if any(x) and any(y) else None
    expected = {(q, a, b): c for q, a in nodes for p, b in nodes if p == q and a < b and (c := cosine(vecs[a], vecs[b])) is not None and c >= 0.6}
    got = {(r.query_id, r.a, r.b): r.score for r in retrieval.similar_within(spark.createDataFrame(nodes, "query_id bigint, vec bigint"), items, 0.6, 3, block=7).collect()}
    assert set(got) == set(expected) and all(math.isclose(got[k], expected[k], abs_tol=1e-12) for k in got)


#: Findings on the scores of all vectors with all questions, which were made and joined for each of these.
SCORES = ["harmonic_rank", "min_rank", "ppr_rank_triples", "session_triples"]


@pytest.mark.parametrize("name", SCORES)
def test_scores_are_not_made_whole(spark, name, monkeypatch):
    made, own = [], retrieval.cosine_scores
    monkeypatch.setattr(retrieval, "cosine_scores", lambda *x: made.append(x) or own(*x))
    assert not catalogue.queries()[name](spark, DATA).isEmpty()
    assert not made


def test_nearest_and_pairs_agree_with_all_scores(spark):
    nan, vecs = float("nan"), [[math.cos(k % 17), math.sin(k % 17), (k % 3) / 2] for k in range(60)]
    vecs += [[0.0, 0.0, 0.0], None, [1.0, None, 0.0], [1.0, 0.0], [nan, 1.0, 0.0], [1.0, 0.0, 0.0, 2.0], [-0.0, 1.0, 0.0]]
    items = spark.createDataFrame(list(enumerate(vecs)), "id bigint, embedding array<double>")
    asked = items.filter("id % 5 = 0 OR id > 58").withColumnRenamed("id", "query_id")
    sizes = spark.createDataFrame([(k, k % 4) for k in range(64) if k % 7], "vec bigint, n bigint")
    scores = retrieval.cosine_scores(asked, items, 3)
    plain = asked.select("query_id", F.col("embedding").alias("q")).crossJoin(items.filter("embedding IS NOT NULL")).select("query_id", "id", similarity.cosine("q", "embedding", 3).alias("score"))
    rows = lambda df: sorted(map(str, df.select("query_id", "id", "score").collect()))
    assert rows(scores) == rows(plain)
    for k in (1, 6, 1000):
        assert rows(retrieval.nearest(asked, items, sizes, k, 3)) == rows(retrieval.within(plain, sizes, k))
    pairs = plain.filter("(query_id + id) % 3 = 0").select("query_id", F.col("id").alias("vec"))
    assert rows(retrieval.with_scores(pairs, asked, items, 3).withColumnRenamed("vec", "id")) == rows(plain.filter("(query_id + id) % 3 = 0"))
    assert retrieval.cosine_scores(asked.limit(0), items, 3).isEmpty() and retrieval.nearest(asked, items.limit(0), sizes, 2, 3).isEmpty()
