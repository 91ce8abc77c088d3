"""Queries of similarity search, fusion, local graphs, PageRank, re-ranking and context."""

from __future__ import annotations

from functools import cached_property, wraps

from pyspark.sql import functions as F

from .catalogue import query
from .lineage import cut
from .operators import context as X
from .operators import graph as G
from .operators import ppr as P
from .operators import rerank as R
from .operators import retrieval as S
from .trade import Trade

DIM, SYNONYM, TIME, STEPS, TOP, POOL = 64, 0.4, "1998/05/02", 10, 20, 15


def kept(step):
    """A step that is computed once and written: later steps read it several times."""
    return cached_property(wraps(step)(lambda self: cut(step(self))))


class Flow:
    """The steps from questions to ranked triples over the fixture tables, each computed once for a query.

    Mentions and edges are made for what a step needs (``Trade``), not for all tables.
    """

    def __init__(self, t):
        self.t, self.trade = t, Trade(t)

    @property
    def items(self):
        return self.t["embeddings"].select(F.col("vec_id").alias("id"), "embedding")

    @property
    def questions(self):
        return self.items.filter("id % 100 = 0").withColumnRenamed("id", "query_id")

    @kept
    def cos(self):
        """All scores, for queries that return or rank them all; others make those they need."""
        return S.cosine_scores(self.questions, self.items, DIM)

    @kept
    def top(self):
        """The best edges. A mention that is not its pair's last is no edge: as long as too few of the best mentions are edges, more are looked at."""
        sizes, need = cut(self.trade.most()), 8 * TOP
        total = sizes.agg(F.sum("n")).first()[0] or 0
        while True:
            scores = cut(S.nearest(self.questions, self.items, sizes.filter("vec IS NOT NULL"), need, DIM))
            last = self.trade.edges(self.trade.of_vecs(scores.select(F.col("id").alias("vec"))))
            best = cut(S.channel_b(last.join(scores, F.col("vec") == F.col("id")).drop("id"), need).drop("rank"))
            whole = self.trade.edges(self.trade.of_pairs(best)).select(*(F.col(c).alias(f"_{c}") for c in ("src", "dst", "ordinal", "session_id")))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("src", "dst", "ordinal", "session_id")]
            top = cut(S.channel_b(best.join(whole, same, "left_semi"), TOP))
            found = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
            if need >= total or scores.select("query_id").distinct().join(found, "query_id", "left").filter(f"coalesce(n, 0) < {TOP}").isEmpty():
                return top
            need *= 8

    @kept
    def sessions(self):
        return self.trade.sessions()

    @property
    def a(self):
        return self.sessions.join(self.cos, F.col("vec") == F.col("id")).select("query_id", "session_id", "score")

    @kept
    def some_a(self):
        """Of channel A what fusions and rankings use: its first ones and the sessions of the best triples."""
        near = cut(S.nearest(self.questions, self.items, cut(self.trade.session_sizes()), POOL, DIM))
        first = self.trade.sessions_at(near.select(F.col("id").alias("vec"))).join(near, F.col("vec") == F.col("id"))
        own = S.with_scores(self.trade.with_session_vec(self.top.select("query_id", "session_id").distinct()), self.questions, self.items, DIM)
        return first.select("query_id", "session_id", "score").unionByName(own.select("query_id", "session_id", "score")).distinct()

    @property
    def b(self):
        return S.channel_b_sessions(self.top)

    @kept
    def fused(self):
        return S.dual_channel_fusion(self.some_a, self.b, POOL)

    @kept
    def mentioned(self):
        """All mentions of the selected sessions."""
        return self.trade.of_sessions(self.fused)

    @kept
    def edges(self):
        """The edges that the selected sessions mention."""
        return self.trade.edges(self.trade.of_pairs(self.mentioned))

    @property
    def edge_mentions(self):
        return self.mentioned.select("src", "dst", "session_id").distinct()

    @kept
    def relations(self):
        return G.session_edges(self.edges, self.edge_mentions, self.fused)

    @kept
    def contexts(self):
        return G.context_edges(self.edges, self.edge_mentions, self.fused)

    @kept
    def nodes(self):
        """(query_id, node, ordinal, vec) of entity nodes by first appearance."""
        ends = self.relations.select("query_id", F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("ordinal") * 2).alias("ordinal")), F.struct(F.col("dst").alias("node"), (F.col("ordinal") * 2 + 1).alias("ordinal")))).alias("e"))
        return self.trade.with_vec(ends.groupBy("query_id", "e.node").agg(F.min("e.ordinal").alias("ordinal")))

    @kept
    def similar(self):
        """(query_id, node, score, rank). Fewer than ten customers alone score higher than what is looked at."""
        cos, customers = self.cos, self.trade.customers()
        scores = cos.select("query_id", "id", F.greatest(0.7 * F.col("score") + 0.3, F.lit(0.0)).alias("score"), F.lit(True).alias("customer"))
        scores = scores.unionByName(cos.select("query_id", "id", F.greatest(0.7 * F.col("score"), F.lit(0.0)).alias("score"), F.lit(False).alias("customer")))
        # vectors of customers have their numbers, those of other nodes count none
        scores = scores.withColumn("id", F.struct("id", "customer")).drop("customer")
        sizes = customers.select(F.struct(F.col("vec").alias("id"), F.lit(True).alias("customer")).alias("vec"), "n")
        near = cut(S.within(scores, sizes, 10).select("query_id", F.col("id.id").alias("id")).distinct())
        nodes = cut(self.trade.entities_at(near.select(F.col("id").alias("vec"))))
        return S.similar_entities(cos.join(near, ["query_id", "id"], "left_semi"), nodes, cos.select("query_id").distinct().withColumn("entity_type", F.lit("customer")), 10)

    @kept
    def touching(self):
        """The edges that touch a similar entity."""
        return self.trade.edges(self.trade.of_nodes(self.similar))

    @kept
    def synonyms(self):
        nodes, items = self.nodes.filter("vec IS NOT NULL"), self.items
        same = nodes.select("query_id", "vec").distinct().join(items.select(F.col("id").alias("vec")), "vec", "left_semi")
        same = same.select("query_id", F.col("vec").alias("a"), F.col("vec").alias("b"), F.lit(1.0).alias("score"))
        return G.synonym_edges(nodes, S.similar_within(nodes, items, SYNONYM, DIM).unionByName(same))

    @kept
    def graph(self):
        return G.local_graph(self.relations, self.contexts, self.synonyms)

    @kept
    def latest(self):
        return G.session_latest(self.graph, self.relations)

    @kept
    def named(self):
        return self.top.filter("rank <= 2").select("query_id", F.when(F.col("rank") == 1, F.lower("src")).otherwise(F.col("dst")).alias("entity"))

    @kept
    def seeds(self):
        phrases = P.phrase_seeds(self.top, self.nodes.select("query_id", "node"))
        return P.seeds(phrases, P.anchor_seeds(self.named, self.nodes, self.graph), P.session_seeds(self.fused, self.latest, TIME))

    @kept
    def ranks(self):
        return P.pagerank_local(self.graph, self.seeds, iterations=STEPS, tolerance=0.0)


def _round(df, *names, digits=6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


@query("SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos) WHERE rank <= 20")
def cosine_topk(t):
    from .operators.topk import top_k

    return _round(top_k(Flow(t).cos, 20, ["query_id"], [F.desc("score"), F.col("id")]), "score")


@query("SELECT query_id, session_id, round(score, 6) AS score FROM channela")
def channel_a_scores(t):
    return _round(Flow(t).a, "score")


@query("SELECT query_id, rank, src, relation, dst, round(score, 6) AS score FROM toptriples")
def channel_b_topk(t):
    return _round(Flow(t).top.select("query_id", "rank", "src", "relation", "dst", "score"), "score")


@query("SELECT query_id, session_id, round(score, 6) AS score, triples FROM channelb")
def channel_b_sessions(t):
    return _round(Flow(t).b, "score")


@query("SELECT t.query_id, m.session_id, round(max(t.score), 6) AS score FROM toptriples t JOIN edge_mentions m ON m.src = t.src AND m.dst = t.dst GROUP BY t.query_id, m.session_id")
def session_scores_multi(t):
    f = Flow(t)
    return _round(S.session_scores_multi(f.top, f.trade.of_pairs(f.top).select("src", "dst", "session_id").distinct()), "score")


@query("SELECT query_id, session_id, round(a_raw, 6) AS a_raw, round(b_raw, 6) AS b_raw, round(a_norm, 6) AS a_norm, round(fusion, 6) AS fusion, source, rank FROM fused")
def dual_channel_fusion(t):
    return _round(Flow(t).fused.select("query_id", "session_id", "a_raw", "b_raw", "a_norm", "fusion", "source", "rank"), "a_raw", "b_raw", "a_norm", "fusion")


_POOL = "(SELECT * FROM (SELECT query_id, session_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS r FROM {0}) WHERE r <= {1})"


@query(f"""SELECT * FROM (SELECT query_id, session_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, session_id) AS rank FROM (
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.session_id, b.session_id) AS session_id, CASE WHEN b.score IS NOT NULL THEN 0.7::double * coalesce(a.score, 0.0) + 0.3::double * b.score ELSE a.score END AS score
    FROM {_POOL.format('channela', 10)} a FULL JOIN {_POOL.format('channelb', 8)} b ON a.query_id = b.query_id AND a.session_id = b.session_id)) WHERE rank <= 15""")
def linear_merge(t):
    f = Flow(t)
    return _round(S.linear_merge(f.some_a, f.b), "score")


@query(f"""SELECT * FROM (SELECT query_id, session_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, session_id) AS rank FROM (
    SELECT query_id, session_id, sum(s) AS score FROM (SELECT query_id, session_id, 0.6::double / (60 + r) AS s FROM {_POOL.format('channela', 15)} UNION ALL SELECT query_id, session_id, 0.4::double / (60 + r) FROM {_POOL.format('channelb', 10)}) GROUP BY query_id, session_id)) WHERE rank <= 15""")
def rrf_fusion(t):
    f = Flow(t)
    return _round(S.rrf_fusion(f.some_a, f.b), "score")


@query("SELECT query_id, session_id, r AS rank, round(0.9::double * pow(0.9::double, r - 1), 6) AS place_score FROM (SELECT query_id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS r FROM channela)")
def rank_based_summary(t):
    return _round(S.rank_based(Flow(t).a).select("query_id", "session_id", "rank", "place_score"), "place_score")


@query("SELECT query_id, src, relation, dst, matched FROM relations")
def session_edges(t):
    return Flow(t).relations.select("query_id", "src", "relation", "dst", "matched")


@query("SELECT query_id, src, dst FROM contexts")
def context_edges(t):
    return Flow(t).contexts


@query("SELECT query_id, src, dst, round(score, 6) AS score FROM synonyms")
def synonym_edges(t):
    return _round(Flow(t).synonyms.select("query_id", "src", "dst", "score"), "score")


@query("SELECT query_id, src, dst, edge_type, round(weight, 6) AS weight FROM localgraph")
def local_graph(t):
    return _round(Flow(t).graph, "weight")


@query("SELECT m.query_id, m.src, m.dst, 'relation' AS edge_type, m.relation, m.weight FROM (SELECT f.query_id, x.src, x.dst, x.relation, count(*)::double AS weight FROM mentions x JOIN fused f ON f.session_id = x.session_id GROUP BY f.query_id, x.src, x.dst, x.relation) m UNION ALL SELECT query_id, src, dst, 'synonymy', 'synonym', round(score, 6) FROM synonyms")
def local_multigraph(t):
    f = Flow(t)
    return _round(G.local_multigraph(f.mentioned, f.fused, f.synonyms), "weight")


@query("SELECT query_id, session, latest FROM latest")
def session_latest_ts(t):
    return Flow(t).latest


@query("SELECT query_id, node, round(score, 6) AS score, rank FROM phrases")
def phrase_seeds(t):
    f = Flow(t)
    return _round(P.phrase_seeds(f.top, f.nodes.select("query_id", "node")), "score")


@query("SELECT query_id, node, round(score, 6) AS score FROM anchors")
def anchor_seeds(t):
    f = Flow(t)
    return _round(P.anchor_seeds(f.named, f.nodes, f.graph), "score")


@query("""SELECT query_id, node, round(0.2 * count(*), 6)::double AS score FROM (SELECT c.query_id, entity, n.node, row_number() OVER (PARTITION BY c.query_id, entity ORDER BY c.score DESC, n.node) AS rn FROM allentities n JOIN (
    SELECT query_id, 'first' AS entity, id, score FROM cos UNION ALL SELECT query_id, 'same', id, score FROM cos UNION ALL SELECT query_id, 'opposite', id, -score FROM cos) c ON c.id = n.vec) WHERE rn = 1 GROUP BY query_id, node""")
def anchor_argmax(t):
    f = Flow(t)
    sizes = cut(f.trade.customers())  # these alone keep all lower scores from being the best
    near, far = cut(S.within(f.cos, sizes, 1)), cut(S.within(f.cos.withColumn("score", -F.col("score")), sizes, 1))
    nodes = f.trade.entities_at(near.unionByName(far).select(F.col("id").alias("vec")))
    scores = [rows.select("query_id", F.lit(entity).alias("entity"), "id", "score") for rows, entity in ((near, "first"), (near, "same"), (far, "opposite"))]
    return _round(P.anchor_argmax(scores[0].unionByName(scores[1]).unionByName(scores[2]), nodes), "score")


@query("SELECT query_id, node, round(mass, 6) AS mass FROM seeds")
def ppr_seeds(t):
    return _round(Flow(t).seeds, "mass")


@query("SELECT query_id, node, round(m / sum(m) OVER (PARTITION BY query_id), 6) AS mass FROM (SELECT query_id, node, avg(score) AS m FROM (SELECT query_id, src AS node, score FROM toptriples UNION ALL SELECT query_id, dst, score FROM toptriples) GROUP BY query_id, node)")
def reset_probabilities(t):
    return _round(P.reset_probabilities(Flow(t).top), "mass")


@query("SELECT query_id, node, round(score, 6) AS score FROM ranks")
def ppr_scores(t):
    return _round(Flow(t).ranks, "score")


_HARMONIC = "CASE WHEN ppr_src + ppr_dst > 0 THEN 2 * ppr_src * ppr_dst / (ppr_src + ppr_dst) ELSE 0.0 END"
_TRIPLES = "SELECT query_id, rank, src, relation, dst FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, ordinal, src, dst) AS rank FROM ({})) WHERE rank <= 15"
_FINAL = f"SELECT *, 0.8::double * CASE WHEN max(ppr) OVER w - min(ppr) OVER w < 1e-12 THEN 1.0 ELSE (ppr - min(ppr) OVER w) / (max(ppr) OVER w - min(ppr) OVER w) END + 0.2::double * sim AS final FROM (SELECT b.*, {_HARMONIC} AS ppr, c.score AS sim FROM bothends b JOIN cos c ON c.query_id = b.query_id AND c.id = b.vec) WINDOW w AS (PARTITION BY query_id)"


@query(_TRIPLES.format("round(final, 9)", _FINAL))
def ppr_rank_triples(t):
    f = Flow(t)
    return P.rank_triples(S.with_scores(f.relations, f.questions, f.items, DIM), f.ranks, 15).select("query_id", "rank", "src", "relation", "dst")


@query(_TRIPLES.format("round(ppr, 9)", f"SELECT *, {_HARMONIC} AS ppr FROM bothends"))
def harmonic_rank(t):
    f = Flow(t)
    return P.rank_by_ends(f.relations, f.ranks, 15).select("query_id", "rank", "src", "relation", "dst")


@query(_TRIPLES.format("round(ppr, 9)", "SELECT *, least(ppr_src, ppr_dst) AS ppr FROM bothends"))
def min_rank(t):
    f = Flow(t)
    return P.rank_by_ends(f.relations, f.ranks, 15, "least").select("query_id", "rank", "src", "relation", "dst")


_PLACE = "SELECT query_id, place, src, relation, dst, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, {}) DESC, ordinal, src, dst) AS place FROM ({}))"
_GAP = "CASE WHEN coalesce(session_time, '') <> '' THEN abs(datediff('day', strptime(session_time, '%Y/%m/%d'), DATE '1998-05-02'))::double ELSE 0.0 END"


def _placed(df):
    return _round(df.select("query_id", "place", "src", "relation", "dst", "final"), "final")


@query(_PLACE.format(9, "SELECT t.*, 0.7::double * t.score + 0.3::double * coalesce(a.score, 0.0) AS final FROM toptriples t LEFT JOIN channela a ON a.query_id = t.query_id AND a.session_id = t.session_id"))
def simplerank(t):
    f = Flow(t)
    return _placed(R.simplerank(f.top, f.some_a, 0.3))


@query(_PLACE.format(9, f"SELECT *, (0.3::double * ss + 0.7::double * score) * exp(-pow(gap / greatest(median(gap) OVER (PARTITION BY query_id), 1.0), 0.5)) AS final FROM (SELECT t.*, CASE WHEN coalesce(a.score, 0.0) = 0 THEN 0.01::double ELSE a.score END AS ss, {_GAP} AS gap FROM toptriples t LEFT JOIN channela a ON a.query_id = t.query_id AND a.session_id = t.session_id)"))
def cognirank(t):
    f = Flow(t)
    return _placed(R.cognirank(f.top, f.some_a, "1998/05/02 (Sat) 02:21", 0.3))


@query(_PLACE.format(12, f"SELECT *, ppr * exp(-pow(gap / greatest(median(gap) OVER (PARTITION BY query_id), 1.0), 0.5)) AS final FROM (SELECT *, {_HARMONIC} AS ppr, {_GAP} AS gap FROM bothends)"))
def ppr_temporal_rerank(t):
    f = Flow(t)
    return _placed(R.ppr_temporal(P.rank_by_ends(f.relations, f.ranks, 10**9).drop("rank"), TIME))


@query("SELECT query_id, node, round(score, 6) AS score, rank FROM similarentities")
def similar_entities(t):
    return _round(Flow(t).similar, "score")


_TOUCH = "SELECT s.query_id, e.*, min(s.rank) AS entity_rank FROM edges e JOIN similarentities s ON s.node = e.src OR s.node = e.dst GROUP BY ALL"


@query(f"SELECT query_id, src, relation, dst, entity_rank FROM ({_TOUCH})")
def entity_triples(t):
    f = Flow(t)
    return S.entity_triples(f.touching, f.similar).select("query_id", "src", "relation", "dst", "entity_rank")


@query(f"SELECT query_id, rank, src, relation, dst, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, ordinal, src, dst) AS rank FROM (SELECT x.*, c.score + 0.2::double / x.entity_rank AS final FROM ({_TOUCH}) x JOIN cos c ON c.query_id = x.query_id AND c.id = x.vec)) WHERE rank <= 30")
def relevant_triples(t):
    f = Flow(t)
    return _round(S.relevant_triples(S.entity_triples(f.touching, f.similar), f.cos, 15).select("query_id", "rank", "src", "relation", "dst", "final"), "final")


@query("SELECT query_id, rank, src, relation, dst, round(score, 6) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.ordinal, s.src, s.dst) AS rank FROM scored s JOIN fused f ON f.query_id = s.query_id AND f.session_id = s.session_id) WHERE rank <= 15")
def session_triples(t):
    f = Flow(t)
    return _round(S.session_triples(f.edges, f.fused, f.questions, f.items, DIM, 15).select("query_id", "rank", "src", "relation", "dst", "score"), "score")


_TERMS = {0: ("User", "the assistant"), 1: (" system user", "nobody")}
_SHAPES = "(SELECT text, embedding::double[] AS vec FROM (SELECT lower(trim(speaker)) AS text FROM turns UNION SELECT lower(trim(term)) FROM asked) JOIN embeddings ON vec_id = length(text))"
_ASKED = ", ".join(f"({q}::bigint, '{w}')" for q, ws in _TERMS.items() for w in ws)


@query(f"""WITH asked AS (SELECT * FROM (VALUES {_ASKED}) v(query_id, term)), shapes AS {_SHAPES}
    SELECT query_id, session_id, round(avg(list_cosine_similarity(a.vec, k.vec)), 6) AS score FROM (SELECT DISTINCT session_id, lower(speaker) AS speaker FROM turns) s JOIN shapes k ON k.text = speaker, asked JOIN shapes a ON a.text = lower(trim(term)) GROUP BY query_id, session_id""")
def summary_key_similarity(t):
    keys = t["turns"].groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("keys"))
    terms = t.spark.createDataFrame([(q, w) for q, ws in _TERMS.items() for w in ws], "query_id bigint, term string")
    texts = t["turns"].select(F.col("speaker").alias("text")).unionByName(terms.select(F.col("term").alias("text"))).select(F.lower(F.trim("text")).alias("text")).distinct()
    vectors = texts.join(t["embeddings"].select("vec_id", F.col("embedding").alias("vec")), F.length("text") == F.col("vec_id")).select("text", "vec")
    relevant = keys.withColumn("query_id", F.explode(F.array(*(F.lit(q).cast("bigint") for q in _TERMS))))
    return _round(S.summary_key_similarity(relevant, terms, vectors), "score")


@query("SELECT query_id, session_id, round(score, 6) AS score, rank FROM (SELECT query_id, session_id, greatest(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY greatest(score, 0.0) DESC, session_id) AS rank FROM channela) WHERE rank <= 10")
def summary_entity_max(t):
    f = Flow(t)
    return _round(S.summary_entity_max(f.cos, f.sessions, 10), "score")


@query("SELECT query_id, string_agg(concat('(', src, ', ', relation, ', ', dst, ')'), '; ' ORDER BY rank) AS triples FROM toptriples GROUP BY query_id")
def format_triples(t):
    return X.format_triples(Flow(t).top, ["query_id"], "rank")


_STORED = "SELECT doc_id AS chunk_id, string_agg(content, ' ' ORDER BY turn) AS text FROM turns GROUP BY doc_id"


def _stored(t):
    return t["turns"].groupBy(F.col("doc_id").alias("chunk_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), " ").alias("text"))


@query(f"SELECT query_id, p.chunk_id, place, text FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r, chunk_id) AS place FROM (SELECT query_id, chunk_id, min(rank) AS r FROM toptriples GROUP BY query_id, chunk_id)) p LEFT JOIN ({_STORED}) s ON s.chunk_id = p.chunk_id WHERE place <= 8")
def chunks_for_triples(t):
    return X.chunks_for_triples(Flow(t).top, _stored(t), 8)


@query(f"SELECT w.chunk_id, coalesce(s.text, concat('Chunk ', cast(w.chunk_id AS string), ': ', coalesce(m.made, 'Content related to the retrieved triples'))) AS text FROM (SELECT DISTINCT chunk_id FROM edges) w LEFT JOIN ({_STORED}) s ON s.chunk_id = w.chunk_id LEFT JOIN (SELECT chunk_id, string_agg(concat(src, ' ', relation, ' ', dst), '; ' ORDER BY r) AS made FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ordinal, src, dst) AS r FROM edges) WHERE r <= 10 GROUP BY chunk_id) m ON m.chunk_id = w.chunk_id")
def chunk_fallback(t):
    return X.chunk_fallback(t["edges"].select("chunk_id").distinct(), _stored(t), t["edges"])


@query("""SELECT query_id, node, round(score, 6) AS score, CASE WHEN s < 0.33 THEN 'low' WHEN s < 0.66 THEN 'medium' ELSE 'high' END AS band FROM (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM (
    SELECT query_id, node, arg_min(score, rank) AS score FROM (SELECT query_id, rank, src AS node, score FROM toptriples UNION ALL SELECT query_id, rank, dst, score FROM toptriples) GROUP BY query_id, node) WINDOW w AS (PARTITION BY query_id))""")
def viz_bands(t):
    return _round(X.relevance_bands(Flow(t).top), "score")


@query("SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY p, entity) AS place FROM (SELECT query_id, entity, min(p) AS p FROM (SELECT query_id, src AS entity, rank AS p FROM toptriples UNION ALL SELECT query_id, lower(dst), rank FROM toptriples) WHERE entity IN (SELECT name FROM entities) GROUP BY query_id, entity) QUALIFY place <= 5")
def entity_lookup(t):
    f = Flow(t)
    wanted = f.top.select("query_id", F.col("rank").alias("place"), F.explode(F.array(F.col("src"), F.lower("dst"))).alias("entity")).groupBy("query_id", "entity").agg(F.min("place").alias("place"))
    ends = f.trade.of_nodes(wanted.select(F.col("entity").alias("node"))).select(F.explode(F.array("src", "dst")).alias("node"))
    return S.lookup_entities(wanted, ends, 5)


@query("SELECT f.query_id, f.session_id, s.session_time, row_number() OVER (PARTITION BY f.query_id ORDER BY f.session_id) AS place FROM fused f JOIN sessions s ON s.session_id = f.session_id")
def relevant_summaries(t):
    f = Flow(t)
    return X.relevant_summaries(f.fused, f.sessions.select("session_id", "session_time")).select("query_id", "session_id", "session_time", "place")


@query("SELECT DISTINCT query_id, chunk_id FROM toptriples")
def relationship_chunks(t):
    return X.relationship_chunks(Flow(t).top)


@query("SELECT query_id, session_id, round(score, 6) AS score, rank FROM (SELECT query_id, substr(node, 6) AS session_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, substr(node, 6)) AS rank FROM ranks WHERE starts_with(node, 'sess:')) WHERE rank <= 15")
def ppr_rank_sessions(t):
    return _round(P.rank_sessions(Flow(t).ranks, 15), "score")


@query()
def answer_flagship(t):
    from .plans.answering import answer_questions

    return answer_questions(t)
