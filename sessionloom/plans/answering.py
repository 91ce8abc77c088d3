"""Answering a batch of questions: every step is keyed by the question, so all of them run as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.similarity import dot, norm
from ..functions.text import format_summary, summary_text
from ..lineage import cut
from ..operators import chunking, context, graph, ppr, retrieval
from ..providers import answerer, embedder, extract_chunks, extractor, summarizer


def build_memory(turns: DataFrame, dim: int = 64) -> dict[str, DataFrame]:
    """Chunks, edges, edge mentions and embedded summaries of turns (doc_id, session_id, session_time, turn, speaker, content)."""
    embed, chunks = embedder(dim), chunking.dialog_chunks(turns)
    chunks = cut(chunks)
    entities, mentions = extract_chunks(chunks.select("chunk_id", "doc_id", "session_id", "session_time", "text"))
    mentions = cut(mentions)  # a provider's output is computed once
    edges = graph.build_edges(graph.dedup_relationships(mentions))
    edges = cut(edges.withColumn("embedding", embed(F.concat_ws(" ", "src", "relation", "dst"))))
    whole = chunks.groupBy("session_id", "session_time").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    made = whole.withColumn("s", summarizer()("text")).select("session_id", "session_time", "s.keys", "s.themes")
    summaries = context.legacy_summary(made)
    summaries = cut(summaries.withColumn("embedding", embed(summary_text("session_id", "session_time", "keys", "themes"))))
    return {"chunks": chunks, "entities": entities, "edges": edges, "edge_mentions": mentions.select("src", "dst", "session_id").distinct(), "summaries": summaries}


def local_nodes(local: DataFrame) -> DataFrame:
    """(query_id, node, ordinal) of the entity nodes of local relations, by first appearance."""
    places = (F.struct(F.col(end).alias("node"), (F.col("ordinal") * 2 + k).alias("ordinal")) for k, end in enumerate(("src", "dst")))
    return local.select("query_id", F.explode(F.array(*places)).alias("e")).groupBy("query_id", "e.node").agg(F.min("e.ordinal").alias("ordinal"))


def local_synonyms(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(query_id, src, dst, score) of the nodes (query_id, node) of one local graph whose names' vectors reach the threshold.

    A name is embedded once; only nodes of one question's graph are compared, so the pairs grow with the questions.
    """
    names = cut(nodes.select("node").distinct().withColumn("embedding", embedder(dim)("node")))
    spots = nodes.select("query_id", "node").join(names.withColumn("size", norm("embedding")), "node")
    left, right = (spots.select("query_id", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "embedding", "size"))) for x in "ab")
    score = F.try_divide(dot("embedding_a", "embedding_b", dim), F.col("size_a") * F.col("size_b"))
    similar = left.join(right, "query_id").filter("node_a < node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), score.alias("score"))
    return graph.synonym_edges(nodes.select("query_id", "node", F.col("node").alias("vec")), cut(similar.filter(F.col("score") >= threshold).distinct()))


def answer(questions: DataFrame, memory: dict[str, DataFrame], dim: int = 64, config: Config | None = None) -> DataFrame:
    """(query_id, question, answer, prompt, top_session_ids) of questions (query_id, question, question_time)."""
    c = config or Config()
    asked = cut(questions.withColumn("embedding", embedder(dim)("question")))
    edges, summaries = memory["edges"], memory["summaries"]
    vectors = edges.select(F.struct("src", "dst").alias("id"), "embedding")
    scores = cut(retrieval.cosine_scores(asked, vectors, dim))
    scored = edges.drop("embedding").join(scores.select("query_id", "id.src", "id.dst", "score"), ["src", "dst"])
    top = cut(retrieval.channel_b(scored, c.fusion.top_triples))
    a = retrieval.cosine_scores(asked, summaries.select(F.col("session_id").alias("id"), "embedding"), dim).withColumnRenamed("id", "session_id")
    fused = cut(retrieval.dual_channel_fusion(a, retrieval.channel_b_sessions(top), c.fusion.top_summaries, c.fusion.alpha, c.fusion.sessions))
    local = cut(graph.session_edges(edges.drop("embedding"), memory["edge_mentions"], fused))
    near = graph.context_edges(edges, memory["edge_mentions"], fused)
    ordered = cut(local_nodes(local))
    synonyms = local_synonyms(ordered, dim, c.graph.synonym_threshold)
    net = cut(graph.local_graph(local, near, synonyms, c.graph.relation_weight, c.graph.context_weight, c.graph.synonym_factor))
    phrases = ppr.phrase_seeds(top, ordered.select("query_id", "node"), c.graph.phrase_seeds)
    latest = graph.session_latest(net, local)
    named = asked.select("query_id", F.explode(extractor()("question")["entities"]["entity"]).alias("entity"))
    anchors = ppr.anchor_seeds(named, ordered, net, c.graph.anchor_mass)
    sessions = ppr.session_seeds(fused, latest, asked.select("query_id", "question_time"), c.graph.session_weight, c.graph.decay_exponent)
    seed = ppr.seeds(phrases, anchors, sessions)
    ranks = cut(ppr.pagerank_local(net, seed, c.graph.damping, c.graph.max_iterations, c.graph.tolerance))
    semantic = scores.select("query_id", "id.src", "id.dst", "score")
    best = cut(ppr.rank_triples(local.join(semantic, ["query_id", "src", "dst"]), ranks, 15, c.graph.beta_ppr, c.graph.beta_semantic))
    facts = context.format_triples(best, ["query_id"], "rank")
    passages = context.chunks_for_triples(best, memory["chunks"], 5).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.concat(F.lit("Chunk "), x["place"].cast("string"), F.lit(": "), x["text"])), "\n").alias("passages"))
    tops = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "session_id"))), lambda x: x["session_id"]).alias("top_session_ids"))
    chosen = context.relevant_summaries(ppr.rank_sessions(ranks, c.fusion.prompt_summaries), summaries)
    blocks = chosen.select("query_id", F.struct("place", format_summary("session_id", "session_time", "keys", "themes").alias("block")).alias("s"))
    told = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["block"]), "\n").alias("summaries"))
    rows = asked.select("query_id", "question", "question_time").join(facts, "query_id", "left").join(passages, "query_id", "left").join(tops, "query_id", "left").join(told, "query_id", "left")
    rows = rows.withColumn("prompt", context.prompt(*(F.col(x) for x in ("question", "triples", "passages", "summaries", "question_time"))))
    return rows.select("query_id", "question", answerer()("question", F.coalesce("passages", "triples")).alias("answer"), "prompt", "top_session_ids")


def answer_questions(t) -> DataFrame:
    """The first user turn of every hundredth conversation, at that conversation's time, as a question to the memory of all conversations."""
    questions = t["turns"].filter("turn = 0 AND doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("content").alias("question"), F.col("session_time").alias("question_time"))
    out = answer(questions, build_memory(t["turns"]))
    return out.select("query_id", "question", "answer", F.length("prompt").alias("prompt_chars"), F.array_join("top_session_ids", ",").alias("top_session_ids"))
