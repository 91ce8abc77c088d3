"""Operators against small models in plain Python."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.config import Config
from sessionloom.functions import text as T
from sessionloom.operators import chunking, context, graph, ppr, rerank, retrieval
from sessionloom.sources import ingest, tables
from sessionloom.sources.tables import Memory
from sessionloom.streaming import memory as streaming


def test_config():
    c = Config.parse({"fusion": {"alpha": 0.3, "unknown": 1}, "dataset": "x"}, dataset="y")
    assert (c.fusion.alpha, c.fusion.sessions, c.dataset) == (0.3, 15, "y")
    assert rerank.Weights(a=1.0, b=2.0).normalized() == {"a": 0.5, "b": 1.0}


def test_greedy_dedup_is_ordered_and_not_transitive(spark):
    names = ["a b c d", "b c d e", "A B C D", "c d e f", "x"]
    rows = spark.createDataFrame([(i, n, "T") for i, n in enumerate(names)] + [(9, "a b c d", "other")], "ordinal bigint, name string, entity_type string")
    got = {(r.entity_type, r.key): r.canonical for r in graph.dedup_greedy(rows, 0.6).collect()}
    assert got == {("t", "a b c d"): "a b c d", ("t", "b c d e"): "a b c d", ("t", "c d e f"): "c d e f", ("t", "x"): "x", ("other", "a b c d"): "a b c d"}


def _pagerank(edges, seeds, damping, steps):
    names = sorted({n for e in edges for n in e[:2]} | set(seeds))
    total = sum(seeds.values())
    p = {n: seeds.get(n, 0) / total for n in names}
    out = {n: sum(w for a, _, w in edges if a == n) for n in names}
    x = {n: 1 / len(names) for n in names}
    for _ in range(steps):
        lost = sum(x[n] for n in names if not out[n])
        x = {n: damping * (sum(x[a] * w / out[a] for a, b, w in edges if b == n) + lost * p[n]) + (1 - damping) * p[n] for n in names}
    return x


def test_pagerank_both_engines(spark):
    edges = [("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 2.0), ("c", "sink", 1.0), ("x", "y", 1.0), ("a", "b", 1.0)]
    seeds = {"a": 0.7, "x": 0.3}
    g = spark.createDataFrame([(q, *e) for q in (1, 2) for e in edges], "query_id bigint, src string, dst string, weight double")
    s = spark.createDataFrame([(q, n, m) for q in (1, 2) for n, m in seeds.items()], "query_id bigint, node string, mass double")
    expected = _pagerank(edges, seeds, 0.8, 12)
    for rows in (ppr.pagerank_local(g, s, iterations=12, tolerance=0.0), ppr.pagerank(g, s, iterations=12)):
        got = {(r.query_id, r.node): r.score for r in rows.collect()}
        assert {n for _, n in got} == set(expected)
        assert all(math.isclose(v, expected[n], abs_tol=1e-12) for (_, n), v in got.items())
        assert math.isclose(sum(v for (q, _), v in got.items() if q == 1), 1.0)


def test_empty_seed_share_is_even(spark):
    zero = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0)], "query_id bigint, node string, score double")
    assert {r.mass for r in ppr.seeds(zero, zero.limit(0), zero.limit(0)).collect()} == {0.5}


def test_upserts_replay_and_repeat(spark, tmp_path):
    rows = [(i, f"n{i % 3}", f"r{i % 2}", f"n{(i + 1) % 3}", f"S{i % 4}", f"2024/01/{i + 1:02d}", i % 5, i % 7) for i in range(12)]
    mentions = spark.createDataFrame(rows, "ordinal bigint, src string, relation string, dst string, session_id string, session_time string, chunk_id bigint, strength int")
    whole = sorted(map(str, graph.edge_state(mentions).collect()))
    halves = graph.upsert_edges(graph.edge_state(mentions.filter("ordinal < 6")), graph.edge_state(mentions.filter("ordinal >= 6")))
    assert sorted(map(str, halves.collect())) == whole
    store = Memory(spark, f"file://{tmp_path}/m")
    merge = streaming.upsert_batch(store)
    merge(mentions.filter("ordinal < 6"), 0)
    merge(mentions.filter("ordinal >= 6"), 1)
    merge(mentions.filter("ordinal >= 6"), 1)
    assert sorted(map(str, store.read("edges").collect())) == whole
    assert streaming.replay(mentions).count() == len(whole)
    other = Memory(spark, f"file://{tmp_path}/n")
    first = streaming.ingest(other, mentions.filter("ordinal < 6")).count()
    assert streaming.ingest(other, mentions).count() == first
    assert sorted(map(str, streaming.ingest(other, mentions.filter("ordinal >= 6"), "add").collect())) == whole
    assert streaming.ingest(other, mentions.filter("ordinal < 6"), "force").count() == first


def test_session_windows_batch(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00', 1.0), (1, TIMESTAMP '2024-01-01 00:20:00', 2.0), (1, TIMESTAMP '2024-01-01 02:00:00', 4.0) t(user_id, ts, value)")
    assert sorted((r.events, r.value) for r in streaming.session_windows(rows).collect()) == [(1, 4.0), (2, 3.0)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text("ab ", max_size=4)), max_size=9))
def test_chunks_cover_turns_once(spark, turns):
    rows = spark.createDataFrame([(1, "S", "t", k, s, c) for k, (s, c) in enumerate(turns)], "doc_id bigint, session_id string, session_time string, turn int, speaker string, content string")
    text = "\n".join(r.text for r in chunking.dialog_chunks(rows).orderBy("chunk_id").collect())
    assert text == "\n".join(f"{s.capitalize()}: {c}" for s, c in turns if s != "system" and c.strip())


def test_turn_parser_keeps_and_fixes_the_last_quote(spark):
    raw = '"system": "x""user": "say "hi" now""assistant": "a "quoted" end"'
    rows = spark.createDataFrame([(raw,), (None,)], "t string")
    compat = rows.select(chunking.turn_parser()("t").alias("x")).collect()
    assert [(m.speaker, m.content) for m in compat[0].x] == [("user", 'say "hi" now'), ("assistant", "a")]
    fixed = rows.select(chunking.turn_parser(named=True, compat=False)("t").alias("x")).first()
    assert fixed.x[-1].content == 'a "quoted" end'


def test_document_chunks_cover_words(spark):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(9))
    got = chunking.document_chunks(spark.createDataFrame([(1, "T", text), (2, "", None)], "doc_id bigint, title string, text string"), 200, 40).orderBy("chunk_id").collect()
    whole = f"T\n\n{text}"
    assert all(len(r.text) <= 200 and whole[r.start_idx : r.end_idx] == r.text for r in got)
    assert {w for r in got for w in r.text.split()} == set(whole.split())


def test_fusion_ties_and_missing_channels(spark):
    a = spark.createDataFrame([(1, f"s{i}", 0.5) for i in range(4)], "query_id bigint, session_id string, score double")
    b = spark.createDataFrame([(1, "z", 0.9)], a.schema)
    got = [(r.session_id, r.source) for r in retrieval.dual_channel_fusion(a, b, pool=2).orderBy("rank").collect()]
    assert got == [("s0", "A"), ("s1", "A"), ("z", "B")]
    assert [r.session_id for r in retrieval.linear_merge(a, b, pools=(2, 2)).orderBy("rank").collect()] == ["s0", "s1", "z"]
    assert retrieval.dual_channel_fusion(a.limit(0), b.limit(0)).count() == 0


def test_local_graph_priority_and_contexts(spark):
    rel = spark.createDataFrame([(1, "a", "b")], "query_id bigint, src string, dst string")
    syn = rel.withColumn("score", F.lit(0.9)).unionByName(spark.createDataFrame([(1, "b", "a", 0.9)], "query_id bigint, src string, dst string, score double"))
    got = {(r.src, r.dst): (r.edge_type, r.weight) for r in graph.local_graph(rel, rel.limit(0), syn).collect()}
    assert got == {("a", "b"): ("relation", 1.0), ("b", "a"): ("synonym", 1.8)}


def test_chunk_zero_counts(spark):
    triples = spark.createDataFrame([(1, 1, 0), (1, 2, 7), (1, 3, 0)], "query_id bigint, rank bigint, chunk_id bigint")
    stored = spark.createDataFrame([(0, "zero")], "chunk_id bigint, text string")
    assert [(r.chunk_id, r.text) for r in context.chunks_for_triples(triples, stored, 5).orderBy("place").collect()] == [(0, "zero"), (7, None)]


def test_readers(spark, tmp_path):
    item = {"question_id": "q", "question_type": "multi-session", "question": "?", "answer": "", "question_date": "2023/05/20 (Sat)", "haystack_dates": ["2023/05/01 x", "2023/05/02"], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "hi"}], []], "answer_session_ids": ["s1"]}
    (tmp_path / "a.json").write_text(json.dumps([item]))
    items = ingest.read_items(spark, f"file://{tmp_path}/a.json")
    assert [tuple(r)[2:] for r in ingest.item_sessions(items).collect()] == [("s1", "2023/05/01", '"user": "hi"')]
    question = ingest.item_questions(items).first()
    assert (question.answer, question.label, question.question_time) == ("", "", "2023/05/20 (Sat)")
    assert ingest.scalar_origin(ingest.item_questions(items)).first().origin == '"s1"'
    (tmp_path / "one.jsonl").write_text(json.dumps({"session_id": "s", "session_time": "2023-05-20 00:00:00", "context": "c"}))
    assert [tuple(r)[:3] for r in ingest.read_corpus(spark, f"file://{tmp_path}/one.jsonl").select("doc_id", "session_id", "session_time").collect()] == [(0, "s", "2023/05/20")]
    with pytest.raises(ValueError):
        ingest.read_items(spark, f"file://{tmp_path}/one.jsonl")
    group = {"conversation": {"session_1": json.dumps([{"speaker": "A", "text": "t", "blip_caption": "cat"}]), "session_1_date_time": "1:56 pm on 8 May, 2023", "session_3": "[]"}, "qa": [{"question": "?", "answer": "0", "evidence": ["D1:3"], "category": "1"}]}
    (tmp_path / "b.json").write_text(json.dumps([group]))
    groups = ingest.read_groups(spark, f"file://{tmp_path}/b.json").withColumn("group_id", F.lit(1))
    assert [tuple(r) for r in ingest.group_sessions(groups).collect()] == [(1, 1, "D1", "2023/05/08", '"A": "t (attached is cat)"')]


def test_answers_use_names_synonyms_times_and_summaries(spark):
    from sessionloom.plans.answering import answer, build_memory

    said = ["Alice met Robert in Paris. Robert likes Chess very much indeed.", "Zoe visited Oslo with Yann. Yann likes Skiing in winter snow.", "robert! Then ROBERT saw Berlin. Berlin pleased Carla a lot."]
    turns = spark.createDataFrame([(i, f"S{i}", f"2024/01/{1 + 9 * i:02d}", 0, "user", f"so. {x}") for i, x in enumerate(said)], "doc_id bigint, session_id string, session_time string, turn int, speaker string, content string")
    memory = build_memory(turns)
    schema = "query_id bigint, question string, question_time string"
    seeds, ranked = [], ppr.seeds
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ppr, "seeds", lambda *x: seeds.append(x) or ranked(*x))
        rows = answer(spark.createDataFrame([(1, "What of Chess and Skiing?", "2024/01/01"), (2, "What of Chess and Skiing?", "2024/03/01 (Fri)"), (3, "what then", None)], schema), memory).collect()
    _, anchors, sessions = seeds[0]
    assert {(r.query_id, r.node) for r in anchors.collect()} == {(q, n) for q in (1, 2) for n in ("Chess", "Skiing")}
    by_time = {(r.query_id, r.node): r.score for r in sessions.collect()}
    assert any(by_time[1, n] != by_time[2, n] for q, n in by_time if q == 1)
    prompts = {r.query_id: r.prompt for r in rows}
    assert all("Session summaries:\nSession S" in prompts[q] and prompts[q].count("\n  Keys: ") == 2 for q in (1, 2))
    assert "Question time: 2024/03/01 (Fri)\n" in prompts[2] and "Question time" not in prompts[3]
    from sessionloom.plans.answering import local_synonyms

    nodes = spark.createDataFrame([(1, "Robert"), (1, "ROBERT"), (1, "Oslo"), (2, "robert")], "query_id bigint, node string")
    assert {(r.query_id, r.src, r.dst, round(r.score, 6)) for r in local_synonyms(nodes, 64, 0.8).collect()} == {(1, "Robert", "ROBERT", 1.0), (1, "ROBERT", "Robert", 1.0)}


def test_summaries_come_back_from_json(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "2024/01/01", "a, b", [(2, "t2", "x2"), (1, "t1", "x1")]), ("s2", None, None, [])], "session_id string, session_time string, keys string, themes array<struct<i:int,title:string,summary:string>>")
    tables.summaries_json(rows).write.text(f"file://{tmp_path}/summaries")
    back = {r.session_id: r for r in tables.read_summaries(spark, f"file://{tmp_path}/summaries").collect()}
    assert [tuple(x) for x in back["s1"].themes] == [(1, "t1", "x1"), (2, "t2", "x2")] and back["s1"]["keys"] == "a, b" and not back["s2"].themes


def test_rendered_texts(spark):
    """The formats of summaries, user lines and chunks, with the cases that tell near variants apart."""
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    themes = F.array(F.struct(F.lit(10).alias("i"), F.lit("late").alias("title"), F.lit("").alias("summary")), F.struct(F.lit(2).alias("i"), F.lit("early").alias("title"), F.lit("sum").alias("summary")))
    assert one(T.format_summary(F.lit("s"), F.lit(None).cast("string"), F.lit("k"), themes)) == "Session s (unknown):\n  Keys: k\n  theme_2: early\n    Summary: sum\n  theme_10: late"
    said = {"User: hi\nAssistant: yo\n  User:\n\tUser: there ": "hi there", "Here are some. You should go now. I like long walks! We met in the park? And so on forever": "I like long walks We met in the park", "short": "short", "": "", "x " * 101 + "you should": ("x " * 101)[:200] + "..."}
    for text, expected in said.items():
        assert one(T.user_utterances(F.lit(text))) == expected
    assert one(context.with_time(F.lit("t"), F.lit("2024"))) == "2024 t" and one(context.with_time(F.lit(""), F.lit("2024"))) == ""
    wanted = spark.createDataFrame([(0,), (1,), (2,)], "chunk_id bigint")
    chunks = spark.createDataFrame([(0, "text"), (1, "")], "chunk_id bigint, text string")
    edges = spark.createDataFrame([(1, 1, "a", "likes", "b"), (1, 2, "a", "", "c"), (1, 3, "b", "knows", "c")], "chunk_id bigint, ordinal bigint, src string, relation string, dst string")
    assert {r.chunk_id: r.text for r in context.chunk_fallback(wanted, chunks, edges).collect()} == {0: "text", 1: "Chunk 1: a likes b; b knows c", 2: "Chunk 2: Content related to the retrieved triples"}
