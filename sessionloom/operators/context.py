"""Prompt context: summaries, chunks and triples as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import triple_string
from .topk import first_seen, ranked, top_k

NONE = "None available"
#: Fixed value: what stands for a chunk of which neither text nor edges are known.
UNKNOWN = "Content related to the retrieved triples"


def legacy_summary(summaries: DataFrame) -> DataFrame:
    """(session_id, session_time, keys, themes) with keys as one string and themes numbered from 1.

    Of (session_id, session_time, keys array, themes array<struct<title, summary>>); without themes, one default theme
    and the date alone.
    """
    blank = F.coalesce(F.size("themes"), F.lit(-1)) <= 0
    default = F.array(F.struct(F.lit(1).alias("i"), F.lit("General").alias("title"), F.lit("").alias("summary")))
    themes = F.transform("themes", lambda t, i: F.struct((i + 1).alias("i"), t["title"].alias("title"), t["summary"].alias("summary")))
    return summaries.select("session_id", F.when(blank, F.split_part("session_time", F.lit(" "), F.lit(1))).otherwise(F.col("session_time")).alias("session_time"), F.array_join(F.filter("keys", lambda k: F.trim(k) != ""), ", ").alias("keys"), F.when(blank, default).otherwise(themes).alias("themes"))


def format_triples(triples: DataFrame, by: list[str], order: str) -> DataFrame:
    """One string for each key: its triples in order, joined by ``; ``; incomplete triples are left out."""
    rows = triples.withColumn("_t", triple_string("src", "relation", "dst")).filter("_t IS NOT NULL")
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "; ").alias("triples"))


def chunks_for_triples(triples: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, place, text): the first k distinct chunks of each query's triples (query_id, rank, chunk_id).

    Chunk 0 counts. A chunk that is not stored is put together from the query's triples of that chunk.
    """
    seen = first_seen(triples.filter("chunk_id IS NOT NULL").select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "rank")
    picked = top_k(seen, k, ["query_id"], [F.col("rank"), F.col("chunk_id")], "place")
    return picked.join(chunks.select("chunk_id", "text"), "chunk_id", "left").select("query_id", "chunk_id", "place", "text")


def chunk_fallback(wanted: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(chunk_id, text): the stored text, else the first k named edges of the chunk, else a sentence that says what it is."""
    chunks = chunks.filter("text <> ''")
    missing = wanted.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    lines = ranked(edges.filter("relation <> ''").join(missing, "chunk_id", "left_semi"), ["chunk_id"], [F.col("ordinal"), F.col("src"), F.col("dst")]).filter(F.col("rank") <= k)
    made = lines.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "src", "relation", "dst").alias("s")))), lambda x: x["s"]), "; ").alias("made"))
    rows = wanted.join(chunks.select("chunk_id", "text"), "chunk_id", "left").join(made, "chunk_id", "left")
    return rows.select("chunk_id", F.coalesce("text", F.concat(F.lit("Chunk "), F.col("chunk_id").cast("string"), F.lit(": "), F.coalesce("made", F.lit(UNKNOWN)))).alias("text"))


def prompt(question: Column, triples: Column, chunks: Column, summaries: Column, question_time: Column | None = None) -> Column:
    """The prompt of a question; a missing part is named as such, the summaries' and the time's only appear where there is one."""
    part = lambda title, c: F.concat(F.lit(f"{title}:\n"), F.coalesce(F.nullif(c, F.lit("")), F.lit(NONE)), F.lit("\n\n"))
    with_summaries = F.when(F.coalesce(summaries, F.lit("")) != "", part("Session summaries", summaries)).otherwise("")
    asked = F.lit("") if question_time is None else F.when(F.coalesce(question_time, F.lit("")) != "", F.concat(F.lit("Question time: "), question_time, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("Answer from the memory below; say so if it is not enough.\n\n"), part("Facts", triples), part("Passages", chunks), with_summaries, asked, F.lit("Question: "), question)


def relevance_bands(triples: DataFrame) -> DataFrame:
    """(query_id, node, score, band) of (query_id, rank, src, dst, score): a node has its first triple's score, scaled."""
    ends = triples.select("query_id", "rank", F.explode(F.array("src", "dst")).alias("node"), "score")
    nodes = first_seen(ends, ["query_id", "node"], "rank")
    span = nodes.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return nodes.join(span, "query_id").select("query_id", "node", "score", F.when(scaled < 0.33, "low").when(scaled < 0.66, "medium").otherwise("high").alias("band"))


def relevant_summaries(sessions: DataFrame, summaries: DataFrame, by_rank: bool = False) -> DataFrame:
    """Summaries of the ranked sessions (query_id, session_id, rank) with their place: in order of the summaries' ids, or by rank."""
    rows = summaries.join(sessions.select("query_id", "session_id", "rank"), "session_id")
    return ranked(rows, ["query_id"], [F.col("rank") if by_rank else F.col("session_id")], "place")


def relationship_chunks(triples: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the distinct chunks of relationships."""
    return triples.filter("chunk_id IS NOT NULL").select("query_id", "chunk_id").distinct()


def with_time(text: Column, session_time: Column, enabled: bool = True) -> Column:
    """A chunk's text after its session's time and a space, if there are both."""
    both = (F.coalesce(session_time, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "")
    return F.when(both, F.concat_ws(" ", session_time, text)).otherwise(text) if enabled else text
