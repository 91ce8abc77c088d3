"""Dialogue and document chunking."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = "array<struct<pos:int,speaker:string,content:string>>"
#: Separators of the document splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


def turn_parser(named: bool = False, compat: bool = True):
    """A vectorised function: serialised dialogue to turns, for user and assistant or for any speakers.

    A turn runs from its marker to the next; it ends at its last quote, the final turn at its first (``compat``) or
    last quote. Inner role markers' remains go, white space is single, empty turns are dropped.
    """
    marker = re.compile(r'"([^"]+)"\s*:\s*"' if named else r'"(user|assistant)"\s*:\s*"')

    def turns(text: str | None) -> list[dict]:
        found, out = list(marker.finditer(text or "")), []
        for k, m in enumerate(found):
            last = k + 1 == len(found)
            body = text[m.end() : len(text) if last else found[k + 1].start()]
            cut = body.find('"') if last and compat else body.rfind('"')
            body = re.sub(r'\s*"\s*"[^"]*":\s*', "", (body[:cut] if cut >= 0 else body).strip())
            body = " ".join(body.split())
            if body:
                out.append({"pos": len(out), "speaker": m[1], "content": body})
        return out

    @F.pandas_udf(TURNS)
    def parse(text: pd.Series) -> pd.Series:
        return text.map(turns)

    return parse


def pair_turns(turns: DataFrame, session: list[str], fixed: bool = False) -> DataFrame:
    """Turns of (session.., turn, speaker, content) with the number ``pair`` of their chunk, from 0 in each session.

    Two roles: a user and the assistant after it; whoever starts alone is alone; other roles are left out. ``fixed``:
    the first two turns, the next two, whoever speaks.
    """
    window = Window.partitionBy(*session).orderBy("turn")
    if fixed:
        return turns.withColumn("pair", F.floor((F.row_number().over(window) - 1) / 2).cast("bigint"))
    known = turns.filter(F.col("speaker").isin("user", "assistant"))
    starts = (F.col("speaker") == "user") | (F.coalesce(F.lag("speaker").over(window), F.lit("")) != "user")
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumn("_start", starts.cast("long")).withColumn("pair", F.sum("_start").over(running) - 1).drop("_start")


def dialog_chunks(turns: DataFrame, fixed: bool = False) -> DataFrame:
    """(chunk_id, doc_id, session_id, session_time, text, pair and role flags) of turns (doc_id, session_id, session_time, turn, speaker, content)."""
    key = ["doc_id", "session_id", "session_time"]
    label = F.concat(F.col("speaker") if fixed else F.initcap("speaker"), F.lit(": "), F.col("content"))
    rows = pair_turns(turns.filter(F.trim("content") != ""), key, fixed).withColumn("line", F.struct("turn", label.alias("text")))
    chunks = rows.groupBy(*key, "pair").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n").alias("text"),
        F.max((F.col("speaker") == "user").cast("int")).alias("has_user"), F.max((F.col("speaker") == "assistant").cast("int")).alias("has_assistant"))
    return numbered(chunks, "doc_id", ["doc_id", "session_id", "pair"])


#: Documents that are numbered together.
PART = 4096


def numbered(chunks: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Adds ``chunk_id``, a running number from 0 in the given order, which starts with the document.

    Chunks are numbered within ranges of PART documents and shifted by the sizes of the ranges before: one row for each
    range, not each document, meets in one task.
    """
    parted = chunks.withColumn("_part", F.floor(F.col(doc) / PART))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_place", inside).join(offsets, "_part").withColumn("chunk_id", (F.col("_before") + F.col("_place") - 1).cast("bigint")).drop("_place", "_before", "_part")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, words, sessions, mean words, and chunks of a user, an assistant, or both."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint")
    user, assistant = F.col("has_user") == 1, F.col("has_assistant") == 1
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(words).alias("words"), F.countDistinct("session_id").alias("sessions"), F.round(F.avg(words), 6).alias("avg_words"),
        F.count_if(user & ~assistant).alias("user_only"), F.count_if(assistant & ~user).alias("assistant_only"), F.count_if(user & assistant).alias("complete"))


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """One row: whether all chunks are valid, and how many lack an id, a session or text."""
    bad = F.col("chunk_id").isNull() | F.col("doc_id").isNull() | (F.coalesce("session_id", F.lit("")) == "") | (F.trim(F.coalesce("text", F.lit(""))) == "")
    return chunks.agg((F.count_if(bad) == 0).alias("valid"), F.count_if(bad).alias("invalid_chunks"))


def window_chunks(docs: DataFrame, size: int, overlap: int, text: Column | str = "text") -> DataFrame:
    """Fixed windows of ``size`` characters that overlap: (doc_id, pos, start_idx, end_idx, text)."""
    step, t = size - overlap, F.col(text) if isinstance(text, str) else text
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - overlap) / step) - 1).cast("int")
    rows = docs.filter(F.length(t) > 0).select("doc_id", t.alias("_t"), F.posexplode(F.sequence(F.lit(0), last)).alias("pos", "k"))
    start = F.col("k") * step
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), start.cast("bigint").alias("start_idx"), F.least(start + size, F.length("_t")).cast("bigint").alias("end_idx"), F.substr("_t", start + 1, F.lit(size)).alias("text"))


def splitter(size: int, overlap: int):
    """A vectorised function: text to pieces of at most ``size`` characters, split at the coarsest separator that does.

    Pieces come with their offsets, found forward from the end of the one before less the overlap, and their words.
    """

    def split(text: str, separators: tuple[str, ...]) -> list[str]:
        sep = next((s for s in separators if s and s in text), "")
        rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
        parts = [p for p in (text.split(sep) if sep else list(text)) if p]
        out, small = [], []
        for part in parts:
            if len(part) <= size:
                small.append(part)
                continue
            out += merge(small, sep)
            small = []
            out += split(part, rest or ("",))
        return out + merge(small, sep)

    def merge(parts: list[str], sep: str) -> list[str]:
        out, held, total = [], [], 0
        for part in parts:
            extra = len(part) + (len(sep) if held else 0)
            if held and total + extra > size:
                out.append(sep.join(held))
                while held and (total > overlap or total + len(part) + len(sep) > size):
                    total -= len(held.pop(0)) + (len(sep) if held else 0)
            total += len(part) + (len(sep) if held else 0)
            held.append(part)
        return [x for x in (*out, sep.join(held)) if x.strip()]

    @F.pandas_udf("array<struct<text:string,start_idx:int,end_idx:int,token_count:int>>")
    def pieces(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            rows, at = [], 0
            for piece in split(text, SEPARATORS) if text else []:
                found = text.find(piece, at)
                start = found if found >= 0 else at
                rows.append({"text": piece, "start_idx": start, "end_idx": start + len(piece), "token_count": len(piece.split())})
                at = max(start, start + len(piece) - overlap)
            return rows

        return texts.map(one)

    return pieces


def document_chunks(docs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(chunk_id, doc_id, title, text, start_idx, end_idx, token_count) of (doc_id, title, text)."""
    whole = F.when(F.coalesce("title", F.lit("")) != "", F.concat_ws("\n\n", "title", "text")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "title", F.posexplode(splitter(size, overlap)(whole)).alias("pos", "c"))
    return numbered(rows.select("doc_id", "title", "pos", "c.*"), "doc_id", ["doc_id", "pos"]).drop("pos")
