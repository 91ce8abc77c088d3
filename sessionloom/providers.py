"""Model providers: interfaces as vectorised functions, with deterministic offline ones.

The offline providers make runs repeatable without a model; they do not reproduce a model's quality. A provider of one's
own is a function of a pandas Series with the same schema; errors go to a status, not to an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "struct<entity:string,type:string>"
RELATION = "struct<src:string,dst:string,relation:string,strength:int>"
EXTRACTED = f"struct<entities:array<{ENTITY}>,relations:array<{RELATION}>,status:string>"
SUMMARY = "struct<keys:array<string>,themes:array<struct<title:string,summary:string>>,status:string>"


def embedder(dim: int = 64):
    """Hashed bags of words, scaled to unit length; blank text is null."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, tuple[int, float]] = {}

        def one(text: str | None) -> np.ndarray | None:
            vector = np.zeros(dim)
            for word in re.findall(r"\w+", (text or "").lower()):
                if word not in places:
                    digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                    places[word] = int.from_bytes(digest[:4], "little") % dim, 1.0 if digest[4] & 1 else -1.0
                at, sign = places[word]
                vector[at] += sign
            size = np.linalg.norm(vector)
            return (vector / size).astype(np.float32) if size else None

        for texts in batches:
            yield texts.map(one)

    return embed


def with_embeddings(rows: DataFrame, text: Column, embed, column: str = "embedding") -> DataFrame:
    """Fills missing embeddings; only those rows pass through the provider."""
    have = rows.filter(F.col(column).isNotNull())
    return have.unionByName(rows.filter(F.col(column).isNull()).withColumn(column, embed(text)))


def extractor():
    """Capitalised words as entities, neighbours in a sentence as relations."""

    @F.pandas_udf(EXTRACTED)
    def extract(texts: pd.Series) -> pd.DataFrame:
        def one(text: str | None) -> dict:
            try:
                entities, relations = {}, []
                for sentence in re.split(r"[.!?\n]+", text or ""):
                    names = list(dict.fromkeys(re.findall(r"\b[A-ZÀ-Þ][\w'-]{2,}", sentence)))
                    entities |= dict.fromkeys(names, "concept")
                    relations += [{"src": a, "dst": b, "relation": "mentioned with", "strength": 1 + len(sentence) % 10} for a, b in zip(names, names[1:])]
                return {"entities": [{"entity": k, "type": v} for k, v in entities.items()], "relations": relations, "status": "ok"}
            except Exception as error:  # a provider's failure is a row's status
                return {"entities": [], "relations": [], "status": str(error)}

        return pd.DataFrame([one(x) for x in texts], columns=["entities", "relations", "status"])

    return extract


def summarizer(keys: int = 5, themes: int = 3):
    """The most frequent long words as keys, the first long sentences as themes."""

    @F.pandas_udf(SUMMARY)
    def summarize(texts: pd.Series) -> pd.DataFrame:
        def one(text: str | None) -> dict:
            words = Counter(w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 4)
            best = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:keys]]
            sentences = [s.strip() for s in re.split(r"[.!?\n]+", text or "") if len(s.strip()) > 20][:themes]
            return {"keys": best, "themes": [{"title": " ".join(s.split()[:3]), "summary": s} for s in sentences], "status": "ok"}

        return pd.DataFrame([one(x) for x in texts], columns=["keys", "themes", "status"])

    return summarize


def extract_chunks(chunks: DataFrame, extract=None) -> tuple[DataFrame, DataFrame]:
    """(entity mentions, relation mentions) of chunks, with their ids, sessions and times; incomplete ones are left out."""
    rows = chunks.withColumn("x", (extract or extractor())("text"))
    key = ["chunk_id", "doc_id", "session_id", "session_time"]
    place = (F.col("chunk_id") * 4096).cast("bigint")
    entities = rows.select(*key, F.posexplode("x.entities").alias("i", "e")).select((place + F.col("i")).alias("ordinal"), F.col("e.entity").alias("name"), F.col("e.type").alias("entity_type"), *key)
    relations = rows.select(*key, F.posexplode("x.relations").alias("i", "r")).select((place + F.col("i")).alias("ordinal"), "r.src", "r.relation", "r.dst", F.coalesce(F.col("r.strength"), F.lit(1)).alias("strength"), *key)
    return entities.filter("name <> '' AND entity_type <> ''"), relations.filter("src <> '' AND dst <> '' AND relation <> ''")


def answerer():
    """The sentence of the context with the most words of the question; stands in for an answering model."""

    @F.pandas_udf("string")
    def answer(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(question: str | None, context: str | None) -> str:
            words = set(re.findall(r"\w+", (question or "").lower()))
            sentences = [s.strip() for s in re.split(r"[.!?\n;]+", context or "") if s.strip()]
            return max(sentences, key=lambda s: (len(words & set(re.findall(r"\w+", s.lower()))), -sentences.index(s)), default="")

        return pd.Series([one(q, c) for q, c in zip(questions, contexts, strict=True)])

    return answer
