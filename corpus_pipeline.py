"""A corpus-preparation pipeline: quality rules, near duplicates, decontamination, PII, packing.

Each stage reads what the one before it wrote, works on all of it and puts its decisions into effect; all but the last
return the columns of ``documents``. The quality rules judge and keep rows as they are. The other rejecting stages name
rows by id and take them out by an anti-join: a broadcast where the ids are few, a shuffled join beyond that.

Cases: null and empty texts fail the quality rules; where an id repeats or is null, rows are numbered in order of id and
text first, so that every row has its own decision (equal rows are near duplicates, one stays); empty tables of documents
give no rows, an empty benchmark rejects none; other columns are kept through all stages but the last; texts of any
length are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm._work import Workspace, discarding, numbered
from sessionloom.llm.decontam import contaminated
from sessionloom.llm.ngram_join import near_duplicate_classes
from sessionloom.llm.packing import packed_buckets
from sessionloom.llm.pii import replace_pii
from sessionloom.llm.quality import VERDICT, judged
from sessionloom.llm.registry import pii_key, tokenizer_path

#: Most ids that are broadcast.
BROADCAST_IDS = 500_000


def named(docs: DataFrame, work: Workspace) -> tuple[DataFrame, str]:
    """The documents and the column that names each row: ``doc_id``, or a number of its own if ids repeat or are null."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    clear = lambda name: name if name not in docs.columns else clear(f"_{name}")
    row = clear("number_of_row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    return work.save(numbered(rows, ["id", "digest", "tie"], work, "rows").select("whole.*", F.col("number").alias(row)), "named"), row


def without(docs: DataFrame, row: str, ids: DataFrame, work: Workspace) -> DataFrame:
    """The documents whose name is not among ``ids``."""
    gone = work.save(ids.select(row).distinct(), "rejected")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, row, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return judged(docs, keep=docs.columns).filter(VERDICT).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    work = Workspace(spark, "pipeline-duplicates")
    rows, row = named(docs, work)
    return without(rows, row, near_duplicate_classes(rows, row).filter(F.col(row) != F.col("component_id")), work).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    work = Workspace(spark, "pipeline-benchmark")
    rows, row = named(docs, work)
    return without(rows, row, contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row), work).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates."""
    return replace_pii(docs, pii_key(spark)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length."""
    packed = packed_buckets(docs, tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Token ids cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with discarding(spark):  # a stage's tables go once its result is written, and so does the result before it
            docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
