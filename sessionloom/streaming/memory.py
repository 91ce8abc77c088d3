"""Incremental memory: micro-batches of mentions merged into versioned tables, and windows over an event stream."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import edge_state, upsert_edges
from ..sources.tables import Memory


def upsert_batch(memory: Memory):
    """A foreachBatch function: the batch's edges merged into the last version, written as the batch's own version.

    A batch that comes again replaces its version from the one before, so each is merged once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        last = memory.version("edges")
        if last is not None and last >= number + 1:
            return
        base, delta = memory.read("edges"), edge_state(batch)
        memory.write("edges", delta if base is None else upsert_edges(base, delta), number + 1)

    return merge


def ingest(memory: Memory, mentions: DataFrame, mode: str = "load") -> DataFrame:
    """The memory's edges: ``load`` builds them only where there are none, ``force`` anew, ``add`` merges into what is there."""
    if mode not in ("load", "force", "add"):
        raise ValueError(mode)
    last = memory.version("edges")
    if last is None or mode == "force":
        memory.write("edges", edge_state(mentions), 0 if last is None else last + 1)
    elif mode == "add":
        upsert_batch(memory)(mentions, last)
    return memory.read("edges")


def stream_mentions(spark: SparkSession, source: str, schema, root: str, checkpoint: str, files_per_batch: int = 1):
    """Starts the stream from a folder of mention files to the memory below ``root``; ends when all files are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(upsert_batch(Memory(spark, root))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(mentions: DataFrame, batches: int = 3) -> DataFrame:
    """The edges after the mentions arrived in files, read as a stream: (src, dst, relation, strength, sessions)."""
    spark = mentions.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
    base = f"{root.rstrip('/')}/memory-{spark.sparkContext.applicationId}-{id(mentions):x}"
    mentions.repartitionByRange(batches, "ordinal").write.mode("overwrite").parquet(f"{base}/in")
    stream_mentions(spark, f"{base}/in", mentions.schema, f"{base}/tables", f"{base}/offsets").awaitTermination()
    edges = Memory(spark, f"{base}/tables").read("edges")
    return edges.select("src", "dst", "relation", "strength", F.size("session_ids").alias("sessions"))


def latest_by_key(updates: DataFrame, key: str, order: str) -> DataFrame:
    """A batch's updates with the newest row of each key: what a keyed upsert of summaries takes."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert_summaries(base: DataFrame | None, updates: DataFrame, order: str) -> DataFrame:
    """Summaries with those of updated sessions replaced."""
    fresh = latest_by_key(updates, "session_id", order)
    return fresh if base is None else base.join(fresh.select("session_id"), "session_id", "left_anti").unionByName(fresh)


def session_windows(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of a stream or table of events (an extension): start, end, events and value of each."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")
