"""Operator 7: packing by power-of-two decomposition.

A document's ids (its text's, then the end id) are split into pieces of ``max_length`` and the powers of two of the
rest, longest first. Each piece is a sequence of its own, so no sequence crosses documents and none needs padding;
pieces of equal length are written to the folder of their bucket, from which batches of one length are read.

``sequence_id`` is ``(partition << 33) + place``: unique, and the same when a lost task is run again. No shuffle.

Cases: null and empty texts are the end id alone; null ids stay null; repeated rows are packed each; an empty table
gives no rows; other columns are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._work import Workspace
from .tokens import encoder, groups, release

#: Pieces in a batch, each of at most ``max_length`` ids.
ROWS = 1 << 11
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
SCHEMA = "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long"


def pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many ids: as many of ``longest``, a power of two, as fit
    and the binary digits of the rest, greatest first."""
    digits = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    parts = np.concatenate((np.minimum(sizes[:, None] // longest, 1) * longest, sizes[:, None] % longest & digits), 1)  # one column for all whole ones
    times = np.concatenate((sizes[:, None] // longest, (parts[:, 1:] > 0).astype(np.int64)), 1)
    doc = np.repeat(np.arange(len(sizes)), times.sum(1))
    length = np.repeat(parts.ravel(), times.ravel())
    ends = np.cumsum(length)
    return doc, ends - length - (np.cumsum(sizes) - sizes)[doc], length


def packer(path: str, kind: str, end_id: int, longest: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, place = encoder(path, kind), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in groups(batch.column(1)):
                ids = enc.ids(texts)
                sizes = np.array([len(x) // 4 + 1 for x in ids], np.int64)
                data = end.join([*ids, b""])  # the pieces lie one after the other in it
                doc, start, length = pieces(sizes, longest)
                for lo in range(0, len(doc), ROWS):
                    own, n = length[lo : lo + ROWS], len(doc[lo : lo + ROWS])
                    base = int(length[:lo].sum()) * 4
                    offsets = np.concatenate(([0], np.cumsum(4 * own))).astype(np.int32)
                    cells = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data).slice(base, int(offsets[-1]))])
                    columns = [batch.column(0).take(pa.array(first + doc[lo : lo + ROWS])), pa.array(start[lo : lo + ROWS]), pa.array(own), cells, pa.array(sizes[doc[lo : lo + ROWS]]), pa.array(place + np.arange(n))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "length", "ids", "doc_tokens", "sequence_id"])
                    place += n
        release()

    return task


def pack(documents: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, max_length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket); ids are little-endian unsigned 32-bit."""
    if max_length & (max_length - 1):
        raise ValueError("max_length is a power of two")
    Workspace(documents.sparkSession, "packing")
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = docs.mapInArrow(packer(tokenizer, kind, end_id, max_length), SCHEMA)
    return rows.select(F.col("doc").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length: batches from one folder need no padding.

    A task keeps a file open for each of its lengths, a handful, so nothing is sorted or shuffled.
    """
    conf, before = packed.sparkSession.conf, packed.sparkSession.conf.get(WRITERS)
    conf.set(WRITERS, str(max(64, int(before))))
    try:
        packed.write.option("compression", "snappy").option("parquet.enable.dictionary", "false").partitionBy("bucket").parquet(path)
    finally:
        conf.set(WRITERS, before)


def read_buckets(spark: SparkSession, path: str, schema: StructType, length: int | None = None) -> DataFrame:
    """What ``write_buckets`` wrote; of one length, only its folder."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if length is None else rows.filter(F.col("bucket") == length)


def packed_buckets(documents: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``pack``, brought together by length: written to a folder for each bucket and read back."""
    packed, work = pack(documents, tokenizer, **options), Workspace(documents.sparkSession, "packing")
    write_buckets(packed, f"{work.path}/buckets")
    return read_buckets(work.spark, f"{work.path}/buckets", packed.schema)
