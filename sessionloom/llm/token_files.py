"""Operator 8: token ids in files of Simple-8b words.

A word's upper four bits select how many ids of how many bits its lower 60 hold: the most of the next ids that fit.
Selector 15 is an escape: the next word is one whole value of 60 bits or more. Codes restart every ``BLOCK`` ids and
each segment of a file lists where its blocks begin, so any block can be decoded alone and all at once with array
operations. Segments (header, document ids, their counts, block offsets, words) follow one another in a file; files and
the documents in them are in ascending order of id.

Cases: null and empty texts are the end id alone; repeated ids are written each; null ids come first and stay null; an empty table gives no rows; a
text of any length is encoded whole; other columns are ignored. A lost task writes its file anew, equal to the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import reading, writing
from ._work import NO_ID, Workspace, shuffle_width
from .tokens import encoder, groups, release

MAGIC = 0x5338424C53544F4B
#: Ids a word and bits an id for the selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK, SEGMENT = 1024, 1 << 19
_IDS_OF = np.array([0, *COUNTS, 1])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    if len(values) and values.max() < 1 << 53:  # exact in a double
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    out = np.ones(len(values), np.uint8)
    for k in (1 << j for j in range(5, -1, -1)):
        big = values >> np.uint64(k) > 0
        out += np.where(big, np.uint8(k), np.uint8(0))
        values = np.where(big, values >> np.uint64(k), values)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit values."""
    n = len(values)
    values = values.astype(np.uint64)
    blocks = -(-n // BLOCK)
    if not n:
        return values, np.zeros(0, np.uint64)
    bits, left = np.full(blocks * BLOCK, 64, np.uint8), np.full(blocks * BLOCK, 0, np.int16)
    bits[:n] = _bits(values)
    left[:n] = BLOCK - np.arange(n) % BLOCK
    left[(blocks - 1) * BLOCK : n] = n - np.arange((blocks - 1) * BLOCK, n)
    selector = np.full(len(bits), 15, np.uint8)
    most, width = bits, 1
    for s in range(13, -1, -1):  # ever more ids: the last that fits is kept
        while width < COUNTS[s]:
            step = min(width, COUNTS[s] - width)
            grown = most.copy()
            grown[:-step] = np.maximum(most[:-step], most[step:])
            most, width = grown, width + step
        fits = most <= WIDTHS[s]
        if not fits.any():  # nor do more ids of fewer bits
            break
        selector[fits & (left >= COUNTS[s])] = s + 1
    jump = _IDS_OF[selector]
    at, ends, chain = np.arange(blocks) * BLOCK, np.minimum((np.arange(blocks) + 1) * BLOCK, n), []
    while len(at):
        chain.append(at)
        at = at + jump[at]
        live = at < ends
        at, ends = at[live], ends[live]
    at = np.sort(np.concatenate(chain))
    chosen = selector[at]
    size = 1 + (chosen == 15)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        if s == 15:
            words[place[mine] + 1] = values[at[mine]]
            continue
        for k in range(COUNTS[s - 1]):
            words[place[mine]] |= values[at[mine] + k] << np.uint64(k * WIDTHS[s - 1])
    return words, place[np.searchsorted(at, np.arange(blocks) * BLOCK)].astype(np.uint64)


def decode(words: np.ndarray) -> np.ndarray:
    """The values of the words of one or more whole blocks."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (chosen == 15).any():  # what follows an escape is no word of its own, and may look like an escape
        k = 0
        for k in np.flatnonzero(chosen == 15).tolist():
            if not raw[k]:
                raw[k + 1] = True
    escaped = (chosen == 15) & ~raw
    count = np.where(raw, 0, _IDS_OF[chosen])
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s in np.unique(chosen[~raw]).tolist():
        if s == 15:
            out[place[escaped]] = words[np.flatnonzero(escaped) + 1]
            continue
        mine = np.flatnonzero((chosen == s) & ~raw)
        mask = np.uint64((1 << WIDTHS[s - 1]) - 1)
        for k in range(COUNTS[s - 1]):
            out[place[mine] + k] = words[mine] >> np.uint64(k * WIDTHS[s - 1]) & mask
    return out


def segment(docs: list[int], ids: list[bytes]) -> bytes:
    """One segment: magic, documents, ids, blocks, words; then the four arrays."""
    values = np.frombuffer(b"".join(ids), "<u4")
    words, blocks = encode(values)
    head = np.array([MAGIC, len(docs), len(values), len(blocks), len(words)], "<u8")
    return b"".join((head.tobytes(), np.array([NO_ID if x is None else x for x in docs], "<i8").tobytes(), np.array([len(x) // 4 for x in ids], "<u8").tobytes(), blocks.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def segments(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, counts, block offsets, words) of each segment of a file."""
    while head := file.read(40):
        magic, n, _, blocks, words = np.frombuffer(head, "<u8").tolist()
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        yield np.frombuffer(file.read(8 * n), "<i8"), np.frombuffer(file.read(8 * n), "<u8"), np.frombuffer(file.read(8 * blocks), "<u8"), np.frombuffer(file.read(8 * words), "<u8")


def ids_at(blocks: np.ndarray, words: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` ids from place ``first`` of a segment, decoding only the blocks that hold them."""
    lo, hi = first // BLOCK, -(-(first + count) // BLOCK)
    own = words[int(blocks[lo]) : int(blocks[hi]) if hi < len(blocks) else len(words)]
    return decode(own)[first - lo * BLOCK :][:count]


def writer(root: str, path: str, kind: str, end_id: int):
    """Task function over sorted (doc, text): writes the partition's file, returns (file, number, docs, ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, kind), np.array([end_id], "<u4").tobytes()
        part, docs, ids, size, n_docs, n_ids = TaskContext.get().partitionId(), [], [], 0, 0, 0
        target = f"{root}/part-{part:06d}.s8b"
        with writing(target) as out:
            for batch in batches:
                for first, texts in groups(batch.column(1)):
                    own = [x + end for x in enc.ids(texts)]
                    docs += batch.column(0)[first : first + len(texts)].to_pylist()
                    ids += own
                    size += sum(map(len, own)) // 4
                    if size >= SEGMENT:
                        out.write(segment(docs, ids))
                        n_docs, n_ids, docs, ids, size = n_docs + len(docs), n_ids + size, [], [], 0
            if docs:
                out.write(segment(docs, ids))
                n_docs, n_ids = n_docs + len(docs), n_ids + size
        release()
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([part], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["file", "number", "docs", "ids"])

    return task


def write_token_files(documents: DataFrame, root: str, tokenizer: str, kind: str = "word", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below ``root`` and returns their manifest (file, number, docs, ids)."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    width = shuffle_width(documents.sparkSession)
    return docs.repartitionByRange(width, "doc").sortWithinPartitions("doc").mapInArrow(writer(root, tokenizer, kind, end_id), "file string, number long, docs long, ids long")


def read_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (file, base): (doc, start, ids) of every document in the files."""
    for batch in batches:
        for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with reading(name) as file:
                for docs, counts, blocks, words in segments(file):
                    ends = np.cumsum(counts.astype(np.int64))
                    starts = ends - counts.astype(np.int64)
                    for lo in range(0, len(docs), 4096):
                        first, last = int(starts[lo]), int(ends[lo : lo + 4096][-1])
                        ids = ids_at(blocks, words, first, last - first).astype("<u4")  # the blocks of these documents only
                        own = [ids[a - first : b - first].tobytes() for a, b in zip(starts[lo : lo + 4096].tolist(), ends[lo : lo + 4096].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs[lo : lo + 4096], mask=docs[lo : lo + 4096] == NO_ID), pa.array(base + starts[lo : lo + 4096]), pa.array(own, pa.binary())], ["doc", "start", "ids"])
                    base += int(ends[-1]) if len(ends) else 0


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of all files; start counts the ids of all documents before. One manifest row per file."""
    spark, base, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("number").collect():
        rows.append((r.file, base))
        base += r.ids
    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read_file, "doc long, start long, ids binary").withColumnRenamed("doc", id_col)


def token_files(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back: (doc_id, start, ids)."""
    work = Workspace(documents.sparkSession, "token-files")
    manifest = work.save(write_token_files(documents, f"{work.path}/files", tokenizer, id_col=id_col, text_col=text_col), "manifest")
    return read_token_files(manifest, id_col)

