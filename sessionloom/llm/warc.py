"""Operator 9: WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress alone; a file ends with a skippable frame that lists every frame's
compressed and plain size (the public seekable format), so a reader finds any frame from the file's end. The index maps
each record to its file, frame and place in the frame.

Of equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is stored; the others are revisit
records with the digest, the length and a reference to it. Digests are grouped before they meet their pages, so a
payload that a third of all pages share is one row a task.

Cases: null payloads are empty; null addresses have no target header, control characters in them are escaped; an empty
table writes no file; rows of one id are written each, and equal ones are not revisits of one another; rows with a null
id are responses that no record refers to, and their id is read back as null; other columns are ignored. A lost task
writes its file anew.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import reading, writing
from ._work import NO_ID, Workspace, shuffle_width

#: Least bytes of a payload that is stored once, plain bytes of a frame, and plain bytes of a file.
MIN_REVISIT, FRAME, FILE = 100, 1 << 18, 1 << 28
#: Fixed values of the seekable format and of the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: int, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, next place) of the record at a place."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    return headers, data[end + 4 : end + 4 + size], end + 8 + size


class Bundle:
    """Writes frames and, at the end, their seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.coder, self.sizes, self.open, self.plain = stream, zstandard.ZstdCompressor(level=level), [], bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, place in it) of what is added."""
        if self.open and len(self.open) + len(data) > FRAME:
            self.flush()
        place = len(self.sizes), len(self.open)
        self.open += data
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.coder.compress(bytes(self.open))
            self.stream.write(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.plain += len(self.open)
            self.open = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(file) -> list[tuple[int, int]]:
    """(place, compressed size) of each frame, read from the end of a file."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    table, frames, at = file.read(width * count), [], 0
    for k in range(count):
        packed = struct.unpack_from("<I", table, width * k)[0]
        frames.append((at, packed))
        at += packed
    return frames


def read_record(name: str, frame: int, place: int) -> tuple[dict[str, str], bytes]:
    """The headers and block of one record, decompressing its frame only."""
    with reading(name) as file:
        at, size = seek_table(file)[frame]
        file.seek(at)
        headers, block, _ = parse(zstandard.ZstdDecompressor().decompress(file.read(size)), place)
    return headers, block


def writer(root: str, date: str):
    """Task function over (page, url, payload, digest, first): writes bundles, returns (page, file, frame, place, length)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in zip(*(batch.column(k) for k in range(5)), strict=True))
        row = next(rows, None)
        while row is not None:
            name, index = f"{root}/part-{part:06d}-{number:04d}.warc.zst", []
            with writing(name) as stream:
                bundle = Bundle(stream)
                while row is not None and bundle.plain < FILE:
                    page, url, payload, digest, first = (x.as_py() for x in row)
                    data = record(page, url, (payload or "").encode(), digest, first, date)
                    index.append((page, *bundle.add(data), len(data)))
                    row = next(rows, None)
                bundle.close()
            number += 1
            for lo in range(0, len(index), 20_000):
                pages, frames, places, lengths = zip(*index[lo : lo + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array([name] * len(pages)), pa.array(frames, pa.int64()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())], ["page", "file", "frame", "place", "length"])

    return task


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles below ``root``; the index (page, file, frame, place, length)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("page", F.coalesce("page", F.lit(NO_ID)))
    named = rows.select("page", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")).distinct()
    firsts = named.filter(f"size >= {MIN_REVISIT} AND page <> {NO_ID}").groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first")
    marked = named.join(firsts, "digest", "left").select("page", "digest", F.expr(f"CASE WHEN size >= {MIN_REVISIT} AND first <> page AND page <> {NO_ID} THEN first END").alias("first"))
    marked = marked.groupBy("page").agg(F.collect_list(F.struct("digest", "first")).alias("own"))  # one, but for an id with several payloads
    width = shuffle_width(pages.sparkSession)
    found = F.expr("CASE WHEN size(own) = 1 THEN own[0] ELSE filter(own, x -> x.digest = sha2(payload, 256))[0] END")
    dealt = rows.join(marked, "page").withColumn("own", found).select("page", "url", "payload", "own.digest", "own.first").repartition(width, "page").sortWithinPartitions("page")
    return dealt.mapInArrow(writer(root, date), "page long, file string, frame long, place long, length long")


def read_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (file): (page, url, payload bytes, digest, type, first, payload) of every record."""
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with reading(name) as file:
                for at, size in seek_table(file):
                    file.seek(at)
                    data, place, rows = zstandard.ZstdDecompressor().decompress(file.read(size)), 0, []
                    while place < len(data):
                        headers, block, place = parse(data, place)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        full = int(http.decode().rpartition("Content-Length: ")[2])
                        digest, kind = headers["WARC-Payload-Digest"].partition(":")[2], headers["WARC-Type"]
                        if kind == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                        number = [int(x.rstrip(">").rpartition(":")[2]) if x else None for x in (headers["WARC-Record-ID"], headers.get("WARC-Refers-To"))]
                        rows.append((number[0], headers.get("WARC-Target-URI"), full, digest, kind, number[1], payload.decode() if kind == "response" else None))
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["page", "url", "size", "digest", "kind", "first", "payload"])


def read_archives(files: DataFrame) -> DataFrame:
    """(page, url, size, digest, kind, first, payload) of the records of the named files."""
    width = shuffle_width(files.sparkSession)
    return files.select("file").distinct().repartition(width).mapInArrow(read_file, "page long, url string, size long, digest string, kind string, first long, payload string")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    work = Workspace(pages.sparkSession, "warc")
    index = work.save(write_archives(pages, f"{work.path}/files", id_col, url_col, payload_col), "index")
    return read_archives(index).select(F.nullif("page", F.lit(NO_ID)).alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("first").alias("refers_to"))
