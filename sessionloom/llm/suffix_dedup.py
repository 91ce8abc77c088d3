"""Operator 2: removal of repeated passages with difference-cover suffix sorting, one bucket at a time.

Every byte covered by a 100-byte string that also starts earlier (smaller id, or same document and smaller offset) is
removed; strings are judged on the input, matches stay within documents and may overlap.

1. Whole copies of an earlier text of 100 bytes or more go first, by digest.
2. Every 100-byte window of the other texts has an anchor, its leftmost least 40-byte hash. Equal windows have equal
   anchors at equal places, so only windows whose anchor's hash occurs again can repeat (no window is missed).
3. Such windows, cut out as short slices, are dealt out by anchor: all windows equal to one another meet in one task.
   Slices equal within a map chunk are reduced to their first before they travel.
4. A task sorts its windows block by block and, in a block, one bucket (shared first eight bytes) after the other:
   by their first 24 bytes, then ties by the ranks of a difference-cover sample modulo 21. For any two positions some
   shift below 21 brings both into the sample, so one rank comparison settles a tie of any length. Memory is bounded
   by the block.
5. Of equal windows all but the first are marked; marks become spans, and spans are cut out of the texts.

Cases: null is empty; texts under 100 bytes and empty tables lose nothing; bytes are compared as they are, so a cut
may fall inside a character (the digest is of the bytes); repeated rows of one id and text are one document, reported
for each and not repeated by itself; the texts of one id are in the order of their digests, those of a null id come
first; a text of 2**28 bytes or more raises an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Workspace, by_document, routes, semi_by_id, shuffle_width
from ._words import mix, powers, text_chunks

#: Bytes of a repeated string, of an anchor, and the anchors' places in a window.
SPAN, ANCHOR = 100, 40
PLACES = SPAN - ANCHOR + 1
#: Windows sorted at once.
BLOCK = 200_000
#: A difference cover modulo 21 (every difference modulo 21 occurs).
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_POS = np.uint64((1 << 28) - 1)
_SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_ANCHORS = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("off", "<u4")])
_SLICES = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("off", "<u4"), ("windows", "<u4")])
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def anchored(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor hash, slice hash) of each run of windows with one anchor in a chunk."""
    n = len(data)
    if n > int(_POS):
        raise ValueError(f"a text of {n} bytes: places are counted in 28 bits")
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[ANCHOR:] - total[: n - ANCHOR + 1]) * down[: n - ANCHOR + 1])
    least = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
    at = (least & _POS).astype(np.int64)
    row = np.searchsorted(bounds, np.arange(len(at)), "right") - 1
    ok = np.arange(len(at)) + SPAN <= bounds[row + 1]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = np.concatenate(([0], np.cumsum(ok)))
    windows = sums[np.append(first[1:], len(at))] - sums[first]
    ends = first + windows + SPAN - 1
    whole = mix((total[ends] - total[first]) * down[first] + windows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return row[first], first, windows, grams[at[first]], whole


def _packed(rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by bucket of their hash, the buckets and where each starts."""
    to = (mix(rows["hash"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    keys, first = np.unique(to[order], return_index=True)
    return order, keys, first


def anchors(keys: list[int]):
    """Task function over (doc, text): anchors by bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(parts) if parts else np.zeros(0, _ANCHORS)
            parts.clear()
            order, found, first = _packed(rows, len(keys))
            rows = rows[order]
            return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found], pa.int32()), pa.array([x.tobytes() for x in np.split(rows, first[1:])] if len(found) else [], pa.binary())], ["bucket", "rows"])

        for batch in batches:
            for ids, data, bounds in text_chunks(batch.column(0), batch.column(1)):
                row, first, _, hashes, _ = anchored(data, bounds)
                part = np.empty(len(row), _ANCHORS)
                part["hash"], part["doc"], part["off"] = hashes, ids[row], first - bounds[row]
                parts.append(part)
                if sum(map(len, parts)) > 500_000:
                    yield flush()
        yield flush()

    return task


def _by_doc(doc: np.ndarray, values: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """One row a document with its values packed; both arrays sorted by document."""
    keys, first = np.unique(doc, return_index=True)
    packed = [x.tobytes() for x in np.split(values, first[1:])] if len(keys) else []
    for lo in range(0, len(keys), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 20_000].astype(np.int64)), pa.array(packed[lo : lo + 20_000], pa.binary())], ["doc", name])


def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, packed offsets) of this task's anchors whose hash occurs more than once."""
    parts = [np.frombuffer(row.as_buffer(), _ANCHORS) for batch in batches for row in batch.column(1)]
    rows = np.concatenate(parts) if parts else np.zeros(0, _ANCHORS)
    del parts
    order = np.argsort(rows["hash"], kind="stable")
    hashes = rows["hash"][order]
    same = hashes[1:] == hashes[:-1]
    again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(rows) else order
    doc, off = rows["doc"][again], rows["off"][again]
    order = np.argsort(doc, kind="stable")
    yield from _by_doc(doc[order], off[order], "offs")


def slices(keys: list[int]):
    """Task function over (doc, text, recurring offsets): slices by bucket of their anchor, and marks (bucket -1 - n)."""

    def cut(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        return data[np.arange(len(shift)) + shift]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, bounds in text_chunks(batch.column(0), batch.column(1)):
                row, first, windows, hashes, whole = anchored(data, bounds)
                off = first - bounds[row]
                live = np.zeros(len(row), bool)
                for k in range(len(ids)):
                    lo, hi = np.searchsorted(row, (k, k + 1))
                    wanted = np.frombuffer(b"".join(batch.column(2)[at + k].as_py()), "<u4")
                    live[lo:hi] = np.isin(off[lo:hi], wanted)
                at += len(ids)
                row, first, windows, hashes, whole, off = (x[live] for x in (row, first, windows, hashes, whole, off))
                if not len(row):
                    continue
                order = np.lexsort((off, ids[row], whole, hashes))
                row, first, windows, hashes, whole, off = (x[order] for x in (row, first, windows, hashes, whole, off))
                same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (whole[1:] == whole[:-1]) & (windows[1:] == windows[:-1])))
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                lengths = windows + SPAN - 1
                twins = np.flatnonzero(same)
                if len(twins):  # equal hashes are confirmed byte by byte
                    size = lengths[twins]
                    unlike = np.add.reduceat(cut(data, first[twins], size) != cut(data, first[head[twins]], size), np.concatenate(([0], np.cumsum(size)[:-1])))
                    same[twins[unlike > 0]] = False
                marks = np.flatnonzero(same)
                if len(marks):
                    span = np.stack([off[marks], off[marks] + lengths[marks]], 1).astype("<u4")
                    order = np.argsort(ids[row[marks]], kind="stable")
                    for done in _by_doc(ids[row[marks]][order], span[order], "spans"):
                        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in mix(done.column(0).to_numpy().astype(np.uint64)) % np.uint64(len(keys))], pa.int32()), done.column(0), done.column(1), pa.array([b""] * len(done), pa.binary())], ["bucket", "doc", "meta", "bytes"])
                rest = np.flatnonzero(~same)
                meta = np.empty(len(rest), _SLICES)
                meta["hash"], meta["doc"], meta["off"], meta["windows"] = hashes[rest], ids[row[rest]], off[rest], windows[rest]
                order, found, begin = _packed(meta, len(keys))
                meta, rest = meta[order], rest[order]
                text = cut(data, first[rest], lengths[rest])
                cuts = np.concatenate(([0], np.cumsum(lengths[rest])))[begin]
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found], pa.int32()), pa.nulls(len(found), pa.int64()), pa.array([x.tobytes() for x in np.split(meta, begin[1:])], pa.binary()), pa.array([x.tobytes() for x in np.split(text, cuts[1:])], pa.binary())], ["bucket", "doc", "meta", "bytes"])

    return task


def cover_ranks(words: np.ndarray, last: int) -> np.ndarray:
    """Ranks, at the positions of the difference-cover sample, of the next 168 bytes (0 elsewhere and past the end)."""
    sample = np.flatnonzero(_IN_COVER[np.arange(last) % PERIOD])
    ranks = np.zeros(last + 16 * PERIOD, np.int64)

    def dense(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        step = np.zeros(len(order), bool)
        step[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], 0)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(step) + 1
        return out

    if len(sample):
        ranks[sample] = dense([words[sample], words[sample + 8], words[sample + 16] >> np.uint64(24)])
        for width in (PERIOD, 2 * PERIOD, 4 * PERIOD):
            ranks[sample] = dense([ranks[sample], ranks[sample + width]])
    return ranks


def sorted_windows(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows in the order of their first 100 bytes, and whether each equals the one before it."""
    padded = np.concatenate((text, np.zeros(2 * SPAN + 8, np.uint8))).astype(np.uint64)
    words = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : len(words) + k]
    ranks = cover_ranks(words, len(text))
    order = starts[np.argsort(words[starts], kind="stable")]
    lead = words[order]
    edges = np.concatenate(([0], np.flatnonzero(lead[1:] != lead[:-1]) + 1, [len(order)]))
    sizes = np.diff(edges)
    equal = np.zeros(len(order), bool)
    crowd = np.repeat(sizes > 1, sizes)  # suffix buckets of one window are in place
    at = np.flatnonzero(crowd)
    if not len(at):
        return order, equal
    own, bucket = order[at], np.repeat(np.arange(len(sizes)), sizes)[at]
    inner = np.lexsort((words[own + 16], words[own + 8], bucket))
    own, bucket = own[inner], bucket[inner]
    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (words[own[1:] + 8] != words[own[:-1] + 8]) | (words[own[1:] + 16] != words[own[:-1] + 16])))
    group = np.cumsum(new) - 1  # ties over 24 bytes
    todo = np.arange(len(own))
    while len(todo):
        head = np.concatenate(([True], group[todo][1:] != group[todo][:-1]))
        count = np.diff(np.append(np.flatnonzero(head), len(todo)))
        keep = np.repeat(count, count) > 1
        todo, head = todo[keep], head[keep]
        if not len(todo):
            break
        pivot = np.repeat(own[todo[head]], count[count > 1])
        shift = _SHIFT[pivot % PERIOD, own[todo] % PERIOD]
        side = np.sign(ranks[own[todo] + shift] - ranks[pivot + shift])
        inner = np.lexsort((side, group[todo]))
        own[todo], side, old = own[todo[inner]], side[inner], group[todo]
        change = np.concatenate(([False], (old[1:] == old[:-1]) & (side[1:] != side[:-1])))
        fresh = np.zeros(len(own), np.int64)
        fresh[todo[change]] = 1
        group = group + np.cumsum(fresh)
        todo = todo[side != 0]
    order[at] = own
    near = np.flatnonzero(np.concatenate(([False], bucket[1:] == bucket[:-1])))
    a, b = own[near], own[near - 1]
    for k in (*range(8, SPAN - 8, 8), SPAN - 8):
        same = words[a + k] == words[b + k]
        near, a, b = near[same], a[same], b[same]
    equal[at[near]] = True
    return order, equal


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (bucket, doc, meta, bytes): spans (doc, packed start and end) of windows that occur earlier."""
    metas, texts = [], []
    for batch in batches:
        for doc, meta, text in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if doc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([meta.as_py()], pa.binary())], ["doc", "spans"])
            else:
                metas.append(np.frombuffer(meta.as_buffer(), _SLICES))
                texts.append(np.frombuffer(text.as_buffer(), np.uint8))
    if not metas:
        return
    meta, text = np.concatenate(metas), np.concatenate(texts)
    del metas, texts
    lengths = meta["windows"].astype(np.int64) + SPAN - 1
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(meta["hash"], kind="stable")
    hashes = meta["hash"][order]
    fence = np.concatenate((np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))), [len(order)]))
    load = np.concatenate(([0], np.cumsum(meta["windows"][order].astype(np.int64))))
    g = 0
    while g < len(fence) - 1:  # blocks of whole anchor groups
        h = max(g + 1, int(np.searchsorted(load[fence], load[fence[g]] + BLOCK, "right")) - 1)
        pick = order[fence[g] : fence[h]]
        g = h
        if len(pick) < 2:
            continue
        size, count = lengths[pick], meta["windows"][pick].astype(np.int64)
        local = np.concatenate(([0], np.cumsum(size)[:-1]))
        own = text[np.arange(size.sum()) + np.repeat(begin[pick] - local, size)]
        slot = np.repeat(np.arange(len(pick)), count)
        inside = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
        starts = local[slot] + inside
        where = np.zeros(len(own), np.int64)
        where[starts] = np.arange(len(starts))
        ranked, equal = sorted_windows(own, starts)
        slot, inside = slot[where[ranked]], inside[where[ranked]]
        doc, off = meta["doc"][pick][slot], meta["off"][pick][slot].astype(np.int64) + inside
        tied = equal | np.concatenate((equal[1:], [False]))
        family = np.cumsum(~equal)[tied]
        doc, off = doc[tied], off[tied]
        inner = np.lexsort((off, doc, family))
        family, doc, off = family[inner], doc[inner], off[inner]
        later = np.concatenate(([False], family[1:] == family[:-1])) if len(family) else np.zeros(0, bool)
        doc, off = doc[later], off[later]
        inner = np.lexsort((off, doc))
        doc, off = doc[inner], off[inner]
        if not len(doc):
            continue
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (off[1:] > off[:-1] + SPAN)))
        head = np.flatnonzero(new)
        span = np.stack([off[head], off[np.append(head[1:], len(off)) - 1] + SPAN], 1).astype("<u4")
        yield from _by_doc(doc[head], span, "spans")


def merge_spans(packed: list[bytes]) -> np.ndarray:
    """Disjoint, not touching, ascending spans that cover the same bytes."""
    spans = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2).astype(np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack([spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]], 1)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, bytes, removed, spans, digest of what is left) of (doc, text, packed spans)."""
    for batch in batches:
        rows = []
        for doc, text, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            raw, spans = text.encode(), merge_spans(packed)
            digest, at = hashlib.sha256(), 0
            for lo, hi in spans.tolist():
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            rows.append((doc, len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each document."""
    work = Workspace(documents.sparkSession, "suffix-dedup")
    return by_document(documents, id_col, text_col, work, lambda docs: _cut(docs, work)).withColumnRenamed("doc", id_col)


def _cut(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) of (doc, text)."""
    spark, width = work.spark, shuffle_width(work.spark)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    named = work.save(docs.filter(f"octet_length(text) >= {SPAN}").select("doc", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n")), "named")
    firsts = named.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = work.save(named.join(firsts, "digest").filter("doc <> first").select("doc", F.col("n").cast("long")), "copies")
    n_copies = copies.count()
    ids = copies.select("doc")
    base = docs.filter(f"octet_length(text) >= {SPAN}").join(F.broadcast(ids) if n_copies <= 500_000 else ids, "doc", "left_anti")

    keys = routes(spark, width)
    found = base.mapInArrow(anchors(keys), "bucket int, rows binary").repartition(width, "bucket").mapInArrow(recurring, "doc long, offs binary")
    live = work.save(found.groupBy("doc").agg(F.collect_list("offs").alias("offs")), "live")
    texts = semi_by_id(base, live.select("doc"), "doc", live.count()).join(live, "doc").select("doc", "text", "offs")
    dealt = texts.mapInArrow(slices(keys), "bucket int, doc long, meta binary, bytes binary").repartition(width, "bucket")
    spans = work.save(dealt.mapInArrow(repeats, "doc long, spans binary").groupBy("doc").agg(F.collect_list("spans").alias("spans")), "spans")

    n_cut = spans.count()
    cut = semi_by_id(docs, spans.select("doc"), "doc", n_cut).join(spans, "doc").select("doc", "text", "spans").mapInArrow(cut_out, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    gone = copies.select("doc", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA256).alias("kept_sha256"))
    touched = spans.select("doc").unionByName(ids)
    whole = docs.join(F.broadcast(touched) if n_cut + n_copies <= 500_000 else touched, "doc", "left_anti")
    whole = whole.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return cut.unionByName(gone).unionByName(whole)
