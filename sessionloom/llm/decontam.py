"""Operator 10: documents that contain benchmark items, by SimHash of item-sized windows and multi-index Hamming blocks.

Items and windows are multisets of five-word shingles (A-Z lower-cased; an item of fewer words is one shingle), and a
window matches when ``10 * sum(min) >= 8 * sum(max)`` over the shingles' counts. For an item of m words the windows
are all runs of m words of a document, or the whole document if it is shorter.

1. At similarity 0.8 at least 8/9 of a window's shingles are the item's; windows with fewer shingles of any items get no
   fingerprint (no match is lost).
2. Every other window gets a 64-bit SimHash from running sums of its shingles' bits.
3. Fingerprints are looked up in a multi-index: four blocks of 16 bits, each a table of sorted block values. Two
   fingerprints within ``RADIUS`` = 15 bits agree in some block up to 3 bits; the tables hold every item under its block's
   values within 1 bit and a window asks for its values within 2, so every pair within the radius is found, and of
   unrelated items one in 24 (2788 of 65536) becomes a candidate. Candidates outside the radius go by a popcount.
4. Exact weighted similarity decides.

At similarity 0.8 the distance has mean 9.7 and deviation 2.9 bits, so a window right at the threshold is within the
radius with 0.98 and one at 0.85 with more than 0.99 (the README has the measured recall). ``exact=True`` is the exact
way: instead of fingerprints, items with shingles at enough places of a window go to step 4. It is always taken for
windows and items with a shingle ``REPEATS`` times, whose weight counts more in a fingerprint than in the similarity.

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text, each held against all documents in one scan without
a shuffle: a passage in a third of all documents burdens no single task. Workers build a block's tables once.

Cases: null, empty or blank texts match nothing; equal items are reported each; null ids stay null; repeated rows give
repeated results; an empty benchmark or table gives none; long texts are treated whole, ``SPREAD`` places at a time.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import fold, text_chunks, word_hashes
from ._work import NO_ID

SIZE, RADIUS, REPEATS = 5, 15, 2
#: Bytes of item texts in a block, and places of a document whose windows are in hand at once.
BLOCK_BYTES, SPREAD = 8 << 20, 1 << 13
#: Candidate pairs in hand at once, about.
CANDIDATES = 1 << 20


def _masks(bits: int) -> np.ndarray:
    """The 16-bit values with at most so many bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


NEAR_ITEM, NEAR_WINDOW = _masks(1), _masks(2)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each window of shingles from start to end."""
    low, high = int(starts.min()), int(ends.max())
    bits = np.unpackbits(hashes[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)))
    return np.packbits(sums[ends - low] > sums[starts - low], axis=1).view("<u8")[:, 0]


def repetitive(shingles: np.ndarray, span: int) -> np.ndarray:
    """Whether the window of ``span`` shingles from each place has one of them ``REPEATS`` times."""
    order = np.argsort(shingles, kind="stable")
    low, high = order[: max(0, len(order) - REPEATS + 1)], order[REPEATS - 1 :]
    same = (shingles[low] == shingles[high]) & (high - low < span)
    marks = np.zeros(len(shingles) + 1, np.int64)
    np.add.at(marks, np.maximum(high[same] - span + 1, 0), 1)
    np.add.at(marks, low[same] + 1, -1)
    return np.cumsum(marks[:-1]) > 0


def _ranges(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of the ranges from each lo, one range after the other."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


class MultiIndex:
    """Fingerprints under the values of their four blocks, and those within one bit of them."""

    def __init__(self, marks: np.ndarray):
        self.marks, self.tables = marks, []
        for block in range(4):
            values = ((marks >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint16)
            keys = (values[:, None] ^ NEAR_ITEM[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], (order // len(NEAR_ITEM)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print, mark) pairs within the radius, each once; candidates agree in some block up to 3 bits."""
        step, pairs = max(1, CANDIDATES // (1 + len(self.marks) // 8)), []
        for first in range(0, len(prints), step):
            own = prints[first : first + step]
            for block, (keys, owners) in enumerate(self.tables):
                values = ((own >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint16)
                asked = (values[:, None] ^ NEAR_WINDOW[None, :]).ravel()
                lo = np.searchsorted(keys, asked)
                count = np.searchsorted(keys, asked, "right") - lo
                hit = np.flatnonzero(count)
                a, b = np.repeat(hit // len(NEAR_WINDOW), count[hit]), owners[_ranges(lo[hit], count[hit])]
                close = np.bitwise_count(own[a] ^ self.marks[b]) <= RADIUS
                pairs.append((first + a[close]) * len(self.marks) + b[close])
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return found // len(self.marks), found % len(self.marks)


class Benchmark:
    """Items with their shingles; for each size the fingerprints' multi-index and the places of each shingle."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.counts, prints = [], [], [], []
        for keys, data, bounds in text_chunks(pa.array([k for k, _ in items], pa.int64()), pa.array([t for _, t in items], pa.string())):
            hashes, _, _, first = word_hashes(data, bounds)
            for key, lo, hi in zip(keys.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if hi == lo:
                    continue
                n = min(SIZE, hi - lo)
                own = fold([hashes[lo + k : hi - n + 1 + k] for k in range(n)])
                self.ids.append(key)
                self.words.append(hi - lo)
                self.counts.append(Counter(own.tolist()))
                prints.append(fingerprints(own, np.array([0]), np.array([len(own)]))[0])
        pairs = sorted((h, i) for i, c in enumerate(self.counts) for h in c)
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.owners = np.array([i for _, i in pairs], np.int64)
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.length = np.array(self.words, np.int64)
        self.repeated = np.array([max(c.values()) >= REPEATS for c in self.counts], bool)
        prints = np.array(prints, np.uint64)
        self.sizes = {}
        for m in set(self.words):
            own = np.flatnonzero(self.length == m)
            self.sizes[m] = own, MultiIndex(prints[own])

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.screen[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at
        slot = np.minimum(np.searchsorted(self.hashes, shingles[at]), len(self.hashes) - 1)
        return at[self.hashes[slot] == shingles[at]]

    def _sharing(self, shingles: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of every item at every hit."""
        lo = np.searchsorted(self.hashes, shingles[hits])
        count = np.searchsorted(self.hashes, shingles[hits], "right") - lo
        return np.repeat(hits, count), self.owners[_ranges(lo, count)]

    def _counted(self, places: np.ndarray, items: np.ndarray, span: int, starts: np.ndarray, every: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, item) of windows with shingles of an item at enough places: repetitive windows, all of ``every`` item."""
        order = np.lexsort((places, items))
        places, items = places[order], items[order]
        for lo, hi in zip(*_groups(items), strict=True):
            chosen = starts[1] if every[items[lo]] else starts[0]
            count = np.searchsorted(places[lo:hi], chosen + span) - np.searchsorted(places[lo:hi], chosen)
            for s in chosen[9 * count >= 8 * span].tolist():  # sum(min) >= 8/9 of the window at similarity 0.8
                yield s, int(items[lo])

    def matches(self, shingles: np.ndarray, n_words: int, hits: np.ndarray, exact: bool = False) -> Iterator[tuple[int, int, int, int]]:
        """(item, first word, sum of least, sum of greatest counts) of the best window of each matching item."""
        best: dict[int, tuple[int, int, int]] = {}
        for m in np.unique(self.length[self.owners[np.isin(self.hashes, shingles[hits])]]).tolist():
            if m < SIZE <= n_words:
                continue  # their shingles are shorter: see short_matches
            own, index = self.sizes[m]
            span = max(1, min(m, n_words) - SIZE + 1)
            loops = repetitive(shingles, span)
            for base in range(0, len(shingles) - span + 1, SPREAD):  # windows that start in [base, base + SPREAD)
                top = min(base + SPREAD, len(shingles) - span + 1)
                near = hits[np.searchsorted(hits, base) : np.searchsorted(hits, top + span - 1)]
                if not len(near):
                    continue
                starts = np.arange(base, top)
                starts = starts[9 * (np.searchsorted(near, starts + span) - np.searchsorted(near, starts)) >= 8 * span]
                pairs = []
                forced = starts if exact else starts[loops[starts]]
                if len(forced) or self.repeated[own].any():
                    place, item = self._sharing(shingles, near)
                    wanted = (self.length[item] == m) & (self.repeated[item] if not len(forced) else True)
                    pairs += self._counted(place[wanted], item[wanted], span, (forced, starts), self.repeated)
                plain = starts[~loops[starts]]
                if len(plain) and not exact:
                    window, item = index.near(fingerprints(shingles, plain, plain + span))
                    fresh = ~self.repeated[own[item]]
                    pairs += zip(plain[window[fresh]].tolist(), own[item[fresh]].tolist(), strict=True)
                for s, i in pairs:
                    counts, here = self.counts[i], Counter(shingles[s : s + span].tolist())
                    least = sum(min(c, counts[h]) for h, c in here.items() if h in counts)
                    most = span + counts.total() - least
                    if 10 * least >= 8 * most and (i not in best or (least * best[i][2], -s) > (best[i][1] * most, -best[i][0])):
                        best[i] = s, least, most
        for i, (s, least, most) in best.items():
            yield self.ids[i], s, least, most

    def short_matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The same for items of fewer than five words in a document of five or more: equal fingerprints of one shingle."""
        for m in (m for m in self.sizes if m < SIZE):
            runs = fold([words[k : len(words) - m + 1 + k] for k in range(m)])
            brief = self.length == m
            at = runs[np.isin(runs, self.hashes)]
            for i in np.unique(self.owners[np.isin(self.hashes, at)]).tolist() if len(at) else []:
                if brief[i]:
                    place = np.flatnonzero(runs == np.uint64(next(iter(self.counts[i]))))
                    if len(place):
                        yield self.ids[i], int(place[0]), 1, 1


def _groups(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal keys begin and end."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return first.tolist(), [*first[1:].tolist(), len(keys)] if len(first) else []


_built: dict[str, Benchmark] = {}


def scan(items: Broadcast, name: str, exact: bool):
    """Task function over (doc, text): (doc, item, first word, sum of least, sum of greatest)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:  # a worker keeps the tables of one block
            _built.clear()
            _built[name] = Benchmark(items.value)
        bench = _built[name]
        brief = any(m < SIZE for m in bench.sizes)
        for batch in batches:
            rows = []
            for ids, data, bounds in text_chunks(batch.column(0), batch.column(1)):
                words, _, _, first = word_hashes(data, bounds)
                whole = fold([words[k : len(words) - SIZE + 1 + k] for k in range(SIZE)]) if len(words) >= SIZE else words[:0]
                at = bench.hits(whole)
                for k in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                    lo, hi = first[k], first[k + 1]
                    own = at[(at >= lo) & (at + SIZE <= hi)] - lo
                    if len(own):
                        rows += [(int(ids[k]), *found) for found in bench.matches(whole[lo : hi - SIZE + 1], int(hi - lo), own, exact)]
                for k in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SIZE)).tolist():
                    one = fold([words[j : j + 1] for j in range(first[k], first[k + 1])])
                    if len(bench.hits(one)):
                        rows += [(int(ids[k]), *found) for found in bench.matches(one, int(first[k + 1] - first[k]), np.array([0]), exact)]
                if brief:
                    for k in np.flatnonzero(np.diff(first) >= SIZE).tolist():
                        rows += [(int(ids[k]), *found) for found in bench.short_matches(words[first[k] : first[k + 1]])]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc", "item", "start", "least", "most"])

    return task


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): one row for each document and item found in it, at its first best window."""
    spark, known = documents.sparkSession, lambda column: F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(NO_ID))
    items = benchmark.select(known(item_col).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).filter("text is not null")
    docs = documents.select(known(id_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        own = [(r.item, r.text) for r in items.filter(F.expr(f"pmod(xxhash64(item, text), {blocks}) = {k}")).collect()]
        if not own and k < blocks - 1:
            continue
        found = docs.mapInArrow(scan(spark.sparkContext.broadcast(own), uuid.uuid4().hex, exact), "doc long, item long, start long, least long, most long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias(id_col), F.nullif("item", F.lit(NO_ID)).alias(item_col), F.col("start").alias("start_word"), F.round(F.col("least") / F.col("most"), 6).alias("similarity"))
