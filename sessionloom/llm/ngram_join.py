"""Operator 1: near-duplicate classes of documents by a prefix-tree join of word n-gram sets.

Two documents link when ``100 * |A & B| >= 80 * |A | B|`` for their sets of distinct five-word shingles, and the
result is the connected components of all links. Documents with equal sets form one class from the start.

1. Every shingle gets a place in one global order, rare before frequent: all shingles are counted, and a table of fixed
   size has the level (half the bits of the count) of each slot of hashes; the hash decides between equal levels.
2. Linked sets share a shingle among their first ``|A| - ceil(0.8 |A|) + 1``; those prefixes are dealt out by
   shingle and only shingles that two classes share are kept.
3. Each class joins the leader (least class) of the shingles it shares most; a leader's followers are compared, in
   tries of bounded size, with it and with one another. This joins up a family of copies with work linear in its size.
4. Pairs that share a prefix shingle and still lie in different components are compared as well, unless the shared
   prefix bounds their overlap below the threshold. Where many classes share a shingle, those outside its largest
   component visit the tries of all its classes instead of pairing up. No link between components is lost.

A comparison puts sets in global order into a path-compressed trie and walks it with a probing set: partial overlaps
are shared along common paths; a subtree goes when the overlap so far plus what can remain is too small, or when all
of it is in the probe's component already.

Cases: null, empty or blank text has an empty set, ``n_shingles`` 0 and links with nothing; fewer words than five
make one shingle; equal texts are one class; ``component_id`` is the smallest ``doc_id``; repeated rows of one id and
text are one document, reported for each; of an id with several texts each text is a document (a null id comes before
all others); columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Workspace, by_document, routes, semi_by_id, shuffle_width
from ._words import mix, shingle_sets
from .components import connected_components

#: log2 of the level table's slots (a byte each), the rows it travels in, the sets of one trie, and the most classes of a
#: shingle paired directly. A larger table tells rare shingles apart better; results do not depend on it.
LEVEL_BITS, LEVEL_ROWS, TRIE_SETS, CROWD = 22, 16, 512, 64
#: Most members of groups that are broadcast to the texts, which then travel once; beyond that they travel twice.
BROADCAST_MEMBERS = 500_000
_PLACE = np.uint64(6)


def set_class(tokens: np.ndarray) -> int:
    """A 64-bit name of a set of shingle hashes."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, cls, n) of each document."""
    for batch in batches:
        rows = [(key, set_class(tokens), len(tokens)) for key, tokens in shingle_sets(batch.column(0), batch.column(1))]
        columns = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "cls", "n"])


def distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(class, shingles) of a task's documents, most repeats of a class left out."""
    seen: set[int] = set()
    for batch in batches:
        for _, tokens in shingle_sets(batch.column(0), batch.column(1)):
            if len(tokens) and (cls := set_class(tokens)) not in seen:
                if len(seen) >= 50_000:  # only saves repeats: a forgotten class is passed on again
                    seen.clear()
                seen.add(cls)
                yield cls, tokens


def dealt_shingles(keys: list[int]):
    """Task function: the lower halves of all shingles, dealt out by their upper halves."""

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        to = ((tokens >> np.uint64(32)) * np.uint64(len(keys)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        low, to = tokens[order].astype(np.uint32), to[order]
        found, first = np.unique(to, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found], pa.int32()), pa.array([x.tobytes() for x in np.split(low, first[1:])] if len(found) else [], pa.binary())], ["bucket", "rows"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, tokens in distinct_sets(batches):
            parts.append(tokens)
            size += len(tokens)
            if size >= 1 << 18:
                yield pack(parts)
                parts, size = [], 0
        yield pack(parts)

    return task


def _packed_levels(table: np.ndarray) -> pa.RecordBatch:
    rows = [zlib.compress(x.tobytes(), 1) for x in np.split(table, LEVEL_ROWS)]
    return pa.RecordBatch.from_arrays([pa.array(range(LEVEL_ROWS), pa.int64()), pa.array(rows, pa.binary())], ["part", "levels"])


def counted_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The level table of this task's buckets: half the bits of a shingle's count, the greatest of each slot."""
    by_bucket: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for bucket, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by_bucket.setdefault(bucket, []).append(np.frombuffer(row.as_buffer(), np.uint32))
    table = np.zeros(1 << LEVEL_BITS, np.uint8)
    for bucket in list(by_bucket):
        low = np.sort(np.concatenate(by_bucket.pop(bucket)))
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        count = np.diff(np.append(first, len(low)))
        often = count >= 4
        level = (np.floor(np.log2(count[often])) / 2).astype(np.uint8)
        np.maximum.at(table, (low[first][often] & np.uint32(len(table) - 1)).astype(np.int64), level)
    yield _packed_levels(table)


def merged_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greatest level of each slot over a task's tables, part by part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(row.as_py()), np.uint8)
            total[part] = np.maximum(total[part], own) if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["part", "levels"])


def ordered(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Tokens that sort in the global order: the level in the upper six bits, the hash below."""
    return np.sort((tokens >> _PLACE) | (level[(tokens & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)))


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


_POSTING = np.dtype([("tok", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def postings(level: Broadcast, keys: list[int]):
    """Task function: prefix postings of each class once a task, packed by bucket of the shingle."""

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts) if parts else np.zeros(0, _POSTING)
        to = (mix(rows["tok"]) % np.uint64(len(keys))).astype(np.int64)
        order = np.argsort(to, kind="stable")
        rows, to = rows[order], to[order]
        found, first = np.unique(to, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found], pa.int32()), pa.array([x.tobytes() for x in np.split(rows, first[1:])] if len(found) else [], pa.binary())], ["bucket", "rows"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for cls, tokens in distinct_sets(batches):
            p = prefix_size(len(tokens))
            part = np.empty(p, _POSTING)
            part["tok"], part["cls"], part["n"], part["pos"] = ordered(tokens, level.value)[:p], cls, len(tokens), np.arange(p)
            parts.append(part)
            size += p
            if size >= 1 << 17:
                yield pack(parts)
                parts, size = [], 0
        yield pack(parts)

    return task


def shared_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the postings of this task's buckets, those whose shingle two classes have, with the least class of each."""
    parts = [np.frombuffer(row.as_buffer(), _POSTING) for batch in batches for row in batch.column(1)]
    rows = np.concatenate(parts) if parts else np.zeros(0, _POSTING)
    del parts
    rows = rows[np.lexsort((rows["cls"], rows["tok"]))]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows["tok"][1:] != rows["tok"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1])
        rows = rows[new]
        first = np.flatnonzero(np.concatenate(([True], rows["tok"][1:] != rows["tok"][:-1])))
        count = np.diff(np.append(first, len(rows)))
        leader = np.repeat(rows["cls"][first], count)
        keep = np.repeat(count, count) > 1
        rows, leader = rows[keep], leader[keep]
        for lo in range(0, len(rows), 100_000):
            own = rows[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own["tok"].view(np.int64) if own["tok"].flags.c_contiguous else own["tok"].astype(np.uint64).view(np.int64)), pa.array(own["cls"].copy()), pa.array(own["n"].astype(np.int64)), pa.array(own["pos"].astype(np.int64)), pa.array(leader[lo : lo + 100_000])], ["tok", "cls", "n", "pos", "leader"])


def needed(a: int, b: int) -> int:
    """The least overlap at which sets of these sizes link."""
    return (4 * (a + b) + 8) // 9


class Trie:
    """A path-compressed prefix tree of ordered sets: (segment, end depth, least and greatest size, ends here, all keys, children)."""

    def __init__(self, sets: dict[int, np.ndarray]):
        items = sorted((x.astype(">u8").tobytes(), key) for key, x in sets.items() if len(x))
        self.sets = sets
        self.root = self._node([key for _, key in items], 0) if items else None

    def _node(self, keys: list[int], depth: int) -> tuple:
        low, high = self.sets[keys[0]][depth:], self.sets[keys[-1]][depth:]
        n = min(len(low), len(high))
        unlike = np.flatnonzero(low[:n] != high[:n])
        end = depth + (int(unlike[0]) if len(unlike) else n)
        sizes = [len(self.sets[k]) for k in keys]
        here, deeper = [], {}
        for k in keys:
            if len(self.sets[k]) == end:
                here.append(k)
            else:
                deeper.setdefault(int(self.sets[k][end]), []).append(k)
        return low[: end - depth], end, min(sizes), max(sizes), here, keys, [self._node(group, end) for group in deeper.values()]

    def links(self, probe: np.ndarray, done=lambda key: False) -> list[int]:
        """Keys of the sets that link with the probe; subtrees of keys that are all ``done`` are passed over."""
        found, stack = [], [(self.root, 0)] if self.root is not None else []
        while stack:
            (segment, end, least, most, here, keys, children), overlap = stack.pop()
            if all(map(done, keys)):
                continue
            left = len(probe)
            if len(segment):
                at = np.searchsorted(probe, segment)
                overlap += int((probe[np.minimum(at, len(probe) - 1)] == segment).sum())
                left = len(probe) - int(np.searchsorted(probe, segment[-1], "right"))
            if overlap + min(left, most - end) < needed(len(probe), least):
                continue
            found += [k for k in here if 9 * overlap >= 4 * (len(probe) + end)]
            stack += [(child, overlap) for child in children]
        return found


def spanning_links(sets: dict[int, np.ndarray], parts: dict[int, int], probes: list[int]) -> list[tuple[int, int]]:
    """Edges (set, smallest of its new component) that say what links with the probes make of the sets; ``parts``: components known before."""
    head: dict[int, int] = {}
    parent = {k: head.setdefault(parts[k], k) for k, x in sets.items() if len(x)}
    left = len(head) - 1

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    trie = Trie(sets)
    for probe in probes:
        if not left:
            break
        if probe not in parent:
            continue
        root = find(probe)
        for k in trie.links(sets[probe], lambda key, root=root: find(key) == root):
            if (other := find(k)) != root:
                parent[other] = root
                left -= 1
    joined: dict[int, list[int]] = {}
    for k in head.values():
        joined.setdefault(find(k), []).append(k)
    return [(k, min(group)) for group in joined.values() for k in group if k != min(group)]


def compare(level: Broadcast):
    """Task function over sorted (leader, salt, doc, part, probe, text): the links that each group adds."""

    def group_links(leader: int, rows: list[tuple]) -> list[tuple[int, int]]:
        sets = {k: ordered(t, level.value) for k, t in shingle_sets(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()))}
        probes = sorted((r[0] for r in rows if r[2]), key=lambda k: k != leader)
        return spanning_links(sets, {r[0]: r[1] for r in rows}, probes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for leader, salt, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (leader, salt) != key:
                    if rows:
                        out += group_links(key[0], rows)
                    key, rows = (leader, salt), []
                rows.append(row)
        if rows:
            out += group_links(key[0], rows)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return task


def compared(docs: DataFrame, members: DataFrame, level: Broadcast, work: Workspace, name: str) -> DataFrame:
    """The links (a, b) found in the groups (a, salt) of ``members(a, salt, doc, part, probe)``."""
    members = work.save(members, f"{name}-members")
    n = members.count()
    if not n:
        return work.spark.createDataFrame([], "a long, b long")
    if n <= BROADCAST_MEMBERS:
        rows = docs.join(F.broadcast(members), "doc")
    else:
        ids = work.save(members.select("doc").distinct(), f"{name}-ids")
        rows = members.join(semi_by_id(docs, ids, "doc", ids.count()), "doc")
    rows = rows.select("a", "salt", "doc", "part", "probe", "text").repartition(shuffle_width(work.spark), "a", "salt").sortWithinPartitions("a", "salt")
    links = work.save(rows.mapInArrow(compare(level), "a long, b long"), f"{name}-links")
    work.tidy()  # the shuffled texts are of no more use
    return links


def _salted(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """Adds ``salt``: groups of ``key`` split by ``by`` into parts of about TRIE_SETS rows."""
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TRIE_SETS).alias("parts"))
    return rows.join(parts, key).withColumn("salt", F.expr(f"pmod(xxhash64({by}), parts)")).drop("parts")


def reachable() -> str:
    """SQL condition over (n, shared, least, most): a set of n shingles can be linked to one of a cell's sizes.

    At most ``shared`` prefix shingles are common. For the prefix of n the bound is loosest at the least size m. For the
    prefix of m, 9 * ceil(0.8 m) - 4 m grows by 5 from one m to the next and falls by 4 only from 5 k + 4 to 5 k + 5: it is
    loosest at the greatest size or the one below.
    """
    rest = "9 * (shared + greatest(n - (n - ceil(n * 4 / 5) + 1), {m} - ({m} - ceil({m} * 4 / 5) + 1))) >= 4 * (n + {m})"
    low, high = "greatest(least, ceil(n * 4 / 5))", "least(most, floor(n * 5 / 4))"
    return " or ".join(f"({rest.format(m=m)})" for m in (low, high, f"greatest({low}, {high} - 1)"))


def near_duplicate_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each document."""
    work = Workspace(documents.sparkSession, "ngram-join")
    out = by_document(documents, id_col, text_col, work, lambda docs: _classes(docs, work), refer=("component_id",))
    return out.withColumnRenamed("doc", id_col)


def _classes(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc, n_shingles, component_id) of (doc, text)."""
    spark, width = work.spark, 2 * shuffle_width(work.spark)
    signs = work.save(docs.mapInArrow(describe, "doc long, cls long, n long"), "signed")
    keys = routes(spark, width)
    tables = docs.mapInArrow(dealt_shingles(keys), "bucket int, rows binary").repartition(width, "bucket").mapInArrow(counted_levels, "part long, levels binary")
    counted = work.save(tables, "levels")
    work.tidy()  # the shuffled shingles are of no more use
    tables = counted.repartition(LEVEL_ROWS, "part").mapInArrow(merged_levels, "part long, levels binary")
    level = np.zeros((LEVEL_ROWS, (1 << LEVEL_BITS) // LEVEL_ROWS), np.uint8)
    for row in tables.collect():
        level[row.part] = np.frombuffer(zlib.decompress(bytes(row.levels)), np.uint8)
    level = spark.sparkContext.broadcast(level.reshape(-1))
    classes = work.save(signs.filter("n > 0").groupBy("cls").agg(F.min("doc").alias("rep"), F.min("n").alias("n")), "classes")

    dealt = docs.mapInArrow(postings(level, keys), "bucket int, rows binary").repartition(width, "bucket")
    posts = work.save(dealt.mapInArrow(shared_postings, "tok long, cls long, n long, pos long, leader long"), "posts")
    work.tidy()  # nor are the shuffled postings

    led = posts.filter("cls <> leader").groupBy("cls", "leader").agg(F.count(F.lit(1)).alias("shared"))
    led = work.save(led, "led")  # of the leaders with half of the most shared shingles, the one with most followers
    popular, best = led.groupBy("leader").agg(F.count(F.lit(1)).alias("followers")), led.groupBy("cls").agg(F.max("shared").alias("most"))
    led = led.join(popular, "leader").join(best, "cls").filter("2 * shared >= most").groupBy("cls").agg(F.max(F.struct("followers", "shared", "leader")).alias("best")).select("cls", "best.leader")
    named = led.join(classes.select("cls", F.col("rep").alias("doc")), "cls").join(classes.select(F.col("cls").alias("leader"), F.col("rep").alias("a")), "leader")
    cells = work.save(_salted(named.select("a", "doc"), ["a"], "doc"), "cells")
    heads = cells.select("a", "salt", F.col("a").alias("doc")).distinct()
    members = cells.select("a", "salt", "doc").unionByName(heads).select("*", F.col("doc").alias("part"), F.lit(True).alias("probe"))
    links = compared(docs, members, level, work, "led")

    found = connected_components(links, work, "first").withColumnRenamed("node", "rep")
    own = cells.select(F.col("doc").alias("rep"), F.col("a").alias("cell"), F.col("salt").alias("cell_salt"))
    placed = classes.join(found, "rep", "left").join(own, "rep", "left")
    placed = work.save(placed.select("cls", "rep", F.coalesce("component", "rep").alias("comp"), F.coalesce("cell", "rep").alias("cell"), F.coalesce("cell_salt", F.lit(0)).cast("long").alias("cell_salt")), "placed")
    known = posts.join(placed, "cls").select("tok", "rep", "comp", "n", "pos", "cell", "cell_salt")
    mixed = known.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi").select("tok", (F.col("size") > CROWD).alias("crowded"))
    open_ = work.save(known.join(mixed, "tok"), "open")
    work.drop("posts")

    crowds = open_.filter("crowded")
    in_crowds = crowds.groupBy("rep").agg(F.count(F.lit(1)).alias("crowds"))
    few = work.save(open_.filter("not crowded").join(in_crowds, "rep", "left").fillna(0, ["crowds"]), "few")
    left, right = (few.select("tok", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp", "n", "crowds"))) for s in "ab")
    met = left.join(right, "tok").filter("rep_a < rep_b and comp_a <> comp_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    met = met.groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("doc")).agg(F.count(F.lit(1)).alias("shared"), *(F.min(c).alias(c) for c in ("n_a", "n_b", "comp_a", "comp_b", "crowds_a", "crowds_b")))
    rest = "greatest(n_a - (n_a - ceil(n_a * 4 / 5) + 1), n_b - (n_b - ceil(n_b * 4 / 5) + 1))"
    met = _salted(work.save(met.filter(f"9 * (shared + least(crowds_a, crowds_b) + {rest}) >= 4 * (n_a + n_b)"), "met"), ["a"], "doc")
    members = met.select("a", "salt", "doc", F.col("comp_b").alias("part"), F.lit(False).alias("probe"))
    members = members.unionByName(met.select("a", "salt", F.col("a").alias("doc"), F.col("comp_a").alias("part"), F.lit(True).alias("probe")).distinct())
    late = compared(docs, members, level, work, "met")

    main = crowds.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("tok").agg(F.max(F.struct("size", "comp")).alias("top")).select("tok", F.col("top.comp").alias("main"))
    fews = few.groupBy("rep").agg(F.count(F.lit(1)).alias("fews"))
    strays = crowds.join(main, "tok").filter("comp <> main").join(in_crowds, "rep").join(fews, "rep", "left").fillna(0, ["fews"]).select("tok", "rep", "comp", "n", "pos", (F.col("crowds") + F.col("fews")).alias("shared"))
    targets = crowds.groupBy("tok", "cell", "cell_salt").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.expr("CASE WHEN 9 * pos <= n THEN n END")).alias("early"))
    # the first shingle that linked sets share is within the first ninth of the smaller one
    visits = strays.join(targets, "tok").filter("(9 * pos <= n and most >= n or early <= n) and 5 * n >= 4 * least and 4 * n <= 5 * most and not (lo = comp and hi = comp)")
    visits = visits.groupBy("cell", "cell_salt", "rep", "comp").agg(F.min("shared").alias("shared"), F.min("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    visits = visits.filter(reachable()).select("cell", "cell_salt", "rep", "comp")
    visits = work.save(_salted(visits, ["cell", "cell_salt"], "rep").withColumn("salt", F.expr("shiftleft(cell_salt, 20) + salt")), "visits")
    hosts = visits.select("cell", "cell_salt", "salt").distinct().join(placed.select("cell", "cell_salt", F.col("rep").alias("doc"), F.col("comp").alias("part")), ["cell", "cell_salt"])
    members = hosts.select(F.col("cell").alias("a"), "salt", "doc", "part", F.lit(False).alias("probe"))
    members = members.unionByName(visits.select(F.col("cell").alias("a"), "salt", F.col("rep").alias("doc"), F.col("comp").alias("part"), F.lit(True).alias("probe")))
    last = compared(docs, members.groupBy("a", "salt", "doc", "part").agg(F.max("probe").alias("probe")), level, work, "strays")

    level.destroy()  # every comparison is written
    final = connected_components(links.unionByName(late).unionByName(last), work, "last")
    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    return signs.join(named, "cls", "left").select("doc", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
