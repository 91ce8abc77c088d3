"""Vectorised words and shingles over Arrow string columns (NumPy, no per-word Python).

A word is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D``; A-Z are lower-cased, all other
bytes stay. A word's hash is a polynomial over its bytes modulo 2**64, read off one prefix sum of the whole
chunk and passed through a mixing step; a shingle's hash folds the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_powers: list[np.ndarray] = [np.ones(0, np.uint64)] * 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 64)
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def text_chunks(ids: pa.Array, texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, bounds) of consecutive rows of at most ``limit`` bytes, or of one longer row. Null: empty."""
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    keys = ids.to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(keys):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield keys[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each row and the total) of the words of a chunk."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _FOLD)
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def fold(parts: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        total = total * _FOLD + part
    return mix(total)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """The hashes of each row's shingles in order; a row of fewer words has its whole sequence as one, none if empty."""
    whole = fold([words[k : len(words) - size + 1 + k] for k in range(size)]) if len(words) >= size else words[:0]
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield whole[lo : hi - size + 1]
        elif hi > lo:
            yield fold([words[k : k + 1] for k in range(lo, hi)])
        else:
            yield words[:0]


def shingle_sets(ids: pa.Array, texts: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(id, sorted distinct shingle hashes) of every row."""
    for keys, data, bounds in text_chunks(ids, texts):
        words, _, _, first = word_hashes(data, bounds)
        for key, own in zip(keys.tolist(), shingles(words, first, size), strict=True):
            own = np.sort(own)
            yield key, own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
