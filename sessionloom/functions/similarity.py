"""Vectors, names and score transforms as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .text import col


def dot(a, b, dim: int | None = None) -> Column:
    """Inner product; with a known dimension it is unrolled, so that it compiles into the stage."""
    if dim:
        return reduce(lambda x, y: x + y, (F.get(col(a), F.lit(k)).cast("double") * F.get(col(b), F.lit(k)).cast("double") for k in range(dim)))
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b, dim: int | None = None, floor: float | None = None) -> Column:
    """Cosine similarity: null for a null or, without a floor of the norms, a zero vector."""
    x, y = norm(a), norm(b)
    if floor:
        return dot(a, b, dim) / (F.greatest(x, F.lit(floor)) * F.greatest(y, F.lit(floor)))
    return F.try_divide(dot(a, b, dim), x * y)


def words(c) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: w != ""))


def jaccard(a, b) -> Column:
    """Of the words of two names; 0 if one has none."""
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def name_similarity(a, b) -> Column:
    """1 if equal, 0.8 if one is in the other, else a raised Jaccard similarity."""
    x, y, j = F.lower(F.trim(col(a))), F.lower(F.trim(col(b))), jaccard(a, b)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).when(j > 0, F.least(F.lit(1.0), j + 0.2)).otherwise(0.0)


def harmonic(a, b) -> Column:
    return F.when(col(a) + col(b) > 0, 2 * col(a) * col(b) / (col(a) + col(b))).otherwise(0.0)


def decay(gap, median, exponent: float) -> Column:
    """Stretched-exponential decay of a gap relative to a median."""
    return F.exp(-F.pow(col(gap) / col(median), F.lit(exponent)))


def minmax(x, window: WindowSpec, epsilon: float = 1e-9) -> Column:
    """Scaled to 0 to 1 over the window; 1 where all are equal."""
    lo, hi = F.min(col(x)).over(window), F.max(col(x)).over(window)
    return F.when(hi - lo < epsilon, 1.0).otherwise((col(x) - lo) / (hi - lo))


def share(x, window: WindowSpec) -> Column:
    """Of the window's sum; an even share where the sum is 0."""
    total = F.sum(col(x)).over(window)
    return F.when(total > 0, col(x) / total).otherwise(1.0 / F.count(F.lit(1)).over(window))
