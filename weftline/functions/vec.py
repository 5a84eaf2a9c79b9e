"""Vectors as ``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product in double precision; null if the sizes differ or a side is null."""
    x, y = _col(a), _col(b)
    products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    return F.when(F.size(x) == F.size(y), F.aggregate(products, F.lit(0.0), lambda s, p: s + p))


def norm(a) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))


def cosine(a, b) -> Column:
    """Cosine (H18): 0 if a vector has length 0, null if the sizes differ."""
    d, n = dot(a, b), norm(a) * norm(b)
    return F.when(d.isNotNull(), F.when(n > 0, d / n).otherwise(F.lit(0.0)))


def normalize(a) -> Column:
    """The vector at length 1 (H17); null for a vector of length 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda p: (p.cast("double") / n).cast("float")))


def weight_of(dist, bits: int) -> Column:
    """Weight of a Hamming distance over ``bits`` bits."""
    return F.lit(1.0) - _col(dist) / F.lit(1.25 * bits)


def distance_of(weight: float, bits: int) -> int:
    """Largest distance of a weight (H19), limited to the number of bits."""
    return min(bits, max(0, int((1.0 - weight) * 1.25 * bits + 1e-9)))
