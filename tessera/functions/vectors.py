"""Arrays of doubles as vectors, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    return _c(x).cast("array<double>")


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def dot(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def scaled(x, by) -> Column:
    return F.transform(_c(x), lambda v: v * by)


def added(x, y) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a + b)


def cosine_distance(x, y) -> Column:
    """1 minus the cosine; norms are at least 1e-12, so that a zero vector is at distance 1 of all."""
    return 1.0 - dot(x, y) / (F.greatest(norm(x), F.lit(1e-12)) * F.greatest(norm(y), F.lit(1e-12)))


def euclidean(x, y) -> Column:
    return F.sqrt(total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b))))


def argmax(x) -> Column:
    """Place of the first greatest element, from 0."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def softmax(x) -> Column:
    top = F.array_max(_c(x))
    e = F.transform(_c(x), lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def normalised(x) -> Column:
    """Divided by the sum; zeros stay."""
    s = total(x)
    return F.transform(_c(x), lambda v: F.when(s > 0, v / s).otherwise(v))


def sharpened(x, temperature: float) -> Column:
    return normalised(F.transform(_c(x), lambda v: F.pow(v, 1.0 / temperature)))
