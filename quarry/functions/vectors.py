"""Vectors as arrays of floats, reckoned in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps the zero vector from a division by zero.
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector of length one; the zero vector stays zero."""
    n = norm(v) + F.lit(TINY)
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors."""
    return dot(a, b) / ((norm(a) + F.lit(TINY)) * (norm(b) + F.lit(TINY)))
