"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, least: float = 1e-12) -> Column:
    """a at length 1; lengths below least count as least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(least)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1; the zero vector if none is."""
    total = F.aggregate(
        F.zip_with(states, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m)),
        F.transform(F.element_at(states, 1), lambda x: F.lit(0.0)),
        lambda t, h: F.zip_with(t, h, lambda x, y: x + y),
    )
    count = F.aggregate(mask, F.lit(0.0), lambda t, m: t + m)
    return F.transform(total, lambda x: x / F.greatest(count, F.lit(1.0)))


def pair_features(left: Column, right: Column) -> Column:
    """left, right, their absolute differences and their products, one after the other."""
    return F.concat(left, right, F.zip_with(left, right, lambda x, y: F.abs(x - y)), F.zip_with(left, right, lambda x, y: x * y))
