"""Expressions over array columns, without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda a: F.exp(a.cast("double") - top))
    return F.transform(e, lambda a: a / total(e))


def masked_softmax(x: Column, mask: Column) -> Column:
    """Softmax over the places where mask is true, 0 elsewhere; all 0 where none is."""
    kept = F.zip_with(x, mask, lambda a, m: F.when(m, a.cast("double")))
    top = F.array_max(kept)
    e = F.transform(kept, lambda a: F.coalesce(F.exp(a - top), F.lit(0.0)))
    s = total(e)
    return F.transform(e, lambda a: F.when(s > 0, a / s).otherwise(0.0))


def entropy(p: Column, floor: float = 1e-12) -> Column:
    """In nats, with probabilities clipped below."""
    return -total(F.transform(p, lambda a: F.greatest(a.cast("double"), F.lit(floor)) * F.log(F.greatest(a.cast("double"), F.lit(floor)))))


def binary_entropy(p: Column, floor: float = 1e-12) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p.cast("double")))
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def linspace(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced doubles as low + k * step, the last exactly high."""
    step = (high - low) / (n - 1)
    return [low + k * step for k in range(n - 1)] + [high]
