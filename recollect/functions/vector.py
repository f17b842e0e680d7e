"""Cosine similarity of arrays, as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine distance. Null for a zero vector, so that it never passes a threshold (and never divides by 0)."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def probe(seed: float, size: int) -> list[float]:
    """The deterministic test vector sin(seed + i) / 100."""
    import math

    return [math.sin(seed + i) / 100 for i in range(size)]


def present(similarity: Column, threshold: float) -> Column:
    """At or over a threshold; a missing or not-a-number similarity is out."""
    return (similarity >= F.lit(threshold)) & ~F.isnan(similarity)
