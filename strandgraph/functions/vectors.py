"""Vector distances as expressions over arrays, computed in DOUBLE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from strandgraph.errors import InvalidInput

METRICS = ("cosine", "euclidean", "dot", "manhattan")


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is nearer: (1 - cos) / 2, Euclidean, negated dot product, or Manhattan."""
    if metric == "cosine":
        return (1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))) / 2
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    if metric == "dot":
        return -dot(a, b)
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    raise InvalidInput(f"unknown metric {metric}")
