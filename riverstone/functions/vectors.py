"""Distances between arrays, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(features: Column | str) -> Column:
    """As an array of doubles, by a cast: it has generated code, a function of elements has not."""
    return (F.col(features) if isinstance(features, str) else features).cast("array<double>")


def array_of(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in double."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def scaled_sq_l2(a: Column, a_weight: Column, b: Column, b_weight: Column) -> Column:
    """Squared distance of the means of two cluster features: sums divided by their weights."""
    return _sum(F.zip_with(a, b, lambda x, y: (x / a_weight - y / b_weight) * (x / a_weight - y / b_weight)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector has no length."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def nearest(features: Column, centroids: Column) -> Column:
    """struct(distance, cluster) of the nearest of an array of arrays; the lowest index wins ties."""
    return F.array_min(F.transform(centroids, lambda c, i: F.struct(sq_l2(features, c).alias("distance"), i.alias("cluster"))))
