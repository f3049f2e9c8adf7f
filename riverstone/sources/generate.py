"""Generated points: made in parallel from row numbers and a seed, so that any size needs no memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.functions.rng import uniform


def centres(k: int, dims: int, separation: float, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).uniform(-separation, separation, (k, dims))


def _ids(spark: SparkSession, n: int | DataFrame, n_partitions: int | None = None) -> DataFrame:
    """id: of a table of them, or n numbers from 0."""
    return n.select("id") if isinstance(n, DataFrame) else spark.range(0, n, 1, n_partitions) if n_partitions else spark.range(n)


def _noise(seed: int, i: F.Column) -> F.Column:
    """A normal number for each row and dimension, made of uniform numbers by Box and Muller."""
    u, v = uniform(seed + 1, F.col("id"), i), uniform(seed + 2, F.col("id"), i)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(v * (2 * np.pi))


def blobs(spark: SparkSession, n: int | DataFrame, dims: int, k: int = 3, separation: float = 10.0, spread: float = 1.0, seed: int = 42, n_partitions: int | None = None) -> DataFrame:
    """id, features, label: each point is a cluster's centre and normal noise of one spread; n points, or one for each row of a table of ids."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres(k, dims, separation, seed)])
    rows = _ids(spark, n, n_partitions).withColumn("label", F.floor(uniform(seed, "id") * k).cast("long"))

    def value(i):  # noqa: ANN001, ANN202
        return (F.get(F.get(F.col("_centres"), F.col("label").cast("int")), i.cast("int")) + _noise(seed, i) * spread).cast("float")

    return rows.withColumn("_centres", table).withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value)).select("id", "features", "label")


def shapes(k: int, dims: int, stretch: float, seed: int) -> np.ndarray:
    """A lower triangular matrix for each cluster: its noise is the matrix times plain noise, so its covariance is the matrix times its transpose."""
    return np.tril(np.random.Generator(np.random.Philox(seed + 9)).uniform(-stretch, stretch, (k, dims, dims)))


def mixture(spark: SparkSession, n: int | DataFrame, dims: int, k: int = 3, separation: float = 10.0, stretch: float = 2.0, seed: int = 42) -> DataFrame:
    """id, features, label: as blobs(), but each cluster has a covariance of its own."""
    lit = lambda rows: F.array(*[lit(r) if np.ndim(r) else F.lit(float(r)) for r in rows])
    rows = _ids(spark, n).withColumn("label", F.floor(uniform(seed, "id") * k).cast("long"))
    plain = rows.withColumn("_z", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: _noise(seed, i)))
    own = lambda table: F.get(lit(table), F.col("label").cast("int"))
    turned = F.transform(own(shapes(k, dims, stretch, seed)), lambda row: F.aggregate(F.zip_with(row, F.col("_z"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x))
    return plain.select("id", F.zip_with(own(centres(k, dims, separation, seed)), turned, lambda c, x: (c + x).cast("float")).alias("features"), "label")


def classification(spark: SparkSession, n: int | DataFrame, dims: int, informative: int, redundant: int = 0, k: int = 2, separation: float = 1.0, flip: float = 0.01, seed: int = 42) -> DataFrame:
    """id, features, label: blobs in the informative dimensions, random mixtures of those in the redundant ones, noise in the rest; a share
    of labels is drawn anew."""
    base = blobs(spark, n, informative, k, separation, 1.0, seed)
    mixing = np.random.Generator(np.random.Philox(seed + 3)).uniform(-1, 1, (redundant, informative))
    made = [F.aggregate(F.zip_with("features", F.array(*[F.lit(float(v)) for v in row]), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x).cast("float") for row in mixing]
    noise = [(uniform(seed + 4, F.col("id"), F.lit(i)) * 2 - 1).cast("float") for i in range(dims - informative - redundant)]
    label = F.when(uniform(seed + 5, "id") < flip, F.floor(uniform(seed + 6, "id") * k).cast("long")).otherwise(F.col("label"))
    return base.select("id", F.concat("features", F.array(*made, *noise).cast("array<float>")).alias("features"), label.alias("label"))
