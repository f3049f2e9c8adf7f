"""How good a coreset or a clustering is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverstone.functions.vectors import doubles


def feature_moments(points: DataFrame, features: str = "features") -> DataFrame:
    """dim, mean, std, var: of the population, by dimension."""
    flat = points.select(F.posexplode(doubles(features)).alias("dim", "x"))
    return flat.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.var_pop("x").alias("var"))


def weighted_moments(points: DataFrame, weight: str = "weight", features: str = "features") -> DataFrame:
    """dim, mean, var with each point counted by its weight."""
    flat = points.select(F.col(weight).alias("w"), F.posexplode(doubles(features)).alias("dim", "x"))
    sums = flat.groupBy("dim").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return sums.select("dim", mean.alias("mean"), (F.col("wxx") / F.col("w") - mean * mean).alias("var"))


def total_variance(points: DataFrame, features: str = "features") -> DataFrame:
    return feature_moments(points, features).agg(F.sum("var").alias("total_variance"))


def cost(assigned: DataFrame, weight: Column | None = None) -> DataFrame:
    """The sum of (weighted) squared distances to the nearest centroid."""
    return assigned.agg(F.sum(F.col("distance") if weight is None else F.col("distance") * weight).alias("cost"))


def accuracy(labelled: DataFrame, cluster: str, label: str, order_by: str | None = None) -> DataFrame:
    """accuracy and n: each cluster stands for its most common label (the smallest of equals), or for that of its first row in an order."""
    if order_by is not None:
        named = labelled.groupBy(cluster).agg(F.min_by(label, order_by).alias("_name"))
    else:
        counts = labelled.groupBy(cluster, label).agg(F.count("*").alias("_n"))
        named = counts.groupBy(cluster).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("name"))).alias("b")).select(cluster, F.col("b.name").alias("_name"))
    return labelled.join(named, cluster).agg(F.avg((F.col(label) == F.col("_name")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def minmax(values: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0), constant: float = 50.0) -> Column:
    """Scaled into a range; a constant where all values are equal."""
    return F.when(high > low, (values - low) / (high - low) * (to[1] - to[0]) + to[0]).otherwise(F.lit(constant))


def standardised(points: DataFrame, *columns: str) -> DataFrame:
    """Adds features: z-scores of columns (0 for a constant one). The statistics are one row, broadcast."""
    stats = points.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    z = [F.coalesce((F.col(c) - F.col(f"_mean_{c}")) / F.nullif(F.col(f"_std_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns]
    return points.crossJoin(F.broadcast(stats)).withColumn("features", F.array(*z)).drop(*stats.columns)


def pca(points: DataFrame, k: int = 3, features: str = "features", fitted_on: DataFrame | None = None) -> DataFrame:
    """Adds pca: the first k principal components, fitted on the points or on others."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = lambda df: df.withColumn("_v", array_to_vector(doubles(features)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors(fitted_on if fitted_on is not None else points))
    return model.transform(vectors(points)).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")
