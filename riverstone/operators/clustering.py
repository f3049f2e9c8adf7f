"""Clusters of points or coresets: Lloyd's iterations, weighted mini-batch k-means, and labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverstone.functions.rng import uniform
from riverstone.functions.vectors import doubles
from riverstone.operators import kernel
from riverstone.operators.coreset import matrix_of


def centroid_matrix(centroids: DataFrame | np.ndarray) -> np.ndarray:
    """k x d centroids: an array, or the k rows of a DataFrame of cluster (0 to k - 1) and features, which come to the driver."""
    if isinstance(centroids, DataFrame):
        rows = centroids.select("cluster", doubles("features").alias("c")).orderBy("cluster").collect()
        return np.array([r.c for r in rows], float)
    return np.asarray(centroids, float)


def nearest_of(centroids: np.ndarray):  # noqa: ANN201
    """A function of a column of points: struct(distance, cluster), the lowest index of equals; null for null. One Arrow batch at a time."""

    @F.arrow_udf("struct<distance:double,cluster:long>")
    def near(features: pa.Array) -> pa.Array:
        real = features.is_valid().to_numpy(zero_copy_only=False)
        x = matrix_of(features.filter(pa.array(real)))
        least, which = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for k, c in enumerate(centroids):
            d = np.zeros(len(x))
            for j in range(x.shape[1]):
                step = x[:, j] - c[j]
                d += step * step
            closer = d < least
            least[closer], which[closer] = d[closer], k
        distance, cluster = np.full(len(real), np.nan), np.zeros(len(real), np.int64)
        distance[real], cluster[real] = least, which
        return pa.StructArray.from_arrays([pa.array(distance), pa.array(cluster)], ["distance", "cluster"], mask=pa.array(~real))

    return near


def assign(points: DataFrame, centroids: DataFrame | np.ndarray, features: str = "features") -> DataFrame:
    """Adds cluster and distance (squared): the nearest centroid, the lowest index of equals. One pass, no shuffle of the points."""
    near = points.withColumn("_near", nearest_of(centroid_matrix(centroids))(doubles(features)))
    return near.withColumn("cluster", F.col("_near.cluster")).withColumn("distance", F.col("_near.distance")).drop("_near")


def means(assigned: DataFrame, features: str = "features", weight: Column | None = None) -> DataFrame:
    """cluster, features: the (weighted) mean of each cluster, by one aggregation over (cluster, dimension)."""
    w = F.lit(1.0) if weight is None else weight
    flat = assigned.select("cluster", w.alias("w"), F.posexplode(doubles(features)).alias("dim", "x"))
    by_dim = flat.groupBy("cluster", "dim").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return by_dim.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("features"))


def lloyd_step(points: DataFrame, centroids: DataFrame, features: str = "features", weight: Column | None = None) -> DataFrame:
    """New centroids; a cluster that no point is nearest to keeps its old one."""
    moved = means(assign(points, centroids, features), features, weight)
    kept = centroids.select("cluster", doubles("features").alias("_old"))
    return kept.join(moved, "cluster", "left").select("cluster", F.coalesce("features", "_old").alias("features"))


def lloyd(points: DataFrame, centroids: np.ndarray, rounds: int = 3, features: str = "features", weight: str | None = None, tolerance: float = 0.0) -> np.ndarray:
    """k x d centroids after some rounds. Each round is one aggregation to k x d numbers on the driver, so plans don't grow."""
    c = np.asarray(centroids, float)
    for _ in range(rounds):
        found = {r.cluster: r.features for r in means(assign(points, c, features), features, None if weight is None else F.col(weight)).collect()}
        new = np.array([found.get(k, c[k]) for k in range(len(c))])
        done = np.abs(new - c).max(initial=0) <= tolerance
        c = new
        if done:
            break
    return c


def initial_centroids(points: DataFrame, key: str, k: int, seed: int, features: str = "features", replace: bool = False) -> np.ndarray:
    """k points at random, without replacement or with; of the points, k reach the driver."""
    if replace:
        draws = points.sparkSession.range(k).withColumnRenamed("id", "_draw")  # k rows
        each = points.crossJoin(F.broadcast(draws)).groupBy("_draw").agg(F.min_by(doubles(features), F.struct(uniform(seed, "_draw", key), F.col(key))).alias("f"))
        return np.array([r.f for r in each.orderBy("_draw").collect()])
    drawn = points.orderBy(uniform(seed, key), key).limit(k).select(doubles(features).alias("f"))
    return np.array([r.f for r in drawn.collect()])


def seeded(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++: up to k of the points, each drawn by weight times the squared distance to the nearest before it."""
    left, chosen = np.full(len(points), np.inf), []
    while len(chosen) < min(k, len(points)):
        mass = np.cumsum(weights * left if chosen else weights)
        if mass[-1] <= 0:
            break
        chosen.append(min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), len(points) - 1))
        left = np.minimum(left, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen].copy()


def _minibatch(points: np.ndarray, weights: np.ndarray, k: int, rounds: int, batch: int, seed: int, eta: str, replace: bool, init: str) -> np.ndarray:
    rng = kernel.generator(seed)
    c = seeded(points, weights, k, rng) if init == "k-means++" else points[rng.choice(len(points), min(k, len(points)), replace=replace)].copy()
    seen = np.zeros(len(c))
    for _ in range(rounds):
        order = rng.permutation(len(points))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            near = ((points[own][:, None, :] - c[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
            for i, j in zip(own, near, strict=True):
                seen[j] += weights[i]
                step = (weights[i] if eta == "weighted" else 1.0) / seen[j]
                c[j] += min(step, 1.0) * (points[i] - c[j])
    return c


def minibatch_kmeans(coreset: DataFrame, k: int = 3, rounds: int = 3, batch: int = 1000, seed: int = 3, eta: str = "weighted", replace: bool = False, init: str = "random") -> DataFrame:
    """cluster, features, from a coreset (weight, features), whose size is bounded, in one task. A point's step is its share of the
    weight that its cluster has seen (`unweighted`: one over that weight). init: `random` points, or `k-means++`."""

    def run(key, table):  # noqa: ANN001, ANN202
        """The whole coreset."""
        import pyarrow as pa

        order = np.lexsort((*matrix_of(table.column("features")).T, table.column("weight").to_numpy()))
        points, weights = matrix_of(table.column("features"))[order], table.column("weight").to_numpy()[order]
        c = _minibatch(points, weights, k, rounds, batch, seed, eta, replace, init)
        return pa.table({"cluster": pa.array(np.arange(len(c))), "features": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return coreset.select(F.lit(0).alias("one"), "weight", "features").groupBy("one").applyInArrow(run, "cluster long, features array<double>")


def minibatch_in_order(points: DataFrame, ordinal: str, centroids: np.ndarray, batch: int, features: str = "features", weight: str | None = None) -> DataFrame:
    """cluster, features: one round of mini-batch k-means over all batches of `batch` rows in the order of `ordinal`, the last may be short.
    Within a batch, assigning comes before moving, so each cluster takes the (weighted) mean of what it has seen.

    Each batch needs the centroids that the one before left, so one task reads the sorted rows as a stream and holds a batch at a time.
    """
    first = np.asarray(centroids, float)

    def run(parts):  # noqa: ANN001, ANN202
        """Rows in order, cut into batches whatever Arrow's are."""
        import pyarrow as pa

        c, seen, held = first.copy(), np.zeros(len(first)), np.zeros((0, first.shape[1] + 1))

        def move(rows: np.ndarray) -> None:
            x, w = rows[:, 1:], rows[:, 0]
            near = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
            for j in np.unique(near):
                own, mass = near == j, w[near == j].sum()
                if mass > 0:
                    c[j] = (c[j] * seen[j] + (x[own] * w[own, None]).sum(axis=0)) / (seen[j] + mass)
                    seen[j] += mass

        for b in parts:
            if b.num_rows:
                held = np.concatenate([held, np.column_stack([b.column(1).to_numpy(), matrix_of(b.column(0))])])
            whole = len(held) - len(held) % batch
            for at in range(0, whole, batch):
                move(held[at : at + batch])
            held = held[whole:]
        if len(held):
            move(held)
        yield pa.record_batch([pa.array(np.arange(len(c))), pa.array(c.tolist(), pa.list_(pa.float64()))], ["cluster", "features"])

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = points.select(F.col(ordinal).alias("_at"), doubles(features).alias("features"), w.alias("w"))
    return rows.repartition(1).sortWithinPartitions("_at").select("features", "w").mapInArrow(run, "cluster long, features array<double>")


def library_kmeans(points: DataFrame, k: int, seed: int = 3, rounds: int = 20, features: str = "features", weight: str | None = None) -> np.ndarray:
    """k x d centroids by the k-means of Spark's own library, to set beside those of coresets."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select(array_to_vector(doubles(features)).alias("features"), *([] if weight is None else [F.col(weight).cast("double").alias("weight")]))
    made = KMeans(k=k, seed=seed, maxIter=rounds, **({} if weight is None else {"weightCol": "weight"})).fit(rows)
    return np.array(made.clusterCenters())
