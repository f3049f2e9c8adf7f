"""Seeds of k-means over whole tables: k-means++, one centre at a time, and k-means||, some rounds of many and a weighted choice among them.

Both draw by uniforms made of MD5, so that any engine finds the same seeds. Rows never leave their partitions: of a round, the driver gets
the cost of each range of rows (k-means++), or the points that it drew (k-means||, about `oversampling` of them).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverstone.functions.rng import uniform
from riverstone.functions.vectors import doubles
from riverstone.operators.batching import ranged
from riverstone.operators.clustering import assign, nearest_of, seeded
from riverstone.operators.kernel import generator
from riverstone.operators.sampling import uniform_row
from riverstone.session import stored

#: Centres after which the distances so far are stored, so that a round measures at most so many.
KEEP = 16


def driver_uniform(seed: int, *keys: int) -> float:
    """What functions.rng.uniform() gives for these keys."""
    text = ":".join(map(str, (seed, *keys)))
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:8], 16) / 4294967296.0


def _nearer(known: Column, centres: list[list[float]]) -> Column:
    return F.least(known, nearest_of(np.array(centres))(F.col("features"))["distance"])


def kmeans_pp(points: DataFrame, key: str, k: int, seed: int, features: str = "features", weight: str | None = None) -> tuple[list, np.ndarray, list[float]]:
    """Keys of k rows, their points and the cost that is left after each: the next row is drawn by its share of the cost.

    In the order of the key, it is the first row of positive cost at which the running cost reaches u * total. Fewer rows if no cost is left.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = ranged(points.select(F.col(key).alias("key"), doubles(features).alias("features"), w.alias("w"), F.lit(float("inf")).alias("d2")), ("key",))
    first = uniform_row(rows.filter("w > 0"), "key", seed).select("key", "features").collect()
    keys, centres, left = [r.key for r in first], [list(r.features) for r in first], []
    fresh = list(centres)
    while keys:
        costed = rows.withColumn("cost", _nearer(F.col("d2"), fresh) * F.col("w"))
        sums = sorted((r._part, r.c) for r in costed.groupBy("_part").agg(F.sum("cost").alias("c")).collect())  # a row for each range
        run = np.cumsum([c for _, c in sums])
        left.append(float(run[-1]))
        if len(keys) == k or run[-1] <= 0:
            break
        target = driver_uniform(seed, len(keys)) * run[-1]
        real = np.array([c > 0 for _, c in sums])
        at = int(np.argmax(real & (run >= target))) if (real & (run >= target)).any() else int(np.flatnonzero(real)[-1])
        own = costed.filter(F.col("_part") == sums[at][0])
        within = own.withColumn("acc", F.sum("cost").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
        before = float(run[at - 1]) if at else 0.0
        # Sums in another order may differ in their last digits: then the range's last row of positive cost is the one.
        row = within.filter("cost > 0").select("key", "features", (F.col("acc") + before >= target).alias("reached"), "_at").orderBy(F.desc("reached"), F.when(F.col("reached"), F.col("_at")).otherwise(-F.col("_at"))).first()
        keys.append(row.key)
        centres.append(list(row.features))
        fresh.append(centres[-1])
        if len(fresh) >= KEEP:
            rows, fresh = stored(rows.withColumn("d2", _nearer(F.col("d2"), fresh)), "distances"), [centres[-1]]
    return keys, np.array(centres), left


def oversampled(points: DataFrame, key: str, oversampling: float, rounds: int, seed: int, features: str = "features") -> tuple[list[tuple[int, object]], np.ndarray]:
    """(round, key) and points of the candidates of k-means||: one row to begin with, then in each round each row with its own chance.

    A row is taken if its uniform is under oversampling * cost / total, so about `oversampling` rows are in each round.
    """
    rows = points.select(F.col(key).alias("key"), doubles(features).alias("features"), F.lit(float("inf")).alias("d2"))
    first = uniform_row(rows, "key", seed).select("key", "features").collect()
    found, centres = [(0, r.key) for r in first], [list(r.features) for r in first]
    fresh = list(centres)
    for r in range(1, rounds + 1):
        if not fresh:
            break
        rows = stored(rows.withColumn("d2", _nearer(F.col("d2"), fresh)), "distances")
        total = rows.agg(F.sum("d2")).first()[0]
        if not total:
            break
        drawn = rows.filter((uniform(seed, F.lit(r), F.col("key")) < F.lit(oversampling) * F.col("d2") / F.lit(total)) & (F.col("d2") > 0))
        taken = drawn.select("key", "features").orderBy("key").collect()  # about `oversampling` rows
        found += [(r, x.key) for x in taken]
        fresh = [list(x.features) for x in taken]
        centres += fresh
    return found, np.array(centres)


def candidate_weights(points: DataFrame, centres: np.ndarray, features: str = "features") -> np.ndarray:
    """How many rows each candidate is nearest to."""
    out = np.zeros(len(centres))
    for cluster, n in assign(points.select(features), centres, features).groupBy("cluster").count().collect():  # a row for each candidate
        out[cluster] = n
    return out


def kmeans_parallel(points: DataFrame, key: str, k: int, seed: int, oversampling: float | None = None, rounds: int = 5, features: str = "features", tries: int = 8) -> np.ndarray:
    """k x d seeds by k-means||: candidates weighted by the rows nearest to them, and of them k by weighted k-means++, the best of some tries."""
    _, centres = oversampled(points, key, oversampling or 2.0 * k, rounds, seed, features)
    if not len(centres):
        return centres
    weights = candidate_weights(points, centres, features)
    made = [seeded(centres, weights, k, generator(seed, t)) for t in range(tries)]
    cost = lambda c: (weights * ((centres[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).min(axis=1)).sum()
    return min(made, key=cost)
