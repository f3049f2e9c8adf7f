import numpy as np
import pytest
from pyspark.sql import functions as F

from riverstone.functions.rng import uniform
from riverstone.operators import clustering, quality, sampling, seeding
from riverstone.operators.kernel import generator
from riverstone.sources import generate


def cost_of(points, centres):
    return quality.cost(clustering.assign(points, centres)).first()[0]


def plain_pp(x, k, seed, first):
    """k-means++ row by row, with the same uniforms."""
    chosen, left = [first], ((x - x[first]) ** 2).sum(axis=1)
    for i in range(1, k):
        run = np.cumsum(left)
        chosen.append(int(np.flatnonzero((run >= seeding.driver_uniform(seed, i) * run[-1]) & (left > 0))[0]))
        left = np.minimum(left, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


@pytest.mark.parametrize("keep", [seeding.KEEP, 3])
def test_plus_plus_against_rows_in_order(spark, monkeypatch, keep):
    """Whether distances are stored now and then or not."""
    monkeypatch.setattr(seeding, "KEEP", keep)
    points = generate.blobs(spark, 900, 3, k=6).repartition(5)
    rows = sorted(points.select("id", "features").collect())
    x = np.array([r.features for r in rows], float)
    keys, centres, left = seeding.kmeans_pp(points, "id", 9, 4)
    assert keys == plain_pp(x, 9, 4, keys[0])
    assert np.allclose(centres, x[keys]) and all(a >= b for a, b in zip(left, left[1:], strict=False))
    assert abs(left[-1] - cost_of(points, centres)) < 1e-6


def test_weights_and_duplicates(spark):
    rows = spark.createDataFrame([(k, [float(k % 3)], float(k < 6)) for k in range(60)], "id long, features array<double>, w double")
    keys, centres, left = seeding.kmeans_pp(rows, "id", 10, 1, weight="w")
    assert len(keys) == 3 and max(keys) < 6 and sorted(centres.ravel()) == [0, 1, 2] and left[-1] == 0
    assert seeding.kmeans_pp(rows.limit(0), "id", 3, 1)[0] == []
    assert len(seeding.kmeans_parallel(rows.limit(0), "id", 3, 1)) == 0
    assert len(seeding.kmeans_parallel(rows, "id", 10, 1)) == 3


def test_parallel_is_as_good_as_one_by_one(spark):
    """Seeds by k-means|| cost at most 1.3 times those of k-means++ (each the mean of four), and both far less than random ones."""
    points = generate.blobs(spark, 3000, 4, k=12, separation=30.0).repartition(4).cache()
    parallel = [cost_of(points, seeding.kmeans_parallel(points, "id", 12, s)) for s in range(4)]
    single = [cost_of(points, seeding.kmeans_pp(points, "id", 12, s)[1]) for s in range(4)]
    random = [cost_of(points, clustering.initial_centroids(points, "id", 12, s)) for s in range(4)]
    assert np.mean(parallel) <= 1.3 * np.mean(single) and np.mean(parallel) < 0.5 * np.mean(random)


def test_driver_uniform(spark):
    assert spark.range(1).select(uniform(7, F.lit(3), F.lit("x"))).first()[0] == seeding.driver_uniform(7, 3, "x")


def test_minibatch_from_seeds(spark):
    x = np.concatenate([np.random.default_rng(k).standard_normal((50, 2)) + 20 * k for k in range(4)])
    coreset = spark.createDataFrame([(1.0, r.tolist()) for r in x], "weight double, features array<double>")
    found = clustering.centroid_matrix(clustering.minibatch_kmeans(coreset, 4, init="k-means++"))
    assert sorted(np.round(found[:, 0] / 20).astype(int)) == [0, 1, 2, 3]
    assert len(clustering.seeded(x[:1], np.zeros(1), 3, generator(1))) == 0


def test_candidates_are_distinct(spark):
    """Thresholds that meet in one row give the rows after it."""
    rows = spark.createDataFrame([(k, 1000.0 if k == 5 else 1.0, 0) for k in range(12)], "id long, d2 double, c long")
    costs = sampling.cumulative_cost(rows, "id")
    got = {r["try"]: r.candidate for r in sampling.d2_candidates(costs, "id", F.col("c"), 5, 4).collect()}
    assert len(set(got.values())) == 4 and set(got.values()) <= {5, 6, 7, 8}
    few = sampling.d2_candidates(sampling.cumulative_cost(rows.filter("id in (0, 5)"), "id"), "id", F.col("c"), 5, 4).collect()
    assert [r.candidate for r in few] == [5]


def test_running_costs_of_leaves(spark):
    rows = spark.createDataFrame([(k, float(k % 7), k % 3) for k in range(90)], "id long, d2 double, leaf long")
    got = {r.id: (round(r.acc, 6), round(r.total, 6)) for r in sampling.cumulative_cost(rows, "id", by=("leaf",)).collect()}
    for leaf in range(3):
        acc, total = 0.0, sum(k % 7 for k in range(leaf, 90, 3))
        for k in range(leaf, 90, 3):
            acc += k % 7
            assert got[k] == (acc, total)
