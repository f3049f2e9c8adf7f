import numpy as np
import pytest
from pyspark.sql import functions as F

from riverstone.operators import clustering, coreset, quality
from riverstone.schema import checked_points
from riverstone.sources import generate


@pytest.fixture(scope="module")
def blobs(spark):
    return generate.blobs(spark, 6000, 3, 3).repartition(4).cache()


def rows(df):
    return sorted((r.weight, tuple(r.features)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"mode": "levels", "order_by": ("id",)}, {"n_tasks": 2, "fan_in": 2}, {"split": 1}])
def test_mass_rows_and_members(spark, blobs, options):
    if options.pop("split", 0):
        options = {"tries": 1}
    made = coreset.coreset(blobs, 100, **options)
    known = {tuple(r.features) for r in blobs.select(F.transform("features", lambda x: x.cast("double")).alias("features")).collect()}
    got = rows(made)
    assert len(got) == 100 and abs(sum(w for w, _ in got) - 6000) < 1e-6
    assert all(f in known for _, f in got)


def test_levels_do_not_depend_on_dealing(blobs):
    a = coreset.coreset(blobs.repartition(7), 60, mode="levels", order_by=("id",))
    b = coreset.coreset(blobs.coalesce(1), 60, mode="levels", order_by=("id",))
    assert rows(a) == rows(b)
    with pytest.raises(ValueError):
        coreset.coreset(blobs, 60, mode="levels")


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 200, 399, 400, 401])
def test_ragged_tails(spark, n):
    points = generate.blobs(spark, n, 2) if n else generate.blobs(spark, 1, 2).limit(0)
    for options in ({}, {"mode": "levels", "order_by": ("id",)}):
        got = rows(coreset.coreset(points, 100, **options))
        assert abs(sum(w for w, _ in got) - n) < 1e-9 and len(got) == min(n, 100)


def test_cost_on_the_coreset_is_near_that_of_all(blobs):
    small = coreset.coreset(blobs, 200)
    c = np.array([[9.0, 0.0, 1.0], [-5.0, 2.0, 3.0], [0.0, 0.0, 0.0]])
    full = quality.cost(clustering.assign(blobs, c)).first()[0]
    est = quality.cost(clustering.assign(small, c), F.col("weight")).first()[0]
    assert abs(est / full - 1) < 0.05


def test_whole_flow_finds_the_clusters(blobs):
    c = clustering.minibatch_kmeans(coreset.coreset(blobs, 200), 3, rounds=5, seed=1)
    first = np.array([r.features for r in c.orderBy("cluster").collect()])
    better = clustering.lloyd(blobs, first, 5)
    labelled = clustering.assign(blobs, better)
    share, n = quality.accuracy(labelled, "cluster", "label").first()
    assert share > 0.6 and n == 6000
    again = clustering.lloyd(coreset.coreset(blobs, 200), clustering.initial_centroids(blobs, "id", 3, 4), 4, weight="weight")
    assert again.shape == (3, 3) and clustering.initial_centroids(blobs, "id", 3, 4, replace=True).shape == (3, 3)


def test_weights_count_like_copies(spark):
    base = generate.blobs(spark, 300, 2)
    weighted = base.withColumn("w", F.col("id") % 4 + 1)
    copies = weighted.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "w")))
    c = np.array([[1.0, 1.0], [-4.0, 3.0]])
    a = quality.cost(clustering.assign(weighted, c), F.col("w")).first()[0]
    b = quality.cost(clustering.assign(copies, c)).first()[0]
    assert abs(a - b) < 1e-6 * b
    assert abs(coreset.coreset(weighted, 50, weight="w").agg(F.sum("weight")).first()[0] - copies.count()) < 1e-6
    m = {r.dim: (r.mean, r.var) for r in quality.weighted_moments(weighted, "w").collect()}
    n = {r.dim: (r.mean, r.var) for r in quality.feature_moments(copies).collect()}
    assert all(np.allclose(m[k], n[k]) for k in m)


def test_bad_points(spark):
    rows = [(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [1.0]), (6, [None, 1.0])]
    bad = spark.createDataFrame(rows, "id long, features array<float>")
    assert [r.id for r in checked_points(bad, 2, "drop").collect()] == [1]
    assert checked_points(bad.filter("id = 1"), 2).count() == 1
    with pytest.raises(Exception, match="not finite"):
        checked_points(bad, 2).collect()
    with pytest.raises(ValueError):
        checked_points(bad, 2, "ignore")
    with pytest.raises(Exception, match="differ in length"):
        coreset.coreset(bad.filter("id in (1, 5)"), 1).collect()
