"""Queries that have to read every row of their table, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverstone.operators import clustering
from riverstone.plans.registry import QUERIES, points


def minibatch(x, c, batch):
    """Point by point: all of a batch are assigned before any centroid moves."""
    c, seen = np.array(c, float), np.zeros(len(c))
    for at in range(0, len(x), batch):
        own = x[at : at + batch]
        near = [int(np.argmin(((p - c) ** 2).sum(axis=1))) for p in own]
        for p, j in zip(own, near, strict=True):
            seen[j] += 1
            c[j] += (p - c[j]) / seen[j]
    return c


@pytest.mark.parametrize(("n", "batch"), [(1, 7), (7, 7), (500, 7), (20, 50)])
def test_minibatch_goes_over_all_batches(spark, n, batch):
    x = np.random.default_rng(n).normal(size=(n, 3)) + np.arange(n)[:, None] / 50
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "at long, features array<double>").repartition(5, F.hash("at"))
    first = np.array([[0.0, 0, 0], [5, 5, 5], [99, 99, 99]])
    got = {r.cluster: r.features for r in clustering.minibatch_in_order(rows, "at", first, batch).collect()}
    assert np.allclose([got[k] for k in range(3)], minibatch(x, first, batch))
    assert got[2] == [99, 99, 99]


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_minibatch_unit_weight_all(spark, sf, size):
    sf = sf.replace("0.001", size)
    x = np.array([r.features for r in points(spark, sf).orderBy("vec_id").collect()], float)
    want = minibatch(x, x[:3], 200)
    got = np.zeros(want.shape)
    for r in QUERIES["minibatch_unit_weight_all"](spark, sf).collect():
        got[r.cluster, r.dim] = r.x
    assert len(x) > 400 and np.allclose(got, want, atol=1e-5)
    cut = np.array(minibatch(x[:400], x[:3], 200))
    assert not np.allclose(want, cut, atol=1e-3)
