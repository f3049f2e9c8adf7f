import numpy as np
from pyspark.sql import functions as F

from riverstone.operators import coreset as op
from riverstone.operators import kernel


def hot(spark, n=6000):
    """Most rows are of one group."""
    return spark.range(n).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.array(F.col("id").cast("double"), (F.col("id") % 13).cast("double")).alias("features"), (F.col("id") % 3 + 1).alias("w")).repartition(24)


def test_groups_keep_their_mass(spark):
    rows = hot(spark)
    want = {r.g: (r.w, min(20, r.n)) for r in rows.groupBy("g").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()}
    for held in (op.HELD_POINTS, 60):  # in one go, and in many small ones
        got = {r.key: (round(r.w, 6), r.n) for r in op.grouped_coresets(rows, "g", 20, weight="w", fan_in=3, held_points=held).groupBy("key").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
        assert got == want
    assert op.grouped_coresets(rows.limit(0), "g", 20).count() == 0


def test_no_task_gets_a_hot_group(spark, monkeypatch):
    """Of 4,800 rows of one group in 24 tasks, a merge gets at most fan_in * m, and the SQL aggregate at most m for each task."""
    rows = hot(spark)
    made = op.grouped_coresets(rows, "g", 10, fan_in=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 3 and plan.count("MapInArrow") >= 1
    op.register_partial(spark, "parts_10", 10)
    rows.select("g", "features", F.col("w").cast("double").alias("w")).createOrReplaceTempView("hot_rows")
    parts = spark.sql("SELECT * FROM parts_10(TABLE(hot_rows))")
    assert parts.filter("key = 'hot'").count() <= 24 * 10 and parts.agg(F.sum("weight")).first()[0] == rows.agg(F.sum("w")).first()[0]


def test_groups_in_one_kernel():
    groups = op.Groups(5, 1, 0, held_points=40)
    import pyarrow as pa

    rng = np.random.default_rng(0)
    given, mass = [], 0.0
    for _ in range(20):
        keys, w = rng.integers(0, 30, 50), rng.random(50)
        mass += w.sum()
        if groups.add(pa.array(keys), rng.standard_normal((50, 2)), w):
            assert groups.held == sum(sum(len(p) for p, _ in v) for v in groups.waiting.values()) + sum(len(p) for c in groups.counters.values() for p, _ in c.slots.values())
            given += list(groups.given())
    given += list(groups.given())
    assert abs(sum(w.sum() for _, _, w in given) - mass) < 1e-9 and all(len(w) <= 5 for _, _, w in given) and groups.held == 0


def test_trees_of_small_and_equal_points(spark):
    for x, m in ((np.zeros((5, 2)), 3), (np.ones((1, 2)), 3), (np.arange(8.0).reshape(4, 2), 9)):
        t = kernel.tree(x, np.ones(len(x)), m, kernel.generator(1))
        leaf = t["left"] < 0
        assert t["mass"][0] == len(x) and t["size"][leaf].sum() == len(x) and leaf.sum() <= min(m, len(x))
    rows = spark.createDataFrame([(1, 1, [1.0], 0.0), (1, 2, [2.0], 1.0), (2, 3, [1.0], 0.0), (1, 4, [9.0], 1.0)], "g long, id long, features array<double>, w double")
    nodes = op.tree_nodes(rows, "g", "id", 5, weight="w").collect()
    assert {r.g for r in nodes} == {1} and sorted(i for r in nodes for i in r.members or []) == [2, 4] and sum(r.left is None for r in nodes) == 2


def test_tries_of_a_leaf_are_distinct():
    rng = np.random.default_rng(3)
    for _ in range(50):
        own = rng.integers(1, 9, 6)
        starts = np.cumsum(own) - own
        cost = rng.random(own.sum()) * (rng.random(own.sum()) < 0.7)
        cost[starts] = 1.0  # a leaf that is split has cost
        tried = kernel._distinct([starts + rng.integers(0, own) for _ in range(3)], cost, starts, own)
        for leaf in range(6):
            taken = [int(c[leaf]) for c in tried]
            positive = (cost[starts[leaf] : starts[leaf] + own[leaf]] > 0).sum()
            assert len(set(taken)) == min(3, positive) and all(cost[c] > 0 and starts[leaf] <= c < starts[leaf] + own[leaf] for c in taken)
