import numpy as np
import pytest
from pyspark.sql import functions as F

from riverstone.functions import rng, vectors
from riverstone.operators import batching, collectives, quality, rollup, sampling, topology
from riverstone.session import SETTINGS, build_session


def test_ordinals_follow_the_order(spark):
    rows = spark.range(1000).withColumn("key", F.md5(F.col("id").cast("string")))
    got = batching.with_ordinal(rows, "key").select("key", "ordinal").collect()
    assert [r.key for r in sorted(got, key=lambda r: r.ordinal)] == sorted(r.key for r in got)
    assert sorted(r.ordinal for r in got) == list(range(1000))


def test_running_sums(spark):
    rows = spark.range(500).withColumn("v", F.col("id") % 7)
    got = {r.id: r.acc for r in batching.with_running_sum(rows, F.col("v"), "id").collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1)) for i in range(500)}
    by = sampling.cumulative_cost(rows.select("id", F.col("v").alias("leaf"), F.lit(1.0).alias("d2")), "id", ["leaf"]).filter("id = 14").first()
    assert (by.acc, by.total) == (3.0, 72.0)


@pytest.mark.parametrize(("n", "parts"), [(10, 3), (3, 7), (12, 4)])
def test_range_partition(spark, n, parts):
    got = [r[0] for r in spark.range(n).select(batching.range_partition_of(F.col("id"), F.lit(n), parts)).collect()]
    each = max(n // parts, 1)
    assert got == [min(i // each, parts - 1) for i in range(n)]


def test_replay_wraps_and_clamps(spark):
    got = [r[0] for r in spark.range(6).select(batching.replay_start(F.col("id"), F.lit(10), 4)).collect()]
    assert got == [0, 4, 6, 2, 6, 0]


@pytest.mark.parametrize("workers", [1, 2, 3, 7, 8, 21, 64])
def test_layout_identities(spark, workers):
    steps = {r.step: (r.workers, r.first_worker) for r in topology.pipeline_steps(spark, workers).collect()}
    assert len(steps) == int(np.floor(np.log2(workers))) + 1
    layout = topology.worker_layout(spark, workers).collect()
    assert sorted(r.worker for r in layout) == list(range(sum(w for w, _ in steps.values())))
    assert all(steps[r.step][1] + r.slot == r.worker and r.slot < steps[r.step][0] for r in layout)


@pytest.mark.parametrize("n", [0, 1, 5, 8, 13])
def test_merge_plans(spark, n):
    left = topology.bucket_occupancy(spark, n).collect()
    assert sum(1 << r["rank"] for r in left) == n
    plan = [(r["rank"], r.node) for r in topology.merge_plan(spark, n).collect()]
    topology.register(spark)
    assert sorted(plan) == sorted(map(tuple, spark.sql(f"select * from merge_plan({n})").collect()))
    assert sorted(map(tuple, topology.rank_map(spark, 16, 6).collect())) == sorted(map(tuple, spark.sql("select * from rank_map(16, 6)").collect()))


def test_uniform_numbers(spark):
    import hashlib

    got = {r.id: r.u for r in spark.range(2000).select("id", rng.uniform(3, "id").alias("u")).collect()}
    assert got[7] == int(hashlib.md5(b"3:7").hexdigest()[:8], 16) / 2**32
    assert abs(np.mean(list(got.values())) - 0.5) < 0.03


def test_distances(spark):
    row = spark.range(1).select(F.array(F.lit(1.0), F.lit(2.0)).alias("a"), F.array(F.lit(4.0), F.lit(6.0)).alias("b"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    got = row.select(vectors.sq_l2(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("z")), vectors.nearest(F.col("a"), F.array("b", "a", "a"))["cluster"]).first()
    assert got[0] == 25.0 and abs(got[1] - (1 - 16 / np.sqrt(5 * 52))) < 1e-12 and got[2] is None and got[3] == 1


def test_cosine_sides_and_ties(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    got = spark.range(1).select(sampling.cosine_side(v(1, 0.1), v(1, 0), v(0, 1)), sampling.cosine_side(v(1, 1), v(1, 0), v(0, 1)), sampling.cosine_side(v(0.1, 1), v(1, 0), v(0, 1))).first()
    assert tuple(got) == (0, 1, 1)


def test_ranges_and_logs(spark):
    got = spark.createDataFrame([("0-3,6",), ("5",), ("1,2-2",)], "t string").select(batching.expanded_ranges(F.col("t"))).collect()
    assert [r[0] for r in got] == [[0, 1, 2, 3, 6], [5], [1, 2]]
    lines = spark.createDataFrame([("took 123 ms", 123), ("none", None)], "line string, want long")
    assert lines.filter(~rollup.milliseconds_in(F.col("line")).eqNullSafe(F.col("want"))).count() == 0


def test_rollups_truncate(spark):
    rows = spark.createDataFrame([("a", 1.9), ("a", 2.9), ("b", -1.5)], "e string, v double")
    assert {r.e: (r["avg"], r["min"], r["max"], r["sum"], r["count"]) for r in rollup.timing_rollup(rows, "e", "v").collect()} == {"a": (2, 1, 2, 4, 2), "b": (-1, -1, -1, -1, 1)}


def test_timers(spark, tmp_path):
    t = rollup.Timers()
    with t.timed("x"):
        pass
    t.write(spark, f"{tmp_path}/t")
    assert t.frame(spark).first().event == "x" and spark.read.csv(f"{tmp_path}/t").count() == 1


def test_collectives(spark):
    rows = spark.createDataFrame([(r, r * 10.0, [f"{r}{j}" for j in range(3)]) for r in range(3)], "rank long, v double, sent array<string>")
    assert {r.total for r in collectives.all_reduce(rows, F.col("v")).collect()} == {30.0}
    assert collectives.reduce(rows, F.col("v"), "max").first()[0] == 20.0
    assert collectives.gather(rows.orderBy(F.desc("rank")), "rank", "v").first()[0] == [0.0, 10.0, 20.0]
    assert {(r["rank"], r.from_rank, r.value) for r in collectives.all_to_all(rows, "rank", "sent").collect()} == {(j, r, f"{r}{j}") for r in range(3) for j in range(3)}


def test_accuracy_ties_and_order(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 0, 4), (3, 0, 4), (4, 1, 7), (5, 1, 6)], "id long, cluster long, label long")
    assert abs(quality.accuracy(rows, "cluster", "label").first()[0] - 3 / 5) < 1e-12
    assert abs(quality.accuracy(rows, "cluster", "label", "id").first()[0] - 2 / 5) < 1e-12


def test_scaling(spark):
    got = spark.createDataFrame([(1.0, 1.0, 3.0), (3.0, 1.0, 3.0), (2.0, 2.0, 2.0)], "v double, lo double, hi double").select(quality.minmax(F.col("v"), F.col("lo"), F.col("hi"), (10.0, 200.0))).collect()
    assert [r[0] for r in got] == [10.0, 200.0, 50.0]
    z = quality.standardised(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), "a", "b").orderBy("a").collect()
    assert [r.features for r in z] == [[-1.0, 0.0], [1.0, 0.0]]


def test_session_settings(spark):
    assert build_session() is not None and SETTINGS["spark.sql.session.timeZone"] == "UTC"
