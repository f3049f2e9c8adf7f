"""Plans of merges and layouts of workers, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def n_steps(workers: Column) -> Column:
    """Steps of a merge pipeline: floor(log2 workers) + 1."""
    return (F.floor(F.log2(workers)) + 1).cast("long")


def workers_at(step: Column, workers: Column) -> Column:
    """Workers of a step: half as many as the step before, rounded half up."""
    return F.round(workers / F.pow(F.lit(2.0), step + 1)).cast("long")


def pipeline_steps(spark: SparkSession, workers: int) -> DataFrame:
    """step, workers, first_worker: a running sum places each step's workers behind those before."""
    w = F.lit(workers)
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), n_steps(w) - 1)).alias("step")).withColumn("workers", workers_at(F.col("step"), w.cast("double")))
    return rows.withColumn("first_worker", F.sum("workers").over(Window.orderBy("step")) - F.col("workers"))


def worker_layout(spark: SparkSession, workers: int) -> DataFrame:
    """worker, step, slot: each worker's step and its place in it."""
    steps = pipeline_steps(spark, workers).filter("workers > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("workers") - 1)))
    return steps.select((F.col("first_worker") + F.col("slot")).alias("worker"), "step", "slot")


def rank_map(spark: SparkSession, workers: int, ranks: int) -> DataFrame:
    """rank, worker: rank r is served by workers 1 to workers >> r, at least by worker 1."""
    rows = spark.range(ranks).withColumnRenamed("id", "rank")
    served = F.greatest(F.lit(1), F.call_function("shiftright", F.lit(workers).cast("long"), F.col("rank").cast("int")))
    return rows.select("rank", F.explode(F.sequence(F.lit(1).cast("long"), served.cast("long"))).alias("worker"))


def reductions_per_rank(spark: SparkSession, n_batches: int) -> DataFrame:
    """rank, reductions: n batches make n >> r coresets of rank r."""
    top = max(n_batches, 1).bit_length()
    rows = spark.range(top).withColumnRenamed("id", "rank")
    return rows.select("rank", F.call_function("shiftright", F.lit(n_batches).cast("long"), F.col("rank").cast("int")).alias("reductions")).filter("reductions > 0")


def bucket_occupancy(spark: SparkSession, n_batches: int) -> DataFrame:
    """rank, node: the coresets left over, one for each bit of n."""
    return reductions_per_rank(spark, n_batches).filter("reductions % 2 = 1").select("rank", (F.col("reductions") - 1).alias("node"))


def merge_plan(spark: SparkSession, n_batches: int) -> DataFrame:
    """rank, node, left, right: which coresets of the rank below each merge takes (null at rank 0, whose nodes are batches)."""
    nodes = reductions_per_rank(spark, n_batches).withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reductions") - 1)))
    below = F.col("rank") > 0
    return nodes.select("rank", "node", F.when(below, 2 * F.col("node")).alias("left"), F.when(below, 2 * F.col("node") + 1).alias("right"))


@udtf(returnType="rank: bigint, worker: bigint")
class RankMap:
    """rank_map(workers, ranks) for SQL."""

    def eval(self, workers: int, ranks: int):  # noqa: ANN201
        for rank in range(ranks):
            for worker in range(1, max(1, workers >> rank) + 1):
                yield rank, worker


@udtf(returnType="rank: bigint, node: bigint")
class MergePlan:
    """merge_plan(n_batches) for SQL."""

    def eval(self, n_batches: int):  # noqa: ANN201
        rank = 0
        while n_batches >> rank:
            for node in range(n_batches >> rank):
                yield rank, node
            rank += 1


def register(spark: SparkSession) -> None:
    """Table functions rank_map and merge_plan in SQL."""
    spark.udtf.register("rank_map", RankMap)
    spark.udtf.register("merge_plan", MergePlan)
