"""Positions, batches, partitions and dispatch of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverstone.functions.rng import uniform
from riverstone.session import stored


def ranged(df: DataFrame, order_by: tuple[str, ...], n_partitions: int | None = None) -> DataFrame:
    """df range-partitioned by an order, with the number of each row's partition (_part) and its place there (_at).

    Stored, as the bounds of ranges are sampled and another evaluation may cut elsewhere.
    """
    n = n_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return stored(placed, "ranged")


def _before(placed: DataFrame, amount: Column) -> DataFrame:
    """_part, _before: the sum over all partitions before; a row for each partition."""
    sums = placed.groupBy("_part").agg(amount.alias("_sum"))
    return sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))


def with_ordinal(df: DataFrame, *order_by: str, name: str = "ordinal", n_partitions: int | None = None) -> DataFrame:
    """Adds the position of each row in a total order, from 0, without bringing all rows to one task."""
    placed = ranged(df, order_by, n_partitions)
    both = placed.join(F.broadcast(_before(placed, F.count("*"))), "_part")
    return both.withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def with_running_sum(df: DataFrame, value: Column, *order_by: str, name: str = "acc", n_partitions: int | None = None) -> DataFrame:
    """Adds the sum of a value over all rows up to this one in a total order, without bringing all rows to one task."""
    placed = ranged(df, order_by, n_partitions)
    both = placed.join(F.broadcast(_before(placed, F.sum(value))), "_part")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, F.col("_before") + within).drop("_part", "_at", "_before")


def batch_of(ordinal: Column, size: int) -> Column:
    """Batches of consecutive rows; the last may be short."""
    return F.floor(ordinal / F.lit(size)).cast("long")


def range_partition_of(ordinal: Column, n_rows: Column, parts: int) -> Column:
    """parts ranges of n_rows div parts rows; the last takes the rest."""
    each = F.greatest(F.floor(n_rows / F.lit(parts)), F.lit(1))
    return F.least(F.floor(ordinal / each), F.lit(parts - 1)).cast("long")


def worker_of(batch: Column, workers: int) -> Column:
    """Round robin."""
    return F.pmod(batch, F.lit(workers)).cast("long")


def random_worker_of(batch: Column, workers: int, seed: int) -> Column:
    """A worker at random for each batch, the same one each time."""
    return F.floor(uniform(seed, batch) * workers).cast("long")


def replay_start(step: Column, n_rows: Column, size: int) -> Column:
    """Where the chunk of a step begins when chunks are taken round and round; one that would run over the end is the last whole one."""
    at = F.pmod(step * F.lit(size), n_rows)
    return F.when(at + F.lit(size) > n_rows, n_rows - F.lit(size)).otherwise(at).cast("long")


def replayed(df: DataFrame, ordinal: str, n_rows: int, size: int, steps: int) -> DataFrame:
    """Rows of `steps` chunks: step, and the columns of df. Each row finds its steps by the chunk's start."""
    starts = df.sparkSession.range(steps).select(F.col("id").alias("step"), replay_start(F.col("id"), F.lit(n_rows), size).alias("_start"))
    covered = starts.select("step", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.lit(size - 1))).alias(ordinal))
    return covered.join(df, ordinal)


def without_rows(df: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the positions."""
    return df.join(positions.select(key).distinct(), key, "left_anti")


def without_empty(groups: DataFrame, count: str) -> DataFrame:
    """Groups that have rows; a null count is none."""
    return groups.filter(F.col(count) > 0)


def expanded_ranges(text: Column) -> Column:
    """'0-3,6' to array(0, 1, 2, 3, 6)."""
    part = lambda p: F.split(p, "-")
    return F.flatten(F.transform(F.split(text, ","), lambda p: F.sequence(F.element_at(part(p), 1).cast("long"), F.element_at(part(p), -1).cast("long"))))
