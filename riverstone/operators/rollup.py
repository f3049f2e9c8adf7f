"""Rollups of timings and counters, and what logs say."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def timing_rollup(events: DataFrame, event: str, value: str) -> DataFrame:
    """By event: avg, min, max, sum as whole numbers (towards zero) and the count."""
    whole = lambda f: f(value).cast("bigint")
    return events.groupBy(event).agg(whole(F.avg).alias("avg"), whole(F.min).alias("min"), whole(F.max).alias("max"), whole(F.sum).alias("sum"), F.count(event).alias("count"))


def counter_rollup(counters: DataFrame, event: str, unit: str, value: str, keep: Column) -> DataFrame:
    """By event and unit, of the rows kept: avg, min, max."""
    return counters.filter(keep).groupBy(event, unit).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))


def group_means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def rounds_variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By group: mean, sample variance and sample deviation over rounds."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.stddev_samp(value).alias("dev"))


def compared(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Means of two measures, how far apart they are and their sum."""
    one, two = F.avg(a), F.avg(b)
    return df.groupBy(*keys).agg(one.alias("d1"), two.alias("d2"), F.abs(two - one).alias("diff"), (one + two).alias("sum"))


def speedup(times: DataFrame, threads: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds speedup (the time of the fewest threads over this one) and efficiency."""
    order = Window.partitionBy(*keys).orderBy(threads)
    gain = F.first(value).over(order) / F.col(value)
    return times.withColumn("speedup", gain).withColumn("efficiency", gain / F.col(threads) * F.first(threads).over(order))


def consistent(df: DataFrame, value: str) -> DataFrame:
    """consistent: whether all rows agree on a value."""
    return df.agg((F.count_distinct(value) <= 1).alias("consistent"))


def mean_of_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean over groups of each group's sum."""
    return df.groupBy(*keys).agg(F.sum(value).alias("_total")).agg(F.avg("_total").alias("mean"))


def milliseconds_in(line: Column) -> Column:
    """The first `<digits> ms` of a line; null without one."""
    return F.nullif(F.regexp_extract(line, r"(\d+) ms", 1), F.lit("")).cast("bigint")


class Timers:
    """Named wall-clock timings of a driver program, as a DataFrame or a CSV without header."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []

    @contextmanager
    def timed(self, event: str):  # noqa: ANN201
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self.rows.append((event, (time.perf_counter_ns() - began) // 1000))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "event string, time_us long")

    def write(self, spark: SparkSession, path: str) -> None:
        write_timings(self.frame(spark).coalesce(1), path)


def write_timings(timings: DataFrame, path: str) -> None:
    """event, time_us as CSV without header."""
    timings.select("event", "time_us").write.mode("overwrite").csv(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event string, time_us long").csv(path)
