"""Draws that any engine can repeat: by uniform numbers made of keys, or by cumulative cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverstone.functions.rng import uniform
from riverstone.functions.vectors import cosine_distance, doubles, sq_l2
from riverstone.operators.batching import with_running_sum


def uniform_row(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One row, each with the same chance; no sort."""
    return df.orderBy(uniform(seed, key), key).limit(1)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement (a top-n, not a full sort)."""
    return df.orderBy(uniform(seed, key), key).limit(n)


def permuted(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(uniform(seed, key), key)


def with_cost(points: DataFrame, center: DataFrame, features: str = "features") -> DataFrame:
    """Adds d2, the squared distance to the one row of `center`."""
    one = center.select(doubles(features).alias("_center"))
    return points.crossJoin(F.broadcast(one)).withColumn("d2", sq_l2(doubles(features), F.col("_center"))).drop("_center")


def cumulative_cost(costs: DataFrame, key: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Adds acc, the running cost by key (within each leaf, if there are several), and total."""
    cost = F.col("d2") if weight is None else F.col("d2") * weight
    if not by:
        run = with_running_sum(costs, cost, key)
        return run.crossJoin(F.broadcast(costs.agg(F.sum(cost).alias("total"))))
    # One running sum over all leaves, less what the leaves before have; there is a row for each leaf.
    run = with_running_sum(costs, cost, *by, key)
    sums = costs.groupBy(*by).agg(F.sum(cost).alias("total"))
    before = sums.withColumn("_before_leaf", F.sum("total").over(Window.orderBy(*by)) - F.col("total"))
    return run.join(F.broadcast(before), list(by)).withColumn("acc", F.col("acc") - F.col("_before_leaf")).drop("_before_leaf")


def d2_candidates(costs: DataFrame, key: str, center_id: Column, seed: int, tries: int = 3) -> DataFrame:
    """try, candidate: for each of a few thresholds u * total, the first row (not the centre) where the running cost reaches it. Candidates are
    distinct: a row that an earlier try has taken passes its turn on to the next, so of each try as many rows are looked at as there are tries."""
    drawn = costs.sparkSession.range(tries).select(F.col("id").alias("try"), uniform(seed, "id").alias("u"))
    hit = costs.join(F.broadcast(drawn), F.col("acc") >= F.col("u") * F.col("total")).filter(F.col(key) != center_id)
    place = F.row_number().over(Window.partitionBy("try").orderBy(key))
    few = hit.select("try", F.col(key).alias("k"), place.alias("place")).filter(F.col("place") <= tries)  # tries * tries rows
    rows = few.groupBy("try").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    lists = rows.agg(F.map_from_entries(F.collect_list(F.struct("try", "ks"))).alias("of"))
    taken = F.array().cast(rows.schema["ks"].dataType)
    for t in range(tries):
        left = F.array_except(F.coalesce(F.col("of")[F.lit(t).cast("long")], taken), taken)
        lists = lists.withColumn(f"c{t}", F.get(left, 0))
        taken = F.array_compact(F.array(*[F.col(f"c{i}") for i in range(t + 1)]))
    made = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("try"), F.col(f"c{t}").alias("candidate")) for t in range(tries)]))
    return lists.select(made.alias("r")).select("r.*").filter("candidate is not null")


def candidate_costs(costs: DataFrame, candidates: DataFrame, features: str = "features") -> DataFrame:
    """candidate, new_cost, new_side: what is left if a candidate (id, features; a few rows) becomes a centre, and how many move to it."""
    few = candidates.select(F.col("candidate"), doubles(features).alias("_new"))
    both = costs.join(F.broadcast(few)).withColumn("nd", sq_l2(doubles(features), F.col("_new")))
    return both.groupBy("candidate").agg(F.sum(F.least("d2", "nd")).alias("new_cost"), F.sum((F.col("nd") <= F.col("d2")).cast("long")).alias("new_side"))


def best_candidate(costed: DataFrame) -> DataFrame:
    """The candidate that leaves the least; the smallest id of equals."""
    return costed.orderBy("new_cost", "candidate").limit(1)


def split(costs: DataFrame, new_center: DataFrame, features: str = "features") -> DataFrame:
    """Adds side: 0 if the old centre is nearer, else 1, and the distance to the side's centre as d2."""
    one = new_center.select(doubles(features).alias("_new"))
    both = costs.crossJoin(F.broadcast(one)).withColumn("nd", sq_l2(doubles(features), F.col("_new")))
    return both.withColumn("side", F.when(F.col("d2") < F.col("nd"), 0).otherwise(1)).withColumn("d2", F.least("d2", "nd")).drop("_new", "nd")


def farthest(points: DataFrame, key: str, center: DataFrame, features: str = "features") -> DataFrame:
    """The row of the largest cosine distance to a centre; the smallest id of equals."""
    one = center.select(doubles(features).alias("_center"))
    far = points.crossJoin(F.broadcast(one)).withColumn("distance", F.round(cosine_distance(doubles(features), F.col("_center")), 9)).drop("_center")
    return far.orderBy(F.desc("distance"), key).limit(1)


def cosine_side(features: Column, left: Column, right: Column, tolerance: float = 1e-9) -> Column:
    """0 if the left centre's cosine is larger by over the tolerance, else 1."""
    return F.when(cosine_distance(features, right) - cosine_distance(features, left) > tolerance, 0).otherwise(1)
