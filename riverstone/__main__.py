"""python -m riverstone POINTS OUT [M] [--k K] [--labels LABELS] [--format FORMAT]: points to a coreset, centroids and labels.

Writes OUT/coreset (coreset_bin), OUT/coreset_<M> (CSV), OUT/labels (labels_bin) and OUT/timings (CSV). A size that isn't a
number is replaced by the default, with a warning.
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import functions as F

from riverstone.operators import clustering, coreset, quality, rollup
from riverstone.session import build_session, stored
from riverstone.sources import binary, text


def size_of(given: str | None, default: int = coreset.DEFAULT_M) -> int:
    if given is None:
        return default
    try:
        m = int(given)
    except ValueError:
        m = 0
    if m < 1:
        warnings.warn(f"{given!r} is no size of a coreset; {default} is used", stacklevel=2)
        return default
    return m


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="riverstone", description=__doc__)
    parser.add_argument("points")
    parser.add_argument("out")
    parser.add_argument("m", nargs="?")
    parser.add_argument("--k", type=int, default=3)
    parser.add_argument("--labels")
    parser.add_argument("--format", default="points_bin")
    given = parser.parse_args(args)
    m, timers = size_of(given.m), rollup.Timers()
    spark = build_session()
    binary.register(spark)
    points = spark.read.format(given.format).load(given.points)
    with timers.timed("coreset"):
        made = stored(coreset.coreset(points, m), "coreset")
    dims = len(made.select("features").first()[0])
    with timers.timed("write"):
        made.select(F.col("weight").cast("float").alias("weight"), F.col("features").cast("array<float>").alias("features")).coalesce(1).write.format("coreset_bin").mode("overwrite").save(f"{given.out}/coreset")
        text.write_coreset_csv(made.coalesce(1), f"{given.out}/coreset_{m}", dims)
    with timers.timed("kmeans"):
        centroids = stored(clustering.minibatch_kmeans(made, given.k), "centroids")
    with timers.timed("labels"):
        near = clustering.assign(points, centroids)
        near.select("id", F.col("cluster").alias("label")).write.format("labels_bin").mode("overwrite").save(f"{given.out}/labels")
    if given.labels:
        real = spark.read.format("labels_bin").load(given.labels)
        share, n = quality.accuracy(near.select("id", "cluster").join(real, "id"), "cluster", "label", "id").first()
        print(f"accuracy {share:.6f} of {n}")
    timers.write(spark, f"{given.out}/timings")


if __name__ == "__main__":
    main()
