"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from riverstone.operators import clustering, coreset, quality
from riverstone.plans import registry
from riverstone.session import build_session
from riverstone.sources import generate

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BLOB_ROWS = int(os.environ.get("BENCH_BLOB_ROWS", "4000000"))
NAMES = ["dataset_profile", "feature_moments", "nearest_centroid", "cluster_cost", "lloyd_centroids", "accuracy_majority", "delta_rollup", "stat_rollup", "bench_group_mean", "bench_variance", "d2_cumulative", "best_candidate", "coreset_mass", "lineitem_coreset_mass", "coreset_cost_ratio_ok", "stream_coreset_mass", "points_bin_roundtrip"]


def timed(make) -> float:  # noqa: ANN001
    """The median of a few runs after one that warms up."""
    took = []
    for _ in range(RUNS + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took[1:]), 3)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", spark_driver_memory="12g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_sql_shuffle_partitions=str(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda n=name: registry.QUERIES[n](spark, SF_DIR)) for name in NAMES}
    points = registry.lineitem_points(spark, SF_DIR).cache()
    n_points = points.count()
    for m in (100, 500, 2000):
        times[f"coreset_lineitem_m{m}"] = timed(lambda m=m: coreset.coreset(points.repartition(CPUS), m))
    centres = generate.centres(8, 4, 2.0, 1)
    times["assign_lineitem_k8"] = timed(lambda: quality.cost(clustering.assign(points, centres)))
    blobs = generate.blobs(spark, BLOB_ROWS, 3, 2, n_partitions=CPUS).select("features").cache()
    blobs.agg(F.count("*")).collect()
    times["coreset_blobs_m10000"] = timed(lambda: coreset.coreset(blobs, 10_000))
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/"), "lineitem_rows": n_points, "blob_rows": BLOB_ROWS, "blob_rows_a_second": round(BLOB_ROWS / times["coreset_blobs_m10000"])}))


if __name__ == "__main__":
    main()
