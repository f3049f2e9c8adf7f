import os

import numpy as np
from pyspark.sql import functions as F

from riverstone.operators.coreset import coreset_levels
from riverstone.sources import generate
from riverstone.sources.streams import file_stream
from riverstone.streaming import coreset_stream as cs
from riverstone.streaming import metrics, panes


def stream(spark, files, tmp_path, m, shards, name):
    out = f"{tmp_path}/{name}-out"
    src = spark.readStream.schema("id long, features array<float>, label long").option("maxFilesPerTrigger", 1).parquet(files)
    job = cs.stream_coresets(src, m, shards).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True)
    job.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).start().awaitTermination()
    return spark.read.schema(cs.OUTPUT).parquet(out)


def write_files(spark, tmp_path, sizes):
    path, at = f"{tmp_path}/in", 0
    points = generate.blobs(spark, sum(sizes), 2).cache()
    for k, n in enumerate(sizes):
        points.filter((F.col("id") >= at) & (F.col("id") < at + n)).coalesce(1).write.parquet(f"{path}/part-{k:03d}")
        os.system(f"mv {path}/part-{k:03d}/part-*.parquet {path}/f{k:03d}.parquet && rm -r {path}/part-{k:03d} && touch -d '2020-01-01 00:00:{k:02d}' {path}/f{k:03d}.parquet")
        at += n
    return path, points


def test_micro_batches_do_not_matter(spark, tmp_path):
    """One shard's counter is that of batches of 2m points, whatever files come together, and what waits is kept."""
    files, points = write_files(spark, tmp_path, [130, 7, 263, 90, 33])
    got = cs.latest(stream(spark, files, tmp_path, 50, 1, "a"))
    mass = {r[0]: (r[1], r[2]) for r in got.groupBy("rank").agg(F.sum("weight"), F.count("*")).collect()}
    assert mass == {-1: (23.0, 23), 0: (100.0, 50), 2: (400.0, 50)}
    want = {(r.rank, r.n): r.w for r in coreset_levels(points.filter("id < 500"), 50, order_by=("id",)).groupBy("rank").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert want == {(0, 50): 100.0, (2, 50): 400.0}


def test_restart_goes_on(spark, tmp_path):
    files, _ = write_files(spark, tmp_path, [150, 150])
    os.rename(f"{files}/f001.parquet", f"{tmp_path}/later.parquet")
    first = stream(spark, files, tmp_path, 20, 3, "b")
    assert first.agg(F.max("version")).first()[0] == 1
    os.rename(f"{tmp_path}/later.parquet", f"{files}/f001.parquet")
    both = stream(spark, files, tmp_path, 20, 3, "b")
    assert abs(cs.latest(both).agg(F.sum("weight")).first()[0] - 300) < 1e-6
    final = cs.combined(both, 20).collect()
    assert len(final) == 20 and abs(sum(r.weight for r in final) - 300) < 1e-6


def test_windows(spark):
    rows = spark.range(100).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.array(F.col("id").cast("double")).alias("features"))
    made = cs.windowed_coresets(rows, "ts", "1 hour", 10).groupBy("window_start").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).orderBy("window_start").collect()
    assert [(r.w, r.n) for r in made] == [(60.0, 10), (40.0, 10)]
    assert np.isfinite([r.w for r in made]).all()


def test_windows_of_a_stream_and_late_rows(spark, tmp_path):
    """Rows behind the watermark are left out, windows stay apart, and a window's answer grows with its rows."""
    files = [[(k, 60 * k) for k in range(100)], [(200 + k, 60 * (300 + k)) for k in range(30)], [(400, 60), (401, 60 * 310), (402, 60 * 400)]]
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds(F.col("s") + 86400).alias("ts"), F.array(F.col("id").cast("double")).alias("features"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part-{k}")
        os.system(f"mv {tmp_path}/in/part-{k}/part-*.parquet {tmp_path}/in/f{k}.parquet && rm -r {tmp_path}/in/part-{k} && touch -d '2020-01-01 00:00:0{k}' {tmp_path}/in/f{k}.parquet")
    rows = file_stream(spark, f"{tmp_path}/in", "id long, ts timestamp, features array<double>", files_per_trigger=1)
    made = panes.stream_panes(rows, "ts", "1 hour", "30 minutes", 10)
    job = made.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    job.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")).start().awaitTermination()
    answers = spark.read.schema(panes.OUTPUT).parquet(f"{tmp_path}/out")
    found = panes.sliding_windows(answers, "1 hour", "1 hour", "1 hour", 10)
    got = {int(r.t) // 3600 - 24: (r.w, r.n) for r in found.groupBy(F.unix_seconds("window_start").alias("t")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    assert got == {0: (60.0, 10), 1: (40.0, 10), 5: (31.0, 10), 6: (1.0, 1)}


def test_state_is_read_as_a_table_and_written_by_rank(spark, tmp_path):
    """What the checkpoint holds is what was answered last; a trigger leaves ranks that it hasn't changed as they were."""
    files, points = write_files(spark, tmp_path, [1030, 12])
    os.rename(f"{files}/f001.parquet", f"{tmp_path}/later.parquet")
    key = lambda df: sorted((r.shard, r.rank, r.weight, tuple(r.features)) for r in df.collect())
    first = cs.latest(stream(spark, files, tmp_path, 20, 2, "c"))
    held = key(cs.stored_answers(spark, f"{tmp_path}/c-state"))
    assert held == key(first.select("shard", "rank", "weight", "features"))
    assert max(r[1] for r in held) >= 3
    os.rename(f"{tmp_path}/later.parquet", f"{files}/f001.parquet")
    both = cs.latest(stream(spark, files, tmp_path, 20, 2, "c"))
    after = key(cs.stored_answers(spark, f"{tmp_path}/c-state"))
    assert after == key(both.select("shard", "rank", "weight", "features"))
    assert {r for r in held if r[1] >= 3} == {r for r in after if r[1] >= 3}
    changed = spark.read.format("statestore").option("path", f"{tmp_path}/c-state").option("stateVarName", "ranks").option("readChangeFeed", "true").option("changeStartBatchId", 1).load()
    assert changed.filter("user_map_key.rank >= 3").count() == 0
    assert abs(sum(r[2] for r in after) - 1042) < 1e-6


def test_counters_of_a_stream(spark, tmp_path):
    """Counters of each micro-batch add up to the rows and reductions of the whole stream."""
    files, _ = write_files(spark, tmp_path, [90, 210, 100])
    counters = metrics.Counters("mine")
    spark.streams.addListener(counters)
    try:
        src = spark.readStream.schema("id long, features array<float>, label long").option("maxFilesPerTrigger", 1).parquet(files)
        job = metrics.counted(cs.stream_coresets(src, 25), "mine").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("noop").start()
        job.awaitTermination()
        counters.wait(job.runId)
    finally:
        spark.streams.removeListener(counters)
    found = counters.frame(spark)
    assert found.select("batch", "rows").distinct().agg(F.sum("rows"), F.count("*")).first() == (400, 3)
    assert {r.counter: r.n for r in found.groupBy("counter").agg(F.sum("n").alias("n")).filter("n > 0 and counter like 'rank%'").collect()} == {"rank0": 8, "rank1": 4, "rank2": 2, "rank3": 1}
