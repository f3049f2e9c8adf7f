import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riverstone.sources.streams import file_stream
from riverstone.streaming import panes


def streamed(spark, tmp_path, batches, pane, delay, m=4, by=None, shards=2, key_buckets=None):
    """Answers of a stream of (id, key, minute) rows, stopped after each batch."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, name string, minute long").select("id", "name", F.timestamp_seconds(F.col("minute") * 60 + 86400).alias("ts"), F.array(F.col("id").cast("double")).alias("features"))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        source = file_stream(spark, f"{tmp_path}/in", "id long, name string, ts timestamp, features array<double>")
        made = panes.stream_panes(source, "ts", pane, delay, m, by, shards, key_buckets=key_buckets)
        job = made.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        job.foreachBatch(lambda df, b, k=k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/run={k}/batch={b}")).start().awaitTermination()
    return spark.read.schema(panes.OUTPUT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")


def minutes(column):
    return (F.unix_micros(column) / 60_000_000 - 1440).cast("long")


def test_a_late_row_joins_sessions(spark, tmp_path):
    """Two sessions of a key are one once a late row stands between them; rows behind the watermark change nothing; other keys are apart."""
    batches = [[(k, "a", k) for k in (0, 5, 8, 30, 33)] + [(50, "b", 31)], [(60, "a", 19), (61, "a", 24), (62, "c", 90)], [(70, "a", 1), (71, "a", 80)]]
    answers = streamed(spark, tmp_path, batches, "10 minutes", "60 minutes", by=F.col("name"))
    got = panes.session_windows(answers, "12 minutes", "10 minutes", 4).groupBy("key", minutes("session_start").alias("a"), minutes("session_end").alias("b")).agg(F.max("n_rows").alias("n"), F.sum("weight").alias("w")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, 45, 7, 7.0), ("a", 80, 92, 1, 1.0), ("b", 31, 43, 1, 1.0), ("c", 90, 102, 1, 1.0)]
    with pytest.raises(ValueError):
        panes.session_windows(answers, "5 minutes", "10 minutes", 4)


def test_a_gap_as_long_as_the_gap_ends_a_session(spark, tmp_path):
    answers = streamed(spark, tmp_path, [[(1, "a", 0), (2, "a", 12), (3, "a", 23)]], "6 minutes", "1 day", by=F.col("name"))
    got = panes.session_windows(answers, "12 minutes", "6 minutes", 4).select(minutes("session_start"), minutes("session_end"), "n_rows").distinct().collect()
    assert sorted(tuple(r) for r in got) == [(0, 12, 1), (12, 35, 2)]


def test_sliding_windows_and_long_sessions(spark, tmp_path):
    """Each row is in width / slide windows and one pane; a session of many panes is merged in steps; a hot window is in several states."""
    rows = [(k, "x", k // 2) for k in range(400)]
    answers = streamed(spark, tmp_path, [rows[::2], rows[1::2]], "10 minutes", "1 day", m=3, shards=4)
    assert panes.latest(answers).groupBy("pane").agg(F.countDistinct("shard").alias("s")).agg(F.min("s")).first()[0] > 1
    got = {r.t: (r.n, r.w, r.c) for r in panes.sliding_windows(answers, "30 minutes", "20 minutes", "10 minutes", 3).groupBy(minutes("window_start").alias("t")).agg(F.max("n_rows").alias("n"), F.sum("weight").alias("w"), F.count("*").alias("c")).collect()}
    for t, (n, w, c) in got.items():
        own = sum(t <= m < t + 30 for _, _, m in rows)
        assert (n, round(w, 6), c) == (own, own, min(3, own))
    assert set(got) == {t for t in range(-20, 200, 20) if any(t <= m < t + 30 for _, _, m in rows)}
    whole = panes.session_windows(answers, "10 minutes", "10 minutes", 3).agg(F.sum("weight"), F.count("*"), F.max("n_rows")).first()
    assert (round(whole[0], 6), whole[1], whole[2]) == (400.0, 3, 400)
    with pytest.raises(ValueError):
        panes.sliding_windows(answers, "25 minutes", "20 minutes", "10 minutes", 3)


def test_intervals(spark):
    assert panes.micros(spark.range(1), "1 day 2 hours") == 26 * 3_600_000_000 and panes.micros(spark.range(1), "3 seconds") == 3_000_000
    assert os.path.exists(panes.__file__)


def test_keys_that_share_states_have_the_answers_of_their_own(spark, tmp_path):
    """A hot key and many of few rows: panes of buckets of keys have the rows, times and mass of a state for each key, and
    the same points where nothing was drawn (draws follow the order in which rows come); names of any length and null are keys."""
    names = [None, "", "hot", "é" * 300, *(f"k{j}" for j in range(20))]
    rows = [(k, "hot" if k % 3 == 0 else names[k % len(names)], k % 25) for k in range(300)]
    made = []
    for buckets in (None, 3):
        path = tmp_path / str(buckets)
        answers = streamed(spark, path, [rows[::2], rows[1::2]], "10 minutes", "1 day", by=F.col("name"), key_buckets=buckets)
        made.append(sorted((r.key, r.pane, r.shard, r.n_rows, r.first, r.last, r.weight, *r.features) for r in panes.latest(answers).collect()))
    few = [[r for r in rows if r[3] < 8] for rows in made]
    assert few[0] == few[1] and few[0]
    facts = [{r[:6]: round(sum(x[6] for x in rows if x[:6] == r[:6]), 6) for r in rows} for rows in made]
    assert facts[0] == facts[1] and all(mass == r[3] for r, mass in facts[0].items()) and sum(facts[0].values()) == 300
    assert {r[0] for r in made[0]} == {n or "" for _, n, _ in rows}


def test_stored_panes_are_read_back():
    own = {"": (1, -5, 7, 0, b""), "é": (3, 0, 2**62, 4, b"\x00\xff" * 9)}
    assert panes._unpack(panes._pack(own)) == own and panes._unpack(panes._pack({})) == {}


def test_keys_of_few_rows_are_columns_and_are_read_back():
    """Only keys with a whole batch have a pane of their own; what is stored gives the same rows, times and points, and goes on from there."""
    rng = np.random.default_rng(0)
    names = pd.Series(["é", "", "hot", *(f"k{j}" for j in range(50))])
    keys, at, points, weights = names[rng.integers(0, 53, 120)].where(rng.random(120) < 0.8, "hot").reset_index(drop=True), rng.integers(-5, 2**50, 120), rng.normal(size=(120, 2)), np.ones(120)
    whole, parts = (panes._Keys(6, 3, 1, {}) for _ in range(2))
    for a, b in ((0, 40), (40, 41), (41, 120)):
        whole.add(keys[a:b], at[a:b], points[a:b], weights[a:b])
        parts = panes._Keys(6, 3, 1, {}, parts.stored() if a else b"")
        parts.add(keys[a:b], at[a:b], points[a:b], weights[a:b])
    n = keys.value_counts()
    assert {list(whole.index)[i] for i in whole.large} == set(n[n >= 12].index) == {"hot"}
    for own in (whole, panes._Keys(6, 3, 1, {}, parts.stored())):
        own.changed[:] = True
        ids, p, w = own.answer()
        seen = {name: (*own.facts[:, i].tolist(), sorted(map(tuple, np.column_stack([p, w])[ids == i].tolist()))) for name, i in own.index.items()}
        assert {name: s[:3] for name, s in seen.items()} == {k: (int((keys == k).sum()), int(at[keys == k].min()), int(at[keys == k].max())) for k in set(keys)}
        assert all(s[3] == sorted(map(tuple, np.column_stack([points, weights])[keys == k].tolist())) for k, s in seen.items() if k != "hot")
        before = seen if own is whole else before
        assert seen == before and abs(sum(x[2] for x in seen["hot"][3]) - n["hot"]) < 1e-9
