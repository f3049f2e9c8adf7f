"""Many trees at once against one by one, and what shards of streams hold."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riverstone.operators import kernel
from riverstone.operators.coreset import Buckets
from riverstone.streaming import coreset_stream as cs


@pytest.mark.parametrize("options", [{}, {"metric": "cosine"}, {"cost_mode": "unweighted"}, {"weight_mode": "leaf_count"}, {"tries": 1}, {"mode": "sequential"}, {"pick": "farthest"}])
def test_many_trees_are_those_of_one_at_a_time(options):
    rng = np.random.default_rng(5)
    parts = []
    for n, d in [(100, 2), (400, 2), (21, 2), (20, 2), (3, 2), (300, 2)]:
        parts.append((np.round(rng.normal(size=(n, d)), 1), rng.integers(0, 4, n).astype(float)))
    parts.append((np.ones((90, 2)), np.ones(90)))
    parts.append((np.repeat(rng.normal(size=(7, 2)), 20, axis=0), np.ones(140)))
    for wide in (False, True):
        own = [(np.hstack([p] * 5) if wide else p, w) for p, w in parts]
        got = kernel.coresets([(*p, kernel.generator(1, k)) for k, p in enumerate(own)], 20, **options)
        for k, ((points, weights), (at, mass)) in enumerate(zip(own, got, strict=True)):
            want = kernel.coreset(points, weights, 20, kernel.generator(1, k), **options)
            assert np.array_equal(at, want[0]) and np.array_equal(mass, want[1])


def test_batches_added_together_make_the_counter_of_one_by_one():
    rng = np.random.default_rng(1)
    points, weights = rng.normal(size=(23 * 40, 3)), rng.integers(1, 5, 23 * 40).astype(float)
    a, b = Buckets(20, 3, 1), Buckets(20, 3, 1)
    for at in range(0, len(points), 40):
        a.add(points[at : at + 40], weights[at : at + 40])
    for i, j in ((0, 3), (3, 4), (4, 23)):
        b.add_all(points[i * 40 : j * 40], weights[i * 40 : j * 40], 40)
    assert (a.n_reduced, a.by_rank) == (b.n_reduced, b.by_rank) and sorted(a.slots) == sorted(b.slots) == [0, 1, 2, 4]
    assert all(np.array_equal(x, y) for r in a.slots for x, y in zip(a.slots[r], b.slots[r], strict=True))


def test_a_shard_holds_a_bounded_part_of_a_micro_batch(monkeypatch):
    """Blocks bring every point with its weight; they are put in order some bytes at a time, and all at once where they fit."""
    n = 5000
    place = np.random.default_rng(2).permutation(n)
    table = pa.table({"shard": pa.array(place % 3), "place": pa.array(place), "weight": pa.array(place + 1.0), "features": pa.array([[float(k), -1.0] for k in place], pa.list_(pa.float64()))})
    made = pa.Table.from_batches(list(cs._blocks(iter(table.to_batches(max_chunksize=1700))))).to_pandas()
    assert len(made) < n / 50
    for limit, runs in ((1 << 25, 1), (1 << 14, 4)):
        monkeypatch.setattr(cs, "HELD_BYTES", limit)
        got = list(cs.CounterState(10, 3, {})._ordered(iter([own for _, own in made[made["shard"] == 2].groupby(np.arange((made["shard"] == 2).sum()) // 2)])))
        assert len(got) == 1 if runs == 1 else len(got) >= runs
        assert all(p.nbytes <= limit + cs.BLOCK_BYTES and (np.diff(p[:, 0]) > 0).all() and np.array_equal(p[:, 0] + 1, w) for p, w in got)
        assert sorted(np.concatenate([p[:, 0] for p, _ in got])) == [k for k in range(n) if k % 3 == 2]


class Kept:
    """A shard's states, in memory."""

    def __init__(self):
        self.value, self.values = None, {}

    def getValueState(self, *_):  # noqa: N802
        return Kept()

    getMapState = getValueState  # noqa: N815

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def iterator(self):
        return iter(self.values.items())

    def updateValue(self, key, value):  # noqa: N802
        self.values[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.values[key]


def frames(begin: int, end: int, points: int = 128):
    """Frames of ten blocks each, made as they are asked for."""
    for at in range(begin, end, 10 * points):
        places = [np.arange(k, min(k + points, end)) for k in range(at, min(at + 10 * points, end), points)]
        yield pd.DataFrame({"places": places, "dims": 2, "points": [np.column_stack([np.sin(x), np.cos(7 * x)]).tobytes() for x in places], "weights": [np.ones(len(x)).tobytes() for x in places]})


def test_pieces_of_a_micro_batch_make_the_counter_of_the_whole(monkeypatch):
    answers = []
    for counted in (1 << 12, 1 << 25):
        monkeypatch.setattr(cs, "COUNTED_BYTES", counted)
        shard, found = cs.CounterState(10, 3, {}), []
        assert max(len(p) for p, _ in shard._ordered(frames(0, 5000))) == (170 if counted == 1 << 12 else 5000)
        shard.init(Kept())
        for begin, end in ((0, 1111), (1111, 1115), (1115, 5000)):
            found += list(shard.handleInputRows((1,), frames(begin, end), None))
        answers.append(pd.concat(found))
    a, b = answers
    assert len(a) == len(b) > 100 and a["weight"].equals(b["weight"]) and a["rank"].equals(b["rank"])
    assert np.array_equal(np.stack(a["features"]), np.stack(b["features"]))
    assert a["reduced"].dropna().to_list() == b["reduced"].dropna().to_list()


def test_a_shard_holds_points_once_while_it_counts_them(monkeypatch):
    """Neither frames nor blocks are kept beside the points, however many rows there are."""
    monkeypatch.setattr(cs, "HELD_BYTES", 1 << 23)
    monkeypatch.setattr(cs, "COUNTED_BYTES", 1 << 16)
    tracemalloc.start()
    try:
        held = [tracemalloc.get_traced_memory()[0] for _ in cs.CounterState(10, 3, {})._ordered(frames(0, 600_000))]
    finally:
        tracemalloc.stop()
    assert len(held) >= 3 and max(held) < 1.25 * (1 << 23)


def test_blocks_come_in_small_batches_unless_the_session_says_otherwise(spark):
    for own in (None, "1000000"):
        session = spark.newSession()
        if own:
            session.conf.set(cs.BATCH_SETTING, own)
        rows = session.readStream.format("rate").load().select(F.col("value").alias("id"), F.array(F.col("value").cast("double")).alias("features"))
        cs.stream_coresets(rows, 5)
        assert session.conf.get(cs.BATCH_SETTING) == (own or str(cs.BATCH_BYTES))
