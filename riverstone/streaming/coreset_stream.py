"""Coresets of streams.

A shard's state holds fewer than 2m waiting points and a binary counter of coresets, O(m log n) numbers, each rank of it a value of its own;
whole batches of 2m points are counted in as they fill, whatever the micro-batches are. Tasks pack the points that they read into blocks for
the shards, which take them in block by block. After each trigger a shard gives its counter's
coresets and the points that wait, which together stand for all it has seen. Shards run in parallel; combined() makes one coreset of their
latest answers, and of what stored_answers() reads from a checkpoint. Windows of streams are in panes.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riverstone.functions.vectors import doubles
from riverstone.operators.coreset import SCHEMA, Buckets, coreset, matrix_of, merge_kernel
from riverstone.session import SETTINGS, spread

#: Consecutive rows of a task, of which a window's are reduced together.
PART_ROWS = 200_000
#: Bytes of a row in which tasks pack the points of a shard, and of the points of a micro-batch that a shard puts in order at a time.
BLOCK_BYTES, HELD_BYTES = 1 << 12, 1 << 25
#: Bytes of an Arrow batch of blocks, for sessions without a setting of their own, and of the points that are counted in together.
BATCH_BYTES, COUNTED_BYTES = 1 << 22, 1 << 22
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
OUTPUT = "shard long, version long, rank int, weight double, features array<double>, reduced array<long>"
META = "version long, n_reduced long"
SLOT = "dims int, points binary, weights binary"
WAITING = -1
STORE = [k for k in SETTINGS if ".stateStore." in k]


def packed(buckets: Buckets, points: np.ndarray, weights: np.ndarray) -> bytes:
    """A counter's coresets and the points that wait, as bytes: how many parts, rank, rows and dimensions of each, and their values."""
    parts = [(WAITING, points, weights), *((rank, *slot) for rank, slot in buckets.slots.items())]
    head = np.array([len(parts), *(x for rank, p, _ in parts for x in (rank, *(p.shape if len(p) else (0, 0))))], "<i8")
    return b"".join([head.tobytes(), *(x.astype("<f8", copy=False).tobytes() for _, p, w in parts for x in (p, w))])


def unpacked(raw: bytes, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Fills the counter, and gives the points that wait and their weights."""
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, waiting = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3).tolist(), 8 * (1 + 3 * n), (np.zeros((0, 0)), np.zeros(0))
    for rank, rows, dims in head:
        points = np.frombuffer(raw, "<f8", rows * dims, at).reshape(rows, dims)
        weights = np.frombuffer(raw, "<f8", rows, at + points.nbytes)
        at += points.nbytes + weights.nbytes
        if rank == WAITING:
            waiting = (points, weights)
        else:
            buckets.slots[rank] = (points, weights)
    return waiting


class CounterState(StatefulProcessor):
    """A shard's counter, each rank's coreset a value of its own: a trigger writes the ranks that it changed, and no others."""

    def __init__(self, m: int, seed: int, options: dict):
        self.m, self.seed, self.options = m, seed, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", META)
        self.waiting = handle.getValueState("waiting", SLOT)
        self.ranks = handle.getMapState("ranks", "rank int", SLOT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        shard = int(key[0])
        buckets = Buckets(self.m, self.seed, shard, **self.options)
        version, old, points, weights = 0, {}, np.zeros((0, 0)), np.zeros(0)
        if self.meta.exists():
            version, buckets.n_reduced = self.meta.get()
            points, weights = _slot(self.waiting.get())
            old = {int(k[0]): _slot(v) for k, v in self.ranks.iterator()}
            buckets.slots = dict(old)
        for fresh, mass in self._ordered(rows):
            points, weights = (fresh, mass) if not len(points) else (np.concatenate([points, fresh]), np.concatenate([weights, mass]))
            whole = len(points) - len(points) % (2 * self.m)
            buckets.add_all(points[:whole], weights[:whole], 2 * self.m)
            points, weights = points[whole:].copy(), weights[whole:].copy()
        for rank in old.keys() - buckets.slots.keys():
            self.ranks.removeKey((rank,))
        for rank, slot in buckets.slots.items():
            if old.get(rank) is not slot:
                self.ranks.updateValue((rank,), _raw(*slot))
        self.waiting.update(_raw(points, weights))
        self.meta.update((version + 1, buckets.n_reduced))
        # Once in an answer: how many coresets of each rank this trigger has made.
        reduced = [[buckets.by_rank.get(r, 0) for r in range(max(buckets.by_rank, default=-1) + 1)]]
        for rank, p, w in [(WAITING, points, weights), *((rank, *slot) for rank, slot in sorted(buckets.slots.items()))]:
            if len(p):
                yield pd.DataFrame({"shard": shard, "version": version + 1, "rank": rank, "weight": w, "features": list(p), "reduced": reduced + [None] * (len(p) - 1)})
                reduced = [None]

    def _ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points and weights in order of their positions, HELD_BYTES of blocks at a time; given in pieces of COUNTED_BYTES."""
        held, size = [], 0
        for frame in frames:
            blocks = []
            for place, *raw in zip(frame["places"], frame["dims"], frame["points"], frame["weights"], strict=True):
                p, w = _slot(raw)
                blocks.append((place, p, w))
                size += p.nbytes + 2 * w.nbytes
                if size >= HELD_BYTES:
                    held.append(_column(blocks))
                    yield from self._pieces(held)
                    blocks, size = [], 0
            if blocks:  # a frame's bytes go with it
                held.append(_column(blocks))
        if held:
            yield from self._pieces(held)

    def _pieces(self, held: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is held, in order; nothing is held any more."""
        places, points, weights = _column(held)
        held.clear()
        order = pd.Series(places).sort_values(kind="stable").index.to_numpy()
        del places
        step = max(2 * self.m, COUNTED_BYTES // (8 * (points.shape[1] + 1)))
        for at in range(0, len(order), step):
            own = order[at : at + step]
            yield points[own], weights[own]

    def close(self) -> None:
        pass


def _column(blocks: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*blocks, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shard, place, weight, features as rows of a shard and some of its points ."""
    for b in batches:
        if not b.num_rows:
            continue
        shard, points, weights = b.column(0).to_numpy(), matrix_of(b.column(3)), b.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(shard, kind="stable")
        shard, points, weights = shard[order], points[order], weights[order]
        step, new = max(1, BLOCK_BYTES // (8 * (points.shape[1] + 2))), np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        begin = np.concatenate([np.arange(i, j, step) for i, j in zip(new, [*new[1:], len(shard)], strict=True)])
        edges = [*begin.tolist(), len(shard)]
        places = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), b.column(1).take(pa.array(order)))
        raw = [_raw(points[i:j], weights[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.record_batch([pa.array(shard[begin]), places, *(pa.array([r[k] for r in raw], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary())))], ["shard", "places", "dims", "points", "weights"])


def _raw(points: np.ndarray, weights: np.ndarray) -> tuple[int, bytes, bytes]:
    return (points.shape[1] if points.ndim == 2 else 0, points.astype("<f8").tobytes(), weights.astype("<f8").tobytes())


def _slot(raw: tuple) -> tuple[np.ndarray, np.ndarray]:
    dims, points, weights = raw
    weights = np.frombuffer(bytes(weights), "<f8")
    return np.frombuffer(bytes(points), "<f8").reshape(len(weights), int(dims)), weights


def stream_coresets(points: DataFrame, m: int, shards: int = 1, features: str = "features", weight: str | None = None, position: str = "id", seed: int = 3, **options) -> DataFrame:  # noqa: ANN003
    """A streaming DataFrame (update mode) of shard, version, rank (-1: waiting points), weight, features. Sets the session's state store to RocksDB.

    Rows are dealt to shards by a hash of their position. Within a micro-batch a shard takes them in order of it, HELD_BYTES of them at a time
    (a million points of two dimensions), so that its memory doesn't grow with the micro-batch: beyond that, draws follow the order in which
    tasks bring the rows. One shard keeps the order of the micro-batches; more of them spread the work.
    """
    for setting in STORE:  # the one store that keeps several states for a key, and writes what a trigger has changed
        points.sparkSession.conf.set(setting, SETTINGS[setting])
    if points.sparkSession.conf.get(BATCH_SETTING, None) is None:
        points.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = points.select(F.pmod(F.xxhash64(position), F.lit(shards)).alias("shard"), F.col(position).alias("place"), w.alias("weight"), doubles(features).alias("features"))
    blocks = rows.mapInArrow(_blocks, f"shard long, places array<{rows.schema['place'].dataType.simpleString()}>, {SLOT}")
    return blocks.groupBy("shard").transformWithStateInPandas(CounterState(m, seed, options), OUTPUT, "update", "none")


def stored_answers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """shard, rank, weight, features: what a stream's state holds at its last commit, read from the checkpoint; nothing has to be emitted."""
    state = spark.read.format("statestore").option("path", checkpoint)
    ranks = state.option("stateVarName", "ranks").load().select(F.col("key.shard").alias("shard"), F.col("user_map_key.rank").alias("rank"), "user_map_value.*")
    state = spark.read.format("statestore").option("path", checkpoint)
    waiting = state.option("stateVarName", "waiting").load().select(F.col("key.shard").alias("shard"), F.lit(WAITING).alias("rank"), "value.*")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, rank, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                points, weights = _slot(raw)
                n, d = points.shape
                if n:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(points.reshape(-1)))
                    yield pa.record_batch([pa.array(np.full(n, shard)), pa.array(np.full(n, rank, np.int32)), pa.array(weights), lists], ["shard", "rank", "weight", "features"])

    return ranks.unionByName(waiting).select("shard", "rank", "dims", "points", "weights").mapInArrow(rows, "shard long, rank int, weight double, features array<double>")


def latest(answers: DataFrame) -> DataFrame:
    """Of what a sink has gathered, each shard's last version."""
    last = answers.groupBy("shard").agg(F.max("version").alias("version"))
    return answers.join(last, ["shard", "version"])


def combined(answers: DataFrame, m: int, **options) -> DataFrame:  # noqa: ANN003
    """weight, features: one coreset of all shards' latest answers."""
    return coreset(latest(answers), m, weight="weight", **options)


def windowed_coresets(points: DataFrame, time: str, width: str, m: int, features: str = "features", seed: int = 3, **options) -> DataFrame:  # noqa: ANN003
    """window_start, weight, features: a coreset of each event-time window of a table (of a stream: panes.py).

    A window's rows are reduced in parts, as they were dealt, and the parts' coresets together, so no task gets a whole window.
    """
    start = F.unix_micros(F.window(F.col(time).cast("timestamp"), width)["start"])
    own = spread(points).select(start.alias("node"), F.spark_partition_id().alias("part"), F.lit(1.0).alias("weight"), doubles(features).alias("features"))
    own = own.withColumn("part", F.struct("part", F.floor(F.monotonically_increasing_id() % F.lit(1 << 33) / F.lit(PART_ROWS)).alias("piece")))
    first = own.groupBy("node", "part").applyInArrow(merge_kernel(m, seed, 0, options, sort=True), SCHEMA)
    made = first.groupBy("node").applyInArrow(merge_kernel(m, seed, 1, options, sort=True), SCHEMA)
    return made.select(F.timestamp_micros("node").alias("window_start"), "weight", "features")
