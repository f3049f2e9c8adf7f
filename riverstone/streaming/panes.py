"""Windows of streams by panes: each row is reduced once, in its pane, and windows are merges of their panes' coresets.

A pane is a stretch of event time of one key. A stream keeps a binary counter for each pane and shard, and answers after each trigger with
what the panes that changed have come to. From the latest answers, tumbling and sliding windows take the panes that they cover, and sessions
the panes between two gaps: a late row that fills a gap changes its pane's first or last time, and the sessions on both sides are one.

Rows of a key go to `shards` states by a hash of their position, so no task gets all rows of a hot key or window; keys with few rows may
share states. Rows older than the
watermark are left out, and a pane's state goes once the watermark has passed its end: state is bounded by the panes within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riverstone.functions.vectors import doubles
from riverstone.operators import kernel
from riverstone.operators.coreset import Buckets, merge_kernel
from riverstone.session import stored
from riverstone.streaming.coreset_stream import packed, unpacked

OUTPUT = "key string, pane long, shard long, version long, n_rows long, first long, last long, weight double, features array<double>"
STATE = "version long, panes binary"
#: Panes whose coresets are merged in one task, and points of groups that are merged many at a time.
FAN_IN, SMALL = 8, 64


def micros(df: DataFrame, interval: str) -> int:
    """An interval such as `1 hour` in microseconds."""
    found = df.sparkSession.sql(f"SELECT CAST(INTERVAL '0' SECOND + INTERVAL {interval} AS INTERVAL DAY TO SECOND) AS w").first().w
    return found.days * 86_400_000_000 + found.seconds * 1_000_000 + found.microseconds


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    some = [p for p in parts if len(p[0])]
    return (np.concatenate([p for p, _ in some]), np.concatenate([w for _, w in some])) if some else (np.zeros((0, 0)), np.zeros(0))


class _Pane:
    """What a pane of a key with many rows has come to: a counter, and the points that wait for a whole batch."""

    def __init__(self, m: int, seed: int, shard: int, options: dict, n_reduced: int = 0, raw: bytes = b""):
        self.m = m
        self.buckets = Buckets(m, seed, shard, **options)
        self.buckets.n_reduced = n_reduced
        self.waiting = [unpacked(raw, self.buckets)] if raw else []

    def add(self, points: np.ndarray, weights: np.ndarray) -> None:
        points, weights = _joined([*self.waiting, (points, weights)])
        whole = len(points) - len(points) % (2 * self.m)
        self.buckets.add_all(points[:whole], weights[:whole], 2 * self.m)
        self.waiting = [(points[whole:], weights[whole:])]

    def answer(self) -> tuple[np.ndarray, np.ndarray]:
        return _joined([*self.waiting, *(slot for _, slot in sorted(self.buckets.slots.items()))])


class _Keys:
    """The keys of a state: rows, first and last time of each. Those that have had a whole batch of rows have a _Pane each; the points of
    all others are columns together, so that keys of few rows cost no Python of their own."""

    def __init__(self, m: int, seed: int, shard: int, options: dict, raw: bytes = b""):
        self.own, self.batch = (m, seed, shard, options), 2 * m
        self.index: dict[str, int] = {}
        self.large: dict[int, _Pane] = {}
        self.facts = np.zeros((3, 0), np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if raw:
            self._read(raw)
        self.changed = np.zeros(len(self.index), bool)

    def add(self, keys: pd.Series, at: np.ndarray, points: np.ndarray, weights: np.ndarray) -> None:
        codes, names = pd.factorize(keys)
        code = np.fromiter((self.index.setdefault(name, len(self.index)) for name in names), np.int64, len(names))
        more = len(self.index) - len(self.changed)
        if more:
            limits = np.iinfo(np.int64)
            self.facts = np.hstack([self.facts, np.repeat([[0], [limits.max], [limits.min]], more, axis=1)])
            self.changed = np.append(self.changed, np.zeros(more, bool))
        ids = code[codes]
        order = np.argsort(ids, kind="stable")
        ids, at = ids[order], at[order]
        begin = np.flatnonzero(np.diff(ids, prepend=-1))
        own = ids[begin]
        n, first, last = self.facts
        n[own] += np.diff(begin, append=len(ids))
        first[own] = np.minimum(first[own], np.minimum.reduceat(at, begin))
        last[own] = np.maximum(last[own], np.maximum.reduceat(at, begin))
        self.changed[own] = True
        self.rows.append((ids, points[order], weights[order]))
        if (n[own] >= self.batch).any():
            self._count()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The columns, key by key, in the order in which they came."""
        some = [r for r in self.rows if len(r[0])]
        if not some:
            return np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0)
        ids, points, weights = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(ids, kind="stable")
        return ids[order], points[order], weights[order]

    def _count(self) -> None:
        ids, points, weights = self._sorted()
        many = self.facts[0][ids] >= self.batch
        begin = np.flatnonzero(np.diff(ids[many], prepend=-1))
        for i, p, w in zip(ids[many][begin].tolist(), np.split(points[many], begin[1:]), np.split(weights[many], begin[1:]), strict=True):
            if i not in self.large:
                self.large[i] = _Pane(*self.own)
            self.large[i].add(p, w)
        self.rows = [(ids[~many], points[~many], weights[~many])]

    def stored(self) -> bytes:
        """Lengths, keys with a counter, then of the others the names, their lengths, rows and times, and the points."""
        ids, points, weights = self._sorted()
        names, few = list(self.index), np.ones(len(self.index), bool)
        few[list(self.large)] = False
        large = _pack({names[i]: (*self.facts[:, i].tolist(), pane.buckets.n_reduced, packed(pane.buckets, *_joined(pane.waiting))) for i, pane in self.large.items()})
        rest = [names[i] for i in np.flatnonzero(few).tolist()]
        text = "".join(rest).encode()
        head = np.array([len(large), len(text), len(rest), *points.shape], "<i8")
        facts = np.vstack([np.array([len(name) for name in rest], np.int64), self.facts[:, few]]).astype("<i8")
        return b"".join([head.tobytes(), large, text, facts.tobytes(), points.astype("<f8", copy=False).tobytes(), weights.astype("<f8", copy=False).tobytes()])

    def _read(self, raw: bytes) -> None:
        n_large, n_text, n_few, rows, dims = np.frombuffer(raw, "<i8", 5).tolist()
        at = 40 + n_large + n_text
        text, (lengths, *facts) = raw[40 + n_large : at].decode(), np.frombuffer(raw, "<i8", 4 * n_few, at).reshape(4, n_few)
        at += 32 * n_few
        ends = np.cumsum(lengths).tolist()
        names = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        points = np.frombuffer(raw, "<f8", rows * dims, at).reshape(rows, dims)
        self.rows = [(np.repeat(np.arange(n_few), facts[0]), points, np.frombuffer(raw, "<f8", rows, at + points.nbytes))]
        large = _unpack(raw[40 : 40 + n_large])
        self.large = {n_few + i: _Pane(*self.own, *own[3:]) for i, own in enumerate(large.values())}
        self.index = {name: i for i, name in enumerate([*names, *large])}
        self.facts = np.hstack([np.array(facts, np.int64), np.array([own[:3] for own in large.values()], np.int64).reshape(-1, 3).T])

    def answer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, point and weight of what each key that changed has come to."""
        ids, points, weights = self._sorted()
        new = self.changed[ids]
        made = [(ids[new], points[new], weights[new])]
        made += [(np.full(len(w), i), p, w) for i, pane in self.large.items() if self.changed[i] for p, w in [pane.answer()]]
        return tuple(np.concatenate(x) for x in zip(*(m for m in made if len(m[0])), strict=True))


def _pack(panes: dict[str, tuple[int, int, int, int, bytes]]) -> bytes:
    """Keys and what is stored of each: how many, lengths and numbers, then names, then counters."""
    names = [name.encode() for name in panes]
    head = np.array([len(panes), *(x for name, (*facts, raw) in zip(names, panes.values(), strict=True) for x in (len(name), len(raw), *facts))], "<i8")
    return b"".join([head.tobytes(), *names, *(v[-1] for v in panes.values())])


def _unpack(raw: bytes) -> dict[str, tuple[int, int, int, int, bytes]]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 6 * n, 8).reshape(n, 6).tolist()
    at = 8 * (1 + 6 * n)
    body = at + sum(h[0] for h in head)
    panes = {}
    for size, length, *facts in head:
        panes[raw[at : at + size].decode()] = (*facts, raw[body : body + length])
        at, body = at + size, body + length
    return panes


def _update(m: int, seed: int, width: int, options: dict):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pane, shard = int(key[1]), int(key[2])
        version, raw = state.get if state.exists else (0, b"")
        keys = _Keys(m, seed, shard, options, bytes(raw))
        for frame in frames:  # one by one: a task holds a batch and what the keys of one state have come to
            if len(frame):
                keys.add(frame["key"], frame["at"].to_numpy(), np.stack(frame["features"].to_list()).astype(float), frame["weight"].to_numpy(float))
        if not keys.changed.any():
            return
        state.update((version + 1, keys.stored()))
        state.setTimeoutTimestamp((pane + width) // 1000)
        ids, points, weights = keys.answer()
        n_rows, first, last = keys.facts[:, ids]
        yield pd.DataFrame({"key": np.array(list(keys.index), object)[ids], "pane": pane, "shard": shard, "version": version + 1, "n_rows": n_rows, "first": first, "last": last, "weight": weights, "features": list(points)})

    return run


def stream_panes(points: DataFrame, time: str, pane: str, delay: str, m: int, by: Column | None = None, shards: int = 4, features: str = "features", weight: str | None = None, position: str = "id", seed: int = 3, key_buckets: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """A streaming DataFrame (update mode): OUTPUT, of each pane that changed its key, start, shard and points, the number of rows that it has
    taken in, and their first and last times (microseconds).

    A key has states of its own, unless `key_buckets` deals keys by their hash to so many: then keys of a bucket share the state of a pane
    and shard, which is written as a whole. That is cheaper where a pane has few rows of a key; the number of keys in a bucket times the
    points of a counter has to fit a task. Points of keys with fewer than 2m rows in a pane are handled together. Rows, times and mass are the same; draws follow the order in which rows come.
    """
    timed = points.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    name = F.lit("") if by is None else F.coalesce(by.cast("string"), F.lit(""))
    bucket = F.xxhash64(name) if key_buckets is None else F.pmod(F.xxhash64(name), F.lit(key_buckets))
    shard = F.pmod(F.xxhash64(position), F.lit(shards)).cast("long")
    rows = timed.select(bucket.cast("long").alias("bucket"), name.alias("key"), F.unix_micros(F.window("_time", pane)["start"]).alias("pane"), shard.alias("shard"), "_time", F.unix_micros("_time").alias("at"), doubles(features).alias("features"), w.alias("weight"))
    return rows.groupBy("bucket", "pane", "shard").applyInPandasWithState(_update(m, seed, micros(points, pane), options), OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(answers: DataFrame) -> DataFrame:
    """Of what a sink has gathered, the last version of each pane and shard."""
    own = ["key", "pane", "shard"]
    return answers.join(answers.groupBy(*own).agg(F.max("version").alias("version")), [*own, "version"])


def merged_panes(answers: DataFrame, m: int, seed: int = 3, **options) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """key, pane, weight, features: one coreset of each pane; and key, pane, n_rows, first, last. Both are stored."""
    last = stored(latest(answers), "panes")
    facts = last.groupBy("key", "pane", "shard").agg(*[F.first(k).alias(k) for k in ("n_rows", "first", "last")]).groupBy("key", "pane").agg(F.sum("n_rows").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"))
    return stored(merged(last, ["key", "pane"], m, seed, 0, **options), "pane-coresets"), stored(facts, "pane-facts")


def merged(rows: DataFrame, by: list[str], m: int, seed: int, level: int, **options) -> DataFrame:  # noqa: ANN003
    """The columns `by`, weight, features: the points of each group as one coreset. Groups of at most m points are one as they are."""
    kinds = dict(rows.dtypes)
    plain = merge_kernel(m, seed, level, options, sort=True)

    def run(key, table):  # noqa: ANN001, ANN202
        """Draws depend on the group's last key, so groups of one key differ."""
        made = plain((pa.scalar(key[-1].as_py() or 0),), table).drop(["node"])
        for k, value in reversed(list(zip(by, key, strict=True))):
            made = made.add_column(0, k, pa.array([value.as_py()] * made.num_rows, value.type))
        return made

    counted = rows.join(rows.groupBy(*by).agg(F.count("*").alias("_points")), by).select(*by, "weight", "features", "_points")
    few = counted.filter((F.col("_points") <= m) & (F.col("weight") > 0)).drop("_points")
    large = counted.filter(F.col("_points") > m)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", weight double, features array<double>"
    # Small groups are a row each, and those of an Arrow batch are reduced together; others are groups of their own.
    small = large.filter(F.col("_points") <= SMALL).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("features", "weight"))).alias("own"))
    named = small.select(*by, F.col("own.weight").alias("weights"), F.flatten("own.features").alias("values")).mapInArrow(_reduced(m, seed, level, len(by), options), schema)
    return few.unionByName(named).unionByName(large.filter(F.col("_points") > SMALL).drop("_points").groupBy(*by).applyInArrow(run, schema))


def _reduced(m: int, seed: int, level: int, n_by: int, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group's columns, weights and values in order, as its coreset: that of merge_kernel()."""
        for b in batches:
            if not b.num_rows:
                continue
            last, parts = b.column(n_by - 1).to_pylist(), []
            for node, w, x in zip(last, b.column(n_by), b.column(n_by + 1), strict=True):
                weights, values = w.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False)
                points = values.reshape(len(weights), -1)
                order = np.lexsort((weights, *points.T))
                parts.append((points[order], weights[order], kernel.generator(seed, level, node or 0)))
            made = kernel.coresets(parts, m, **options)
            n = np.array([len(at) for at, _ in made])
            points = np.concatenate([p[at] for (p, _, _), (at, _) in zip(parts, made, strict=True)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1]), pa.array(points.reshape(-1)))
            groups = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch([*(b.column(k).take(groups) for k in range(n_by)), pa.array(np.concatenate([mass for _, mass in made])), lists], [*b.schema.names[:n_by], "weight", "features"])

    return run


def sliding_windows(answers: DataFrame, width: str, slide: str, pane: str, m: int, seed: int = 3, **options) -> DataFrame:  # noqa: ANN003
    """key, window_start, n_rows, weight, features: of each window of `width` that begins at a multiple of `slide`; both are multiples of the pane."""
    wide, step, own = (micros(answers, x) for x in (width, slide, pane))
    if wide % own or step % own:
        raise ValueError("width and slide have to be multiples of the pane")
    coresets, facts = merged_panes(answers, m, seed, **options)
    last = F.col("pane") - F.pmod(F.col("pane"), F.lit(step))
    first = last - F.floor((F.lit(wide - 1) - (F.col("pane") - last)) / F.lit(step)).cast("long") * F.lit(step)
    placed = lambda df: df.filter(first <= last).withColumn("start", F.explode(F.sequence(first, last, F.lit(step))))
    counts = placed(facts).groupBy("key", "start").agg(F.sum("n_rows").alias("n_rows"))
    made = merged(placed(coresets), ["key", "start"], m, seed, 1, **options)
    return made.join(counts, ["key", "start"]).select("key", F.timestamp_micros("start").alias("window_start"), "n_rows", "weight", "features")


def session_windows(answers: DataFrame, gap: str, pane: str, m: int, seed: int = 3, **options) -> DataFrame:  # noqa: ANN003
    """key, session_start, session_end, n_rows, weight, features: sessions end where a key has no row for `gap`; the end is the last row's time
    and the gap. A pane is no longer than the gap, so all its rows are in one session."""
    apart = micros(answers, gap)
    if micros(answers, pane) > apart:
        raise ValueError("a pane can't be longer than the gap")
    coresets, facts = merged_panes(answers, m, seed, **options)
    order = Window.partitionBy("key").orderBy("pane")
    begins = F.coalesce((F.col("first") - F.lag("last").over(order) >= apart).cast("long"), F.lit(1))
    numbered = facts.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order)).withColumn("place", F.row_number().over(Window.partitionBy("key", "session").orderBy("pane")) - 1)
    numbered = stored(numbered, "sessions")
    spans = numbered.groupBy("key", "session").agg(F.min("first").alias("start"), (F.max("last") + apart).alias("end"), F.sum("n_rows").alias("n_rows"))
    rows = coresets.join(numbered.select("key", "pane", "session", F.col("place").cast("long").alias("node")), ["key", "pane"])
    most, level = numbered.agg(F.max("place")).first()[0] or 0, 1
    while most:  # a long session's panes are merged a few at a time
        # A merge reads its rows twice (for the points of each group), so what comes from a level is stored, not made again by those above.
        placed = stored(rows.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")), "session-level")
        rows = merged(placed, ["key", "session", "node"], m, seed, level, **options)
        most, level = most // FAN_IN, level + 1
    named = rows.join(spans, ["key", "session"])
    return named.select("key", F.timestamp_micros("start").alias("session_start"), F.timestamp_micros("end").alias("session_end"), "n_rows", "weight", "features")
