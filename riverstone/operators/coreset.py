"""Coresets of DataFrames, as a partial, merge and final aggregate.

`fast`: each task reduces its own rows batch by batch (16m rows, 16,384 at least) with a binary counter of coresets (a batch and log2
coresets in memory) and gives one coreset; these are reduced together, about `fan_in` at a time, in as many levels as the number of tasks
asks for, until one is left. Depends on how rows are dealt; small shuffles of coresets only.

`levels`: batches are ranges of an order, coresets of rank r stand for 2**r whole batches and are made two by two, what is left over is
reduced once at the end. The result is the same however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.functions.vectors import doubles
from riverstone.operators import kernel
from riverstone.operators.batching import batch_of, with_ordinal
from riverstone.session import spread, stored

DEFAULT_M = 10_000
#: Rows of a batch in fast mode: so many coresets, and as many rows at least.
BATCH_CORESETS, BATCH_ROWS = 16, 16_384
SCHEMA = "node long, weight double, features array<double>"


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if column.null_count or (n and len(flat) % n):
        raise ValueError("points are null or differ in length; use checked_points()")
    return flat.astype(np.float64, copy=False).reshape(n, -1) if n else np.zeros((0, 0))


def _table(node: int, weights: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
    n, d = points.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32) if n else np.zeros(1, np.int32)), pa.array(points.reshape(-1)))
    return pa.record_batch([pa.array(np.full(n, node)), pa.array(weights.astype(np.float64)), lists], ["node", "weight", "features"])


class Buckets:
    """A binary counter: at most one coreset of each rank, which stands for 2**rank batches."""

    def __init__(self, m: int, seed: int, shard: int, **options):  # noqa: ANN003
        self.m, self.key, self.options = m, (seed, shard), options
        self.slots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n_reduced = 0
        self.by_rank: dict[int, int] = {}

    def _reduce(self, points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.n_reduced += 1
        at, mass = kernel.coreset(points, weights, self.m, kernel.generator(*self.key, self.n_reduced), **self.options)
        return points[at], mass

    def add(self, points: np.ndarray, weights: np.ndarray) -> None:
        own, rank = self._reduce(points, weights), 0
        while rank in self.slots:
            other = self.slots.pop(rank)
            self.by_rank[rank] = self.by_rank.get(rank, 0) + 1
            own = self._reduce(np.concatenate([other[0], own[0]]), np.concatenate([other[1], own[1]]))
            rank += 1
        self.by_rank[rank] = self.by_rank.get(rank, 0) + 1
        self.slots[rank] = own

    def add_all(self, points: np.ndarray, weights: np.ndarray, size: int) -> None:
        """add() of each `size` rows one after the other, with the same coresets; those of a rank are made together."""
        todo: dict[int, list[tuple[int, list]]] = {}
        slots: dict[int, tuple] = dict(self.slots)  # coresets, or (rank, place in todo) of those that are to be made
        made: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def put(rank: int, sources: list) -> tuple[int, int]:
            self.n_reduced += 1
            todo.setdefault(rank, []).append((self.n_reduced, sources))
            return rank, len(todo[rank]) - 1

        for at in range(0, len(points), size):
            own, rank = put(0, [(points[at : at + size], weights[at : at + size])]), 0
            while rank in slots:
                self.by_rank[rank] = self.by_rank.get(rank, 0) + 1
                own, rank = put(rank + 1, [slots.pop(rank), own]), rank + 1
            self.by_rank[rank] = self.by_rank.get(rank, 0) + 1
            slots[rank] = own
        whole = lambda ref: ref if isinstance(ref[0], np.ndarray) else made[ref]
        for rank in sorted(todo):
            parts = [(*(np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*map(whole, sources), strict=True)), kernel.generator(*self.key, n)) for n, sources in todo[rank]]
            found = kernel.coresets(parts, self.m, **self.options)
            made |= {(rank, i): (p[own], mass) for i, ((p, _, _), (own, mass)) in enumerate(zip(parts, found, strict=True))}
        self.slots = {rank: whole(ref) for rank, ref in slots.items()}

    def final(self) -> tuple[np.ndarray, np.ndarray] | None:
        """One coreset of all; the counter stays as it is."""
        if not self.slots:
            return None
        points, weights = (np.concatenate([s[k] for s in self.slots.values()]) for k in (0, 1))
        return self._reduce(points, weights)


def _partial(m: int, seed: int, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        buckets, held, rows, size = Buckets(m, seed, shard, **options), [], 0, max(BATCH_CORESETS * m, BATCH_ROWS)
        for b in batches:
            points, weights = matrix_of(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(points):
                take = min(size - rows, len(points) - at)
                held.append((points[at : at + take], weights[at : at + take]))
                at, rows = at + take, rows + take
                if rows == size:
                    buckets.add(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held, rows = [], 0
        if rows:
            buckets.add(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        if (out := buckets.final()) is not None:
            yield _table(shard, out[1], out[0])

    return run


def merge_kernel(m: int, seed: int, level: int, options: dict, sort: bool = False):
    def run(key, table):  # noqa: ANN001, ANN202
        """The rows of a node as one coreset."""
        node = key[0].as_py()
        points, weights = matrix_of(table.column("features")), table.column("weight").to_numpy()
        if sort:  # draws depend on places, and rows come in any order
            order = np.lexsort((weights, *points.T))
            points, weights = points[order], weights[order]
        at, mass = kernel.coreset(points, weights, m, kernel.generator(seed, level, node), **options)
        return pa.Table.from_batches([_table(node, mass, points[at])])

    return run


def _inputs(points: DataFrame, features: str, weight: str | None) -> tuple:
    """Features and weight; floats stay floats until they are in numpy, which halves what goes there."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    kind = points.select(features).schema[0].dataType.elementType.typeName()
    x = F.col(features) if kind in ("float", "double") else doubles(features)
    return x.alias("features"), w.alias("weight")


def _ordered(points: DataFrame, features: str, weight: str | None, order_by: tuple[str, ...]) -> DataFrame:
    keys = [F.col(k).alias(f"_order{i}") for i, k in enumerate(order_by)]
    return with_ordinal(points.select(*keys, *_inputs(points, features, weight)), *(f"_order{i}" for i in range(len(keys))))


def coreset(points: DataFrame, m: int = DEFAULT_M, features: str = "features", weight: str | None = None, mode: str = "fast", order_by: tuple[str, ...] = (), seed: int = 3, final_seed: int = 10, tries: int = 3, fan_in: int = 8, n_tasks: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """weight, features: at most m points whose weights add up to those of all. options go to kernel.coreset()."""
    options = {"tries": tries} | options
    if mode == "levels":
        left = coreset_levels(points, m, features, weight, order_by, seed, **options)
        one = left.select(F.lit(0).cast("long").alias("node"), "weight", "features")
        return one.groupBy("node").applyInArrow(merge_kernel(m, final_seed, 0, options, sort=True), SCHEMA).select("weight", "features")
    rows = points.select(*_inputs(points, features, weight))
    rows = rows.coalesce(n_tasks) if n_tasks else spread(rows)
    part = rows.mapInArrow(_partial(m, seed, options), SCHEMA)
    width, level = 1, 1
    while width * fan_in < rows.rdd.getNumPartitions():
        width *= fan_in
    while width > 1:  # fewer and fewer nodes, each of about fan_in coresets, so that no task gets those of all tasks at once
        part = part.withColumn("node", F.pmod("node", F.lit(width))).groupBy("node").applyInArrow(merge_kernel(m, seed, level, options), SCHEMA)
        width, level = width // fan_in, level + 1
    one = part.withColumn("node", F.lit(0).cast("long"))
    return one.groupBy("node").applyInArrow(merge_kernel(m, final_seed, 0, options), SCHEMA).select("weight", "features")


def coreset_levels(points: DataFrame, m: int, features: str = "features", weight: str | None = None, order_by: tuple[str, ...] = (), seed: int = 3, **options) -> DataFrame:  # noqa: ANN003
    """rank, node, weight, features: the coresets left over when batches of 2m rows in the given order are merged two by two."""
    if not order_by:
        raise ValueError("levels need order_by columns that make a total order")
    n_batches = -(-points.count() // (2 * m))
    batch = batch_of(F.col("ordinal"), 2 * m).alias("node")
    rows = _ordered(points, features, weight, order_by)
    level = rows.select(batch, "weight", "features").groupBy("node").applyInArrow(merge_kernel(m, seed, 0, options, sort=True), SCHEMA)
    left, rank, nodes = None, 0, n_batches
    while nodes:
        if nodes % 2 and nodes > 1:
            level = stored(level, "level")  # read by what is left over and by the pairs
        if nodes % 2:
            own = level.filter(F.col("node") == nodes - 1).select(F.lit(rank).alias("rank"), "node", "weight", "features")
            left = own if left is None else left.unionByName(own)
        pairs = level.filter(F.col("node") < nodes - nodes % 2).withColumn("node", F.floor(F.col("node") / 2).cast("long"))
        nodes, rank = nodes // 2, rank + 1
        level = pairs.groupBy("node").applyInArrow(merge_kernel(m, seed, rank, options, sort=True), SCHEMA)
    return left if left is not None else level.select(F.lit(0).alias("rank"), "node", "weight", "features")


def batch_coresets(points: DataFrame, m: int, features: str = "features", weight: str | None = None, order_by: tuple[str, ...] = (), seed: int = 3, **options) -> DataFrame:  # noqa: ANN003
    """node (the batch), weight, features: a coreset of each batch of 2m rows."""
    rows = _ordered(points, features, weight, order_by)
    return rows.select(batch_of(F.col("ordinal"), 2 * m).alias("node"), "weight", "features").groupBy("node").applyInArrow(merge_kernel(m, seed, 0, options, sort=True), SCHEMA)


def tree_nodes(points: DataFrame, by: str, key: str, m: int, features: str = "features", weight: str | None = None, seed: int = 3) -> DataFrame:
    """The coreset tree of each group as a table of nodes, for groups that fit in a task (batches): the columns `by`, node (0: the root),
    parent, left, right (null: none), centre (a key), mass, cost, size and members (keys, of leaves only; other nodes have those of their
    leaves). A node's mass, cost and size are the sums of its children's."""
    kinds = dict(points.dtypes)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    schema = f"{by} {kinds[by]}, node long, parent long, left long, right long, centre {kinds[key]}, mass double, cost double, size long, members array<{kinds[key]}>"

    def run(group, table):  # noqa: ANN001, ANN202
        """One group's nodes. Rows of no weight are in no node."""
        table = table.filter(pa.array(table.column("weight").to_numpy() > 0)).sort_by("key")
        keys = table.column("key").combine_chunks()
        x, mass = matrix_of(table.column("features")), table.column("weight").to_numpy()
        t = kernel.tree(x, mass, m, kernel.generator(seed)) if len(x) else {k: np.zeros(0, np.int64) for k in ("parent", "left", "right", "centre", "begin", "size", "mass", "cost", "rows")}
        leaf = t["left"] < 0
        members = [keys.take(pa.array(t["rows"][b : b + s])).to_pylist() if end else None for b, s, end in zip(t["begin"].tolist(), t["size"].tolist(), leaf, strict=True)]
        real = lambda k: pa.array(t[k], pa.int64(), mask=t[k] < 0)
        columns = [pa.array([group[0].as_py()] * len(leaf), group[0].type), pa.array(np.arange(len(leaf))), real("parent"), real("left"), real("right"), keys.take(pa.array(t["centre"])), pa.array(t["mass"], pa.float64()), pa.array(t["cost"], pa.float64()), pa.array(t["size"]), pa.array(members, pa.list_(keys.type))]
        return pa.table(columns, [by, "node", "parent", "left", "right", "centre", "mass", "cost", "size", "members"])

    rows = points.select(F.col(by), F.col(key).alias("key"), doubles(features).alias("features"), w.alias("weight"))
    return rows.groupBy(by).applyInArrow(run, schema)


#: Points that a task of a grouped reduction holds, of all groups together, before it gives what it has.
HELD_POINTS = 1_000_000


class Groups:
    """Coresets of the groups of some rows: a binary counter for each group, and fewer than 2m points that wait."""

    def __init__(self, m: int, seed: int, shard: int, held_points: int = HELD_POINTS, **options):  # noqa: ANN003
        self.m, self.seed, self.shard, self.options, self.most = m, seed, shard, options, held_points
        self.counters: dict[object, Buckets] = {}
        self.waiting: dict[object, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, keys: pa.Array, points: np.ndarray, weights: np.ndarray) -> bool:
        """Takes rows in; whether so many points are held now that the groups should be given."""
        code = pa.array(keys).dictionary_encode(null_encoding="encode")
        index = code.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(index, kind="stable")
        for k, own in zip(code.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(index, minlength=len(code.dictionary)))[:-1]), strict=True):
            mine = self.waiting.setdefault(k, [])
            mine.append((points[own], weights[own]))
            self.held += len(own)
            if sum(len(p) for p, _ in mine) >= 2 * self.m:
                self._count(k)
        return self.held > self.most

    def _count(self, k: object) -> None:
        counter = self.counters.setdefault(k, Buckets(self.m, self.seed, self.shard, **self.options))
        before = sum(len(p) for p, _ in counter.slots.values()) + sum(len(p) for p, _ in self.waiting[k])
        counter.add(*(np.concatenate([w[i] for w in self.waiting[k]]) for i in (0, 1)))
        self.waiting[k] = []
        self.held += sum(len(p) for p, _ in counter.slots.values()) - before

    def given(self) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """Each group's key, points and weights: at most m of them. Nothing is held after that."""
        for k in list(self.waiting):
            if self.waiting[k]:
                self._count(k)
            yield k, *self.counters[k].final()
        self.counters, self.waiting, self.held = {}, {}, 0


def _group_table(kind: pa.DataType, node: int, found: list[tuple]) -> pa.RecordBatch:
    """key, node, weight, features of some groups."""
    d = found[0][1].shape[1]
    n = sum(len(w) for _, _, w in found)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.concatenate([p for _, p, _ in found]).reshape(-1)))
    keys = pa.array([k for k, _, _ in found], kind).take(pa.array(np.repeat(np.arange(len(found)), [len(w) for _, _, w in found])))
    return pa.record_batch([keys, pa.array(np.full(n, node)), pa.array(np.concatenate([w for _, _, w in found])), lists], ["key", "node", "weight", "features"])


def _batched(groups: Groups, kind: pa.DataType, node: int) -> Iterator[pa.RecordBatch]:
    found, rows = [], 0
    for own in groups.given():
        found.append(own)
        rows += len(own[2])
        if rows >= 10_000:
            yield _group_table(kind, node, found)
            found, rows = [], 0
    if found:
        yield _group_table(kind, node, found)


def grouped_coresets(points: DataFrame, by: str, m: int = DEFAULT_M, features: str = "features", weight: str | None = None, seed: int = 3, fan_in: int = 8, held_points: int = HELD_POINTS, **options) -> DataFrame:  # noqa: ANN003
    """key, weight, features: a coreset of each group, as a partial and a merge aggregate.

    Tasks reduce the groups of the rows that they read, whatever the keys are, and give at most m points of each; those are merged about
    `fan_in` tasks at a time. So the largest task of a merge has fan_in * m rows of a group, however large the group is.
    """
    kind = points.schema[by].dataType.simpleString()
    schema = f"key {kind}, node long, weight double, features array<double>"
    rows = spread(points.select(F.col(by).alias("key"), *_inputs(points, features, weight)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        groups, own = Groups(m, seed, shard, held_points, **options), pa.string()
        for b in batches:
            if b.num_rows:
                own = b.column(0).type
                if groups.add(b.column(0), matrix_of(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)):
                    yield from _batched(groups, own, shard)
        yield from _batched(groups, own, shard)

    def merged(level: int):  # noqa: ANN202
        def run(key, table):  # noqa: ANN001, ANN202
            """The rows of a group's node as one coreset."""
            made, weights = matrix_of(table.column("features")), table.column("weight").to_numpy()
            order = np.lexsort((weights, *made.T))
            at, mass = kernel.coreset(made[order], weights[order], m, kernel.generator(seed, level, key[1].as_py()), **options)
            return pa.Table.from_batches([_group_table(key[0].type, key[1].as_py(), [(key[0].as_py(), made[order][at], mass)])])

        return run

    out, width, level = rows.mapInArrow(part, schema), 1, 1
    while width * fan_in < rows.rdd.getNumPartitions():
        width *= fan_in
    while width:
        out = out.withColumn("node", F.pmod("node", F.lit(width))).groupBy("key", "node").applyInArrow(merged(level), schema)
        width, level = width // fan_in, level + 1
    return out.drop("node")


def register_partial(spark: SparkSession, name: str = "coreset_parts", m: int = 100, seed: int = 3) -> None:
    """A table function for SQL: name(TABLE(SELECT key, features, weight ...)) gives key, weight, features, at most m points of each key from
    each task. What coreset_aggregate() registers makes one of them: SELECT key, coreset(features, weight) FROM name(...) GROUP BY key."""

    @F.arrow_udtf(returnType="key string, weight double, features array<double>")
    class Parts:
        def __init__(self) -> None:
            self.groups = Groups(m, seed, TaskContext.get().partitionId())

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            if rows.num_rows and self.groups.add(rows.column(0).cast(pa.string()), matrix_of(rows.column(1)), rows.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)):
                yield from self._given()

        def terminate(self) -> Iterator[pa.Table]:
            yield from self._given()

        def _given(self) -> Iterator[pa.Table]:
            for b in _batched(self.groups, pa.string(), 0):
                yield pa.Table.from_batches([b]).drop(["node"])

    spark.udtf.register(name, Parts)


def coreset_aggregate(spark: SparkSession, name: str = "coreset", m: int = 100, seed: int = 3) -> None:
    """Registers an aggregate for SQL: name(features) or name(features, weight) gives array<struct<weight, features>> of at most m points.

    A group's points meet in one task; large groups go through the table function of register_partial() first, which each task applies to
    what it reads, so that at most m points for each task meet.
    """

    @F.arrow_udf("array<struct<weight:double,features:array<double>>>")
    def reduced(features: pa.Array, weight: pa.Array) -> list:
        points, weights = matrix_of(features), weight.cast(pa.float64()).to_numpy(zero_copy_only=False)
        order = np.lexsort((weights, *points.T)) if len(points) else np.zeros(0, int)
        points, weights = points[order], weights[order]
        at, mass = kernel.coreset(points, weights, m, kernel.generator(seed)) if len(points) else (order, weights)
        return [{"weight": float(w), "features": p} for w, p in zip(mass, points[at].tolist(), strict=True)]

    spark.udf.register(name, reduced)
