"""Best-fit packing by linear grouping: few sequences of at most `capacity` tokens.

A corpus is packed through the histogram of its piece lengths, which has at most `capacity` bins whatever the corpus: large lengths are
rounded up within groups of equal cardinality, a linear programme over all configurations of those few sizes says how many sequences of
each configuration to make, actual pieces are substituted run by run, and what is left and the small pieces go, longest first, where
they leave least room (best fit). The plan says, for each run of ranks among the pieces of one length, which sequences they go to.
Pieces learn their rank among those of their length with one shuffle and look their place up in the plan.

Defined cases. Null and empty texts are one piece of the end id alone. Rows that repeat a doc_id are packed as documents of their own.
Null doc_ids are kept. An empty table gives an empty result. Other columns are ignored. A very long text is tokenized part by part and cut
into as many pieces as it needs; it is in memory whole in the task that reads it.

At scale. The driver gets at most `capacity` counts; the plan has a bounded number of runs (splits only happen when a length or a group
is used up), whatever the corpus, and is broadcast. Ranks are dealt by length and a hash of the piece, so a length that a third of all
pieces have is spread over all partitions; pieces of full length are their own sequences and need no rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverstone.llm.common import bounded_batches, partitions, read_table, write_table
from riverstone.llm.tokens import DEFAULT_VOCABULARY, encoded

CAPACITY = 4096
END = (1).to_bytes(4, "little")


def pieces_of(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids array<int>): a document's ids and the end id, cut where they exceed capacity."""
    bounded_batches(documents.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in encoded(batches, 1, vocabulary):
            rows = []
            for doc, blob in zip(b.column(0).to_pylist(), ids, strict=True):
                blob += END
                for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                    own = blob[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)][: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


@dataclass
class Bins:
    """`count` sequences alike: slots (length, first rank) each take the next rank in the next sequence; `room` is what is left."""

    count: int
    room: int
    slots: list[tuple[int, int]]

    def split(self, n: int) -> tuple[Bins, Bins]:
        return Bins(n, self.room, list(self.slots)), Bins(self.count - n, self.room, [(length, rank + n) for length, rank in self.slots])


def groups_of(lengths: np.ndarray, counts: np.ndarray, n_groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, cut into groups of equal cardinality."""
    total, groups, own, held = int(counts.sum()), [], [], 0
    each = -(-total // n_groups) if total else 1
    for length, n in sorted(zip(map(int, lengths), map(int, counts), strict=True), reverse=True):
        while n:
            take = min(n, each - held)
            own.append((length, take))
            n, held = n - take, held + take
            if held == each:
                groups.append(own)
                own, held = [], 0
    return [*groups, own] if own else groups


def best_configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (groups that share a sequence) and how many of each, by the linear programme min sum x, A x >= need, rounded down.

    Sizes are over a quarter of the capacity, so all configurations can be listed. Revised simplex over them, started from sequences of
    one size each.
    """
    k, most = len(sizes), capacity // min(sizes)
    configs = [c for n in range(1, most + 1) for c in combinations_with_replacement(range(k), n)]
    members = np.full((len(configs), most), k, np.int32)  # k stands for no group
    for n in range(1, most + 1):
        own = [i for i, c in enumerate(configs) if len(c) == n]
        members[own[0] : own[-1] + 1, :n] = configs[own[0] : own[-1] + 1]
    members = members[np.append(sizes, 0)[members].sum(axis=1) <= capacity]
    single = np.zeros((k, k))
    single[np.arange(k), np.arange(k)] = capacity // np.array(sizes)
    basis = [tuple([i] * (capacity // sizes[i])) for i in range(k)]
    inverse, need_v = np.linalg.inv(single), np.array(need, float)
    columns = single.copy()
    for step in range(100 * k + 200):
        gain = np.append(inverse.sum(axis=0), 0)[members].sum(axis=1)
        enter = int(np.argmax(gain))
        if gain[enter] <= 1 + 1e-7:
            break
        config = tuple(int(i) for i in members[enter] if i < k)
        column = np.bincount(config, minlength=k).astype(float)
        x, d = inverse @ need_v, inverse @ column
        out = int(np.argmin(np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)))
        basis[out], columns[:, out] = config, column
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
        else:  # the one changed column
            row = inverse[out] / d[out]
            inverse = inverse - np.outer(d, row)
            inverse[out] = row
    x = np.linalg.inv(columns) @ need_v
    return [(c, int(n + 1e-6)) for c, n in zip(basis, x, strict=True) if n >= 1 - 1e-6]


#: Numbers of groups that are tried; few groups leave room that small pieces can use, many waste less where there are few small ones.
GROUPS = (2, 4, 8, 16, 32, 96)


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[Bins]:
    """Sequences for a histogram of lengths below the capacity: the fewest over the numbers of groups."""
    return min((_plan(hist, capacity, n) for n in groups), key=lambda bins: sum(b.count for b in bins))


def _plan(hist: dict[int, int], capacity: int, n_groups: int, small: float = 0.25) -> list[Bins]:
    limit = int(capacity * small)
    rank = dict.fromkeys(hist, 0)
    large = sorted(x for x in hist if x > limit)
    groups = groups_of(np.array(large), np.array([hist[x] for x in large], np.int64), n_groups)
    made: list[Bins] = []
    if groups:
        for config, n in best_configurations([g[0][0] for g in groups], [sum(c for _, c in g) for g in groups], capacity):
            made += _substitute(config, n, groups, rank, capacity)
    rest: dict[int, int] = {}
    for runs in groups:
        for length, n in runs:
            rest[length] = rest.get(length, 0) + n
    for length in (x for x in hist if x <= limit):
        rest[length] = hist[length]
    return _best_fit(made, rest, rank, capacity)


def _substitute(config: tuple[int, ...], n: int, groups: list, rank: dict[int, int], capacity: int) -> list[Bins]:
    """n sequences of a configuration with actual lengths; the groups give their longest pieces first."""
    runs: list[list[tuple[int, int, int]]] = []  # of each slot: length, first rank, count
    for g in config:
        own, left = [], n
        while left and groups[g]:
            length, there = groups[g][0]
            take = min(left, there)
            own.append((length, rank[length], take))
            rank[length] += take
            left -= take
            groups[g][0] = (length, there - take)
            if there == take:
                groups[g].pop(0)
        if left:
            own.append((0, 0, left))  # the rounded programme may ask for more than there is
        runs.append(own)
    out, used = [], 0
    edges = sorted({e for own in runs for e in np.cumsum([c for _, _, c in own]).tolist()})
    cursor = [(0, 0) for _ in runs]  # run, and where it began
    for edge in edges:
        slots = []
        for s, own in enumerate(runs):
            i, began = cursor[s]
            while began + own[i][2] <= used:
                began += own[i][2]
                i += 1
            cursor[s] = (i, began)
            if own[i][0]:
                slots.append((own[i][0], own[i][1] + used - began))
        if slots:
            out.append(Bins(edge - used, capacity - sum(x for x, _ in slots), slots))
        used = edge
    return out


def _best_fit(made: list[Bins], rest: dict[int, int], rank: dict[int, int], capacity: int) -> list[Bins]:
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    there = np.zeros(capacity + 1, bool)

    def put(b: Bins) -> None:
        by_room[b.room].append(b)
        there[b.room] = True

    for b in made:
        put(b)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = length + int(np.argmax(there[length:]))
            if not there[room]:
                each = min(capacity // length, n)
                b = Bins(n // each, capacity - each * length, [])
                b.slots = [(length, rank[length] + k * b.count) for k in range(each)]
                rank[length] += each * b.count
                n -= each * b.count
                put(b)
                continue
            b = by_room[room].pop()
            there[room] = bool(by_room[room])
            if b.count > n:
                b, more = b.split(n)
                put(more)
            b.slots.append((length, rank[length]))
            b.room -= length
            rank[length] += b.count
            n -= b.count
            put(b)
    return [b for row in by_room for b in row]


def plan_arrays(bins: list[Bins], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted by key = length << 44 | first rank; for each the first sequence and the offset in it."""
    rows, base = [], 0
    for b in bins:
        offset = 0
        for length, first in b.slots:
            rows.append((length << 44 | first, base - first, offset))
            offset += length
        base += b.count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 3)
    return cols[:, 0].copy(), cols[:, 1].copy(), cols[:, 2].copy()


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """pieces (a stored table with doc_id, piece, length and any other columns) and their sequence_id and offset."""
    spark = pieces.sparkSession
    below = pieces.filter(F.col("length") < capacity)
    hist = {r[0]: r[1] for r in below.groupBy("length").count().toLocalIterator()}
    keys, shift, offset = plan_arrays(plan(hist, capacity, groups), capacity)
    shared = spark.sparkContext.broadcast((keys, shift, offset))
    bucketed = below.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(8, partitions(spark)))))
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = bucketed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("key", F.shiftleft("length", 44) + F.col("own") + F.col("before")).drop("own", "before", "bucket")
    names = pieces.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shift, offset = shared.value
        for b in batches:
            key = b.column("key").to_numpy()
            run = np.searchsorted(keys, key, side="right") - 1
            rank = key & ((1 << 44) - 1)
            yield pa.record_batch([*(b.column(k) for k in names), pa.array(shift[run] + rank), pa.array(offset[run])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return ranked.mapInArrow(kernel, schema).unionByName(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def packed(documents: DataFrame) -> DataFrame:
    pieces = write_table(pieces_of(documents), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


NAME = "op5_packing"
