"""Filter interaction audit on a packed bitmap index: what each filter removes after every set of others, by part of the corpus.

1. One pass over the texts gives a byte of failure bits for each document, and a SHA-256 of its text; the smallest doc_id of each digest
   tells which documents repeat an earlier one (filter E).
2. Each task packs its documents into bitsets: one for each filter and each label, cut by part. For each prefix subset of filters, AND-NOT
   leaves those that all of them pass, and popcounts of that with each further filter and label are what the filter would remove there.
3. The tasks' counts are added up by part and subset. Every order of the filters is read from them: a step removes what its filter does
   after the subset before it.

Defined cases. Null texts count as empty, null sources as the part "". Rows that repeat a doc_id are documents of their own, and none of
them is smaller than another; null doc_ids come after all others and have no labels. Of several labels of one doc_id, one that is 1 is
enough; null labels are none. An empty table gives no parts and so no rows. Other columns are ignored. Texts are read whole, in batches cut
by bytes: a task takes some ten times its longest text.

At scale. Digests and flags are shuffled, not texts. The smallest ids are pre-aggregated in each task; joins by digest and by doc_id have
one row for each key on the right, so Spark can split a hot one. A task gives at most 32 rows for each part that it has documents of, and at
most 17 for each document that fails something. The result has 600 rows for each part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import Tables, bounded_batches, bytes_of, read_table, row_slices

FILTERS = "ABCDE"
N = len(FILTERS)
SUBSETS = 1 << N
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SIGNS = b"#$%&*|"
#: Bits of a row's byte: failures of A to E, then the labels.
DUPLICATE, GOOD, TOXIC = N - 1, N, N + 1
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])
_SIGN = np.array([b in SIGNS for b in range(256)])
COUNTS = [f"{kind}{f}" for kind in "rgt" for f in range(N)]


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters that look at one text (A to D), of each text."""
    counted = lambda table: np.diff(np.r_[0, np.cumsum(table[data])][offsets])
    capitals, points, signs = counted(_CAPITAL), counted(_FIRST), counted(_SIGN)
    raw = data.tobytes()
    words = [raw[i:j].split() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    n = np.array([len(w) for w in words], np.int64)
    distinct = np.array([len(set(w)) for w in words], np.int64)
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITALS_PERCENT * points, signs > 0)
    return sum(f.astype(np.uint8) << k for k, f in enumerate(fails))


def flagged(documents: DataFrame) -> DataFrame:
    """doc_id, part, flags (bits of A to D), digest of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 2, max_bytes=1 << 20):
            data, offsets = bytes_of(b.column(2))
            digests = [hashlib.sha256(data[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(failures(data, offsets).astype(np.int16)), pa.array(digests, pa.binary())], ["doc_id", "part", "flags", "digest"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return own.mapInArrow(kernel, "doc_id long, part string, flags short, digest binary")


def with_flags(documents: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """part and flags (failures and labels) of each row of documents."""
    own = tables.write(flagged(documents), "flagged")
    twice = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    twice = tables.write(twice.select("digest", "first_id"), "copies")
    one = lambda k: F.coalesce(F.max(F.col(k) == 1), F.lit(False)).alias(k)
    known = tables.write(labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")), "labels")
    later = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("first_id") < F.col("doc_id")))
    marked = tables.write(own.join(twice, "digest", "left").select("doc_id", "part", "flags", later.alias("later")), "marked")
    bit = lambda c, k: F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    found = marked.join(known, "doc_id", "left").select("part", (F.col("flags") + bit(F.col("later"), DUPLICATE) + bit(F.col("quality"), GOOD) + bit(F.col("toxic"), TOXIC)).alias("flags"))
    return tables.write(found, "with-labels")


class Bitmaps:
    """Bitsets of some documents, packed to bytes: which fail each filter, and which have each label."""

    def __init__(self, flags: np.ndarray):
        self.n = len(flags)
        packed = np.packbits((flags[None, :] >> np.arange(N + 2)[:, None]) & 1, axis=1)
        self.fails, self.labels = packed[:N], packed[N:]
        self.all = np.packbits(np.ones(self.n, np.uint8))

    def after(self, subset: int) -> np.ndarray:
        """Those that all filters of the subset pass: AND-NOT, one filter after the other."""
        left = self.all.copy()
        for f in range(N):
            if subset >> f & 1:
                left &= ~self.fails[f]
        return left

    def counts(self, subset: int) -> tuple[int, np.ndarray]:
        """How many the subset removes, and what each further filter then removes: all, good, toxic (3 x N, zero for filters of the subset)."""
        left = self.after(subset)
        out = np.zeros((3, N), np.int64)
        for f in range(N):
            if not subset >> f & 1:
                removed = left & self.fails[f]
                out[:, f] = [np.bitwise_count(x).sum(dtype=np.int64) for x in (removed, removed & self.labels[0], removed & self.labels[1])]
        return self.n - int(np.bitwise_count(left).sum(dtype=np.int64)), out


def subset_counts(flags: DataFrame) -> DataFrame:
    """part, subset, n (documents, at the empty subset), gone (removed by the subset) and what each filter then removes, summed over tasks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:  # a byte a row
            part = b.column(0).dictionary_encode()
            code, value = part.indices.to_numpy(), b.column(1).to_numpy().astype(np.uint8)
            order = np.argsort(code, kind="stable")
            for k, rows in zip(part.dictionary.to_pylist(), np.split(value[order], np.cumsum(np.bincount(code, minlength=len(part.dictionary)))[:-1]), strict=True):
                held.setdefault(k, []).append(rows)
        rows = []
        for part, found in held.items():
            maps = Bitmaps(np.concatenate(found))
            for subset in range(SUBSETS):
                gone, removed = maps.counts(subset)
                if subset == 0 or gone or removed.any():
                    rows.append((part, subset, maps.n if subset == 0 else 0, gone, *removed.ravel().tolist()))
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    names = ["n", "gone", *COUNTS]
    made = flags.mapInArrow(kernel, "part string, subset int, " + ", ".join(f"{k} long" for k in names))
    return made.groupBy("part", "subset").agg(*[F.sum(k).alias(k) for k in names])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * (2 + 3 * N)]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "subset", "n", "gone", *COUNTS])


def steps() -> list[tuple[str, int, int, int, int]]:
    """filter_order, step, its filter, the subset before it and after it: all orders, five steps each."""
    out = []
    for order in permutations(range(N)):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    return out


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = documents.sparkSession
    bounded_batches(spark)
    with Tables(spark) as tables:
        counts = tables.write(subset_counts(with_flags(documents, labels, tables)), "counts", keep=True)
    struct = F.struct("gone", *[F.array(*[F.col(f"{kind}{f}") for f in range(N)]).alias(kind) for kind in "rgt"])
    # At most 32 entries a part.
    whole = counts.groupBy("part").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("subset", struct))).alias("of"))
    # How many orders have just these filters before f.
    ways = [math.factorial(s.bit_count()) * math.factorial(N - 1 - s.bit_count()) if s.bit_count() < N else 0 for s in range(SUBSETS)]
    shapley = counts.groupBy("part").agg(F.array(*[F.sum(F.col(f"r{f}") * F.array(*map(F.lit, ways))[F.col("subset")]) for f in range(N)]).alias("shapley"))
    grid = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("f"), F.lit(b).alias("before"), F.lit(a).alias("after")) for o, k, f, b, a in steps()])
    rows = whole.join(shapley, "part").select("part", "n", "of", "shapley", F.explode(grid).alias("s")).select("part", "n", "of", "shapley", "s.*")
    at = lambda subset, kind: F.coalesce(F.col("of")[subset][kind][F.col("f")], F.lit(0))
    others = F.array(*[F.lit(SUBSETS - 1 - (1 << f)) for f in range(N)])[F.col("f")]
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.coalesce(F.col("of")[F.col("after")]["gone"], F.lit(0))).alias("kept"),
        at(F.col("before"), "r").alias("removed"),
        (at(F.lit(0), "r") - at(F.col("before"), "r")).alias("redundant"),
        at(others, "r").alias("unique_fails"),
        at(F.col("before"), "g").alias("good_lost"),
        at(F.col("before"), "t").alias("toxic_lost"),
        F.col("shapley")[F.col("f")].alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


NAME = "op12_filter_audit"
_FAILS = {
    "a": "n_words < 200",
    "b": "100 * n_distinct < 50 * n_words",
    "c": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)",
    "d": "regexp_matches(t, '[#$%&*|]')",
    "e": "doc_id > min(doc_id) OVER (PARTITION BY t)",
}
_PASSED = " AND ".join(f"NOT (f.{k} AND position('{k.upper()}' IN substr(o.filter_order, 1, o.step - 1)) > 0)" for k in _FAILS)
_OWN = "CASE substr(o.filter_order, o.step, 1) " + " ".join(f"WHEN '{k.upper()}' THEN f.{k}" for k in _FAILS) + " END"
_ALONE = "CAST(f.a AS INT) + CAST(f.b AS INT) + CAST(f.c AS INT) + CAST(f.d AS INT) + CAST(f.e AS INT) = 1"
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, part, t, len(words) AS n_words, len(list_distinct(words)) AS n_distinct FROM w),
f AS (SELECT part, {', '.join(f'{v} AS {k}' for k, v in _FAILS.items())},
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM x),
c AS (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
p AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
o AS (SELECT filter_order, CAST(s.range AS INT) AS step FROM p, range(1, 6) s),
g AS (SELECT f.part, o.filter_order, o.step,
  sum(CASE WHEN {_PASSED} AND NOT {_OWN} THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN {_PASSED} AND {_OWN} THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN NOT ({_PASSED}) AND {_OWN} THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN {_ALONE} AND {_OWN} THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN {_PASSED} AND {_OWN} AND good THEN n ELSE 0 END) AS good_lost,
  sum(CASE WHEN {_PASSED} AND {_OWN} AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM c f, o GROUP BY 1, 2, 3)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM g
"""
