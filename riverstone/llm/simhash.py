"""SimHash near-dedup by multi-index hashing.

1. Each text becomes a 64-bit fingerprint: a bit is 1 if it is set in over half the XXH64 values (seed 42) of its word shingles, repeats
   included. Rows of one fingerprint are one class, so copies never make pairs.
2. The fingerprint is cut into segments. If two differ in at most `radius` bits, some segment differs in at most the share of bits that
   radii() gives it, or in none. Each fingerprint stands in the table of each segment under its own value there, and asks that table for
   all values within the segment's Hamming ball; of two neighbouring values only the smaller asks.
3. Those that meet at a value of a table are its bucket. Holders of the value are compared with all members on all 64 bits, and the links
   found are given back as a spanning forest of the bucket, which has fewer rows than the bucket has members.
4. A bucket of over `block` members is dealt to parts first, each compared by itself; then the parts are compared with one another, but
   only where they hold different components, so that no link is lost and a group of near copies isn't compared with itself.

Defined cases. Text is lower-cased for A-Z only. Null, empty and wordless texts have fingerprint zero, and link like any other; fewer words
than a shingle are one shingle. Rows that repeat a doc_id are judged by their own texts. Null ids come after all others: component_id is null
only for components without another id. An empty table gives an empty result. Other columns are ignored. A text is cut into shingles whole:
a task takes some twenty times its longest text.

At scale. After one pass over the texts only fingerprints are shuffled: 25 rows of 17 bytes for each different one with three segments,
some 280 with two. Two are taken from 2**25 fingerprints on, where values of 22 bits no longer part them; the links are the same. A spanning
forest has fewer rows than the bucket, so links are fewer than these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import Tables, bounded_batches, partitions, read_table, row_slices
from riverstone.llm.components import connected_components
from riverstone.llm.near_dedup import _units

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Different fingerprints up to which three segments are taken; beyond, two.
THREE_SEGMENTS = 1 << 25
BLOCK = 512
SHARD_ROWS = 20_000
#: Buckets of fewer members are compared many at a time.
SMALL = 8


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    cut = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cut), np.uint64, len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray, chunk: int = 1 << 14) -> int:
    """The fingerprint as an unsigned number; of no hashes, zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), chunk):
        raw = hashes[at : at + chunk].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 1, max_bytes=1 << 20):
            made = [fingerprint(shingle_hashes(t or b"", shingle)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, fp long")


def segments_of(m: int) -> list[tuple[int, int]]:
    """First bit and width of each of m segments, the wider ones first."""
    width = [BITS // m + (k < BITS % m) for k in range(m)]
    return [(sum(width[:k]), w) for k, w in enumerate(width)]


def radii(m: int, radius: int) -> list[int]:
    """How many bits each segment's ball allows: with radius = a * m + b, a in the first b + 1 segments and a - 1 in the others (-1: no ball).

    Two that differ in more than that in every segment differ in (b + 1) * (a + 1) + (m - b - 1) * a = radius + 1 bits at least.
    """
    a, b = divmod(radius, m)
    return [a if k <= b else a - 1 for k in range(m)]


def ball_masks(width: int, radius: int) -> np.ndarray:
    """All numbers of 1 to `radius` bits within the width."""
    return np.array([sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)], np.uint64)


def probes(prints: DataFrame, m: int, radius: int) -> DataFrame:
    """id (a fingerprint) to bucket, id, holds: its places in the tables, and the other values of each segment that it asks for."""
    plan = [(k, first, width, ball_masks(width, r)) for k, ((first, width), r) in enumerate(zip(segments_of(m), radii(m, radius), strict=True)) if r >= 0]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for k, first, width, masks in plan:
                    value = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    other = value[:, None] ^ masks[None, :]
                    row, which = np.nonzero(other > value[:, None])
                    key = np.concatenate([value, other[row, which]]) * np.uint64(m) + np.uint64(k)
                    ids = np.concatenate([fp, fp[row]])
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(np.arange(len(ids)) < len(fp))], ["bucket", "id", "holds"])

    return prints.select("id").mapInArrow(kernel, "bucket long, id long, holds boolean")


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric matrix of links, as pairs of indexes."""
    left, a, b = np.ones(len(linked), bool), [], []
    while left.any():
        edge = np.array([int(left.argmax())])
        left[edge] = False
        while len(edge):
            reached = np.flatnonzero(linked[edge].any(axis=0) & left)
            a += edge[linked[edge][:, reached].argmax(axis=0)].tolist() if len(reached) else []
            b += reached.tolist()
            left[reached] = False
            edge = reached
    return a, b


def _compared(radius: int, across: bool):
    def kernel(key, table):  # noqa: ANN001, ANN202
        """In each bucket of a shard, holders against all members; across: only against members of other components, side 0 against side 1 where both are there."""
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket, fp, holds = bucket[order], table.column("id").to_numpy()[order].view(np.uint64), table.column("holds").to_numpy(zero_copy_only=False)[order]
        comp, side = (table.column(k).to_numpy()[order] for k in ("component", "side")) if across else (None, None)
        edges = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket))
        begin, count = edges[:-1], np.diff(edges)
        found_a, found_b = [], []
        few = begin[count <= SMALL] if not across else begin[:0]
        size = count[count <= SMALL] if not across else count[:0]
        for i, j in combinations(range(SMALL), 2):
            at = few[size > j]
            hit = at[(holds[at + i] | holds[at + j]) & near(fp[at + i], fp[at + j], radius)]
            found_a.append(fp[hit + i])
            found_b.append(fp[hit + j])
        large = zip(begin, count, strict=True) if across else zip(begin[count > SMALL], count[count > SMALL], strict=True)
        for at, n in large:
            own, holder = fp[at : at + n], holds[at : at + n]
            linked = np.zeros((n, n), bool)
            linked[holder] = near(own[holder][:, None], own[None, :], radius)
            if across:
                linked &= comp[at : at + n][:, None] != comp[at : at + n][None, :]
                if side[at : at + n].any():
                    linked &= side[at : at + n][:, None] != side[at : at + n][None, :]
            a, b = forest(linked | linked.T)
            found_a.append(own[a])
            found_b.append(own[b])
        return pa.table({"a": pa.array(np.concatenate(found_a).view(np.int64)), "b": pa.array(np.concatenate(found_b).view(np.int64))})

    return kernel


def _links(rows: DataFrame, n_rows: int, per_shard: int, radius: int, across: bool) -> DataFrame:
    n = max(partitions(rows.sparkSession), n_rows // per_shard)
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(n)))
    return shards.groupBy("shard").applyInArrow(_compared(radius, across), "a long, b long").distinct()


def near_links(prints: DataFrame, tables: Tables, radius: int = RADIUS, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """Different fingerprints (column id, stored) to links (a, b) of at most `radius` bits, with the same components as all such links have."""
    m = segments or (3 if prints.count() <= THREE_SEGMENTS else 2)
    asked = tables.write(probes(prints, m, radius), "probes")
    sizes = asked.groupBy("bucket").agg(F.count("*").alias("n"), F.max("holds").alias("held")).filter("n > 1 and held").select("bucket", "n")
    members = tables.write(asked.join(tables.write(sizes, "sizes"), "bucket"), "members")
    tables.drop("probes")
    part = F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("n") / F.lit(block)).cast("long"))
    parted = members.select(F.when(F.col("n") <= block, F.col("bucket")).otherwise(F.xxhash64("bucket", part, F.lit("part"))).alias("bucket"), "id", "holds")
    links = tables.write(_links(parted, members.count(), SHARD_ROWS, radius, False), "links")
    large = members.filter(F.col("n") > block).select("bucket", "id", "holds")
    if large.isEmpty():
        return links
    # What is left open: large buckets with several components, of which a holder is one.
    labelled = large.join(connected_components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
    labelled = tables.write(labelled.join(open_, "bucket", "left_semi"), "labelled")
    units = tables.write(_units(labelled.select("bucket", "id", "component"), block).withColumn("holds", F.lit(True)), "units")
    more = _links(units, units.count(), 4 * block, radius, True)
    return tables.write(links.unionByName(more), "all-links")


def simhash_groups(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each row of documents: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    spark = documents.sparkSession
    bounded_batches(spark)
    with Tables(spark) as tables:
        prints = tables.write(fingerprints(documents, shingle), "prints", keep=True)
        own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("own")
        classes = tables.write(prints.groupBy(F.col("fp").alias("id")).agg(own), "classes")
        links = near_links(classes, tables, radius, segments, block)
        linked = tables.write(classes.join(connected_components(links), "id"), "linked")
        heads = tables.write(linked.groupBy("component").agg(F.min("own").alias("head")), "heads")
        headed = linked.join(heads, "component").select("id", "head")
        named = classes.join(headed, "id", "left").select(F.col("id").alias("fp"), F.coalesce("head", "own").alias("head"))
        named = tables.write(named, "named", keep=True)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head.doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


NAME = "op11_simhash"
