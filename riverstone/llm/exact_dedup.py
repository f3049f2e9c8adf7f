"""Exact dedup by a log-structured merge index.

Texts are normalised (white space deleted) and digested in the JVM. Each task gathers digests in a memtable; a full one is flushed as
runs, sorted by digest, one for each bucket of digests, each with a Bloom filter. Compaction merges the runs of a bucket two by two, the
smallest first: keys that the larger run's filter lacks are new and not looked up, the rest are; of equal digests the entry with the most
code points, then the smallest identifier, stays, and counts add up. Hits, the rows of digests that occur twice, are then verified byte
for byte against the row that stays; rows that differ in spite of an equal digest are grouped by their text.

Defined cases. Null text counts as empty, and all texts of white space only are equal. Rows that repeat a doc_id are rows of their own
that count in group_size, but one document: kept is the same for all of them; a null doc_id sorts after all others. An empty table gives
an empty result. Other columns are ignored. A text is one value in one row however long it is.

At scale. The number of buckets grows with the rows, so that a bucket has some `bucket_rows` entries of 57 bytes whatever the table. A
hot digest is one entry for each memtable, so compaction never gets the rows of a group; the joins that bring back keep_id and the text to
compare with have one row for each digest on the right, and Spark splits their skewed partitions. Only documents that have a copy are
compared, and their texts shuffled. Rows find their own texts by id, length and a hash of the text, so repeated and missing ids multiply nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import Tables, bounded_batches, partitions, read_table

WHITE = " \t\n\x0b\x0c\r"
BUCKET_ROWS = 250_000
#: keep is 0 where none (the row has no id) is 1.
ENTRY = np.dtype([("digest", "S32"), ("none", "u1"), ("keep", "<i8"), ("chars", "<i8"), ("count", "<i8")])


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


class Bloom:
    """A filter of a run: `hashes` bits of each digest, in a power of two of bits, at least 10 a key; kept as bytes beside the run."""

    HASHES = 4

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 8 * len(words)

    @classmethod
    def of(cls, digests: np.ndarray) -> Bloom:
        made = cls(np.zeros(1 << max(7, int(np.ceil(np.log2(max(1, len(digests)) * 10 / 8)))), np.uint8))
        at = made._at(digests).ravel()
        np.bitwise_or.at(made.words, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return made

    def _at(self, digests: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(digests).view("<u4").reshape(len(digests), 8)
        return (words[:, : self.HASHES] & np.uint32(self.bits - 1)).astype(np.int64)

    def may_have(self, digests: np.ndarray) -> np.ndarray:
        at = self._at(digests)
        return ((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def folded(entries: np.ndarray) -> np.ndarray:
    """A sorted run: one entry for each digest, of the most code points and then the smallest identifier, with the sum of counts."""
    if not len(entries):
        return entries
    order = np.lexsort((entries["keep"], entries["none"], -entries["chars"], entries["digest"]))
    e = entries[order]
    first = np.flatnonzero(np.r_[True, e["digest"][1:] != e["digest"][:-1]])
    out = e[first].copy()
    out["count"] = np.add.reduceat(e["count"], first)
    return out


def merged(a: np.ndarray, b: np.ndarray, filter_a: Bloom) -> tuple[np.ndarray, int]:
    """Two sorted runs as one, and how many keys of b were looked up in a: those that a's filter may have."""
    asked = np.flatnonzero(filter_a.may_have(b["digest"]))
    place = np.minimum(np.searchsorted(a["digest"], b["digest"][asked]), len(a) - 1)
    hit = a["digest"][place] == b["digest"][asked]
    at, same = place[hit], b[asked[hit]]
    a = a.copy()
    earlier = (same["none"] < a["none"][at]) | ((same["none"] == a["none"][at]) & (same["keep"] < a["keep"][at]))
    better = (same["chars"] > a["chars"][at]) | ((same["chars"] == a["chars"][at]) & earlier)
    a["count"][at] += same["count"]
    for k in ("none", "keep", "chars"):
        a[k][at[better]] = same[k][better]
    both = np.concatenate([a, np.delete(b, asked[hit])])
    return both[np.argsort(both["digest"], kind="stable")], len(asked)  # two sorted stretches, which a stable sort merges


def compacted(runs: list[tuple[np.ndarray, Bloom]]) -> tuple[np.ndarray, int, int]:
    """All runs of a bucket as one, the two smallest first; keys that were looked up, and keys that filters spared a look."""
    left = sorted((r for r in runs if len(r[0])), key=lambda r: len(r[0]))
    looked = spared = 0
    while len(left) > 1:
        (b, _), (a, filter_a) = left[:2]
        both, n = merged(a, b, filter_a)
        looked, spared = looked + n, spared + len(b) - n
        left = sorted([(both, Bloom.of(both["digest"])), *left[2:]], key=lambda r: len(r[0]))
    return left[0][0] if left else np.zeros(0, ENTRY), looked, spared


def _flush(n_buckets: int, memtable_rows: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            run = folded(np.concatenate(table))
            heads = np.ascontiguousarray(run["digest"]).view(">u4").reshape(len(run), 8)[:, 7] % n_buckets
            order = np.argsort(heads, kind="stable")
            run, heads = run[order], heads[order]
            cut = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            runs = [run[i:j] for i, j in zip(cut, [*cut[1:], len(run)], strict=True)]
            filters = [Bloom.of(r["digest"]).words.tobytes() for r in runs]
            yield pa.record_batch([pa.array(heads[cut].astype(np.int32)), pa.array([r.tobytes() for r in runs], pa.binary()), pa.array(filters, pa.binary())], ["bucket", "run", "filter"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            e = np.zeros(n, ENTRY)
            e["digest"] = np.array(batch.column(0).to_pylist(), dtype="S32")
            e["none"] = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            e["keep"] = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            e["chars"] = batch.column(2).to_numpy(zero_copy_only=False)
            e["count"] = 1
            table.append(folded(e))
            held += len(table[-1])
            if held >= memtable_rows:
                yield from flush()
                table, held = [], 0
        if held:
            yield from flush()

    return kernel


def _compact(key, table):  # noqa: ANN001, ANN201
    """A bucket's runs, merged; one row for each digest."""
    runs, filters = table.column("run").to_pylist(), table.column("filter").to_pylist()
    run, _, _ = compacted([(np.frombuffer(r, ENTRY), Bloom(np.frombuffer(f, np.uint8))) for r, f in zip(runs, filters, strict=True)])
    digests = pa.Array.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(np.ascontiguousarray(run["digest"]).tobytes())]).cast(pa.binary())
    return pa.table({"digest": digests, "keep_id": pa.array(run["keep"], mask=run["none"].astype(bool)), "keep_chars": pa.array(run["chars"].copy()), "copies": pa.array(run["count"].copy())})


def flush_runs(digests: DataFrame, n_buckets: int, memtable_rows: int = 1_000_000) -> DataFrame:
    """digests (digest binary of 32 bytes, doc_id, chars) to flushed runs: bucket, run, filter."""
    return digests.select("digest", "doc_id", "chars").mapInArrow(_flush(n_buckets, memtable_rows), "bucket int, run binary, filter binary")


def build_index(digests: DataFrame, n_buckets: int, memtable_rows: int = 1_000_000) -> DataFrame:
    """The compacted index of all runs: digest, keep_id, keep_chars, copies."""
    return flush_runs(digests, n_buckets, memtable_rows).groupBy("bucket").applyInArrow(_compact, "digest binary, keep_id long, keep_chars long, copies long")


def merge_indexes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A later batch's index merged into an older one; committing it is left to the caller's table write."""
    both = old.unionByName(new).groupBy("digest").agg(_best("keep_chars", "keep_id").alias("b"), F.sum("copies").alias("copies"))
    return both.select("digest", F.col("b.id").alias("keep_id"), (-F.col("b.low")).alias("keep_chars"), "copies")


def _best(chars: str, own_id: str) -> Column:
    """Of a group's rows, that with the most code points and then the smallest id, null after all others: struct(low, none, id)."""
    return F.min(F.struct((-F.col(chars)).alias("low"), F.col(own_id).isNull().alias("none"), F.col(own_id).alias("id")))


def exact_dedup(documents: DataFrame, memtable_rows: int = 1_000_000, digest_bytes: int = 32, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    digest_bytes: how much of the SHA-256 the index uses, the rest is 0; fewer make byte verification do the work (tests).
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    norm = normalised(F.col("text"))
    sha = F.sha2(norm, 256)
    digest = F.unhex(F.rpad(F.substring(sha, 1, 2 * digest_bytes), 64, "0"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = F.char_length("text").cast("long")
    # Tells the texts of rows with one id, or none, apart, so that a row finds itself and not its namesakes.
    docs = docs.withColumns({"chars": chars, "th": F.xxhash64("text")})
    own = ["doc_id", "chars", "th"]
    with Tables(spark) as tables:
        digested = tables.write(docs.select(*own, sha.alias("text_sha256"), digest.alias("digest")), "digests", keep=True)
        index = build_index(digested, max(8, partitions(spark), digested.count() // bucket_rows), memtable_rows)
        twice = tables.write(index.filter("copies > 1").select("digest", "keep_id", "copies"), "copies", keep=True)
        placed = digested.join(twice, "digest", "left")
        # Byte verification: the text of each hit against the text of the row that stays.
        hit = digested.join(twice, "digest").select(*own, "keep_id", F.col("digest").alias("hit_digest")).distinct()
        # Stored before they are digested again: else Spark would make the digest a key of this join, and digest all texts for it.
        texts = tables.write(docs.join(hit.withColumnsRenamed({k: f"hit_{k}" for k in own}), _same(own)).select(*own, "text", "keep_id", "hit_digest"), "hits")
        hits = texts.select(*own, "keep_id", norm.alias("norm"), sha.alias("text_sha256"), digest.alias("digest"), "hit_digest").filter("digest = hit_digest").drop("hit_digest")
        kept = tables.write(hits.filter("doc_id <=> keep_id").select("digest", F.col("norm").alias("keep_norm")).dropDuplicates(["digest"]), "kept")
        differs = hits.join(kept, "digest").filter(F.col("norm") != F.col("keep_norm")).select(*own, "norm", "text_sha256", "digest")
        differs = tables.write(differs, "differs", keep=True)
    return _resolved(placed, differs)


def _same(own: list[str]) -> Column:
    """Columns equal those of the same name with hit_ before it; nulls equal each other."""
    return functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"hit_{k}")) for k in own])


def _resolved(placed: DataFrame, differs: DataFrame) -> DataFrame:
    """Groups by digest, but rows that differ from the row that stays leave its group for groups by their own text."""
    own = ["doc_id", "digest", "text_sha256"]
    alone = F.col("copies").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    out = placed.select(*own, keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("group_size"))
    if not differs.isEmpty():
        best = differs.groupBy("digest", "norm").agg(_best("chars", "doc_id").alias("b"), F.count("*").alias("n")).select("digest", "norm", F.col("b.id").alias("own_keep"), F.col("n").alias("own_size"))
        moved = differs.join(best, ["digest", "norm"]).select(*[F.col(k).alias(f"hit_{k}") for k in own], "own_keep", "own_size").distinct()
        less = differs.groupBy("digest").agg(F.count("*").alias("gone"))
        out = out.join(moved, _same(own), "left").join(less, "digest", "left")
        gone = F.col("own_size").isNotNull()
        size = F.when(gone, F.col("own_size")).otherwise(F.col("group_size") - F.coalesce("gone", F.lit(0)))
        out = out.select("doc_id", F.when(gone, F.col("own_keep")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


NAME = "op7_exact_dedup"
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept, text_sha256
FROM d
"""
