"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of hashed word shingles, a MinHash signature and band keys. Documents of the same words in the same order
   (128 bits of BLAKE2b) are one class, the smallest id standing for it, so copies never make pairs.
2. Classes that share a band key are candidates. In each bucket the member nearest to the bucket's consensus signature is compared with
   all others, batch after batch of the signatures; a pair is dropped as soon as the posterior probability that its similarity reaches
   the threshold falls below `miss` (uniform prior; a byte of each MinHash is compared, chance matches are allowed for).
3. Survivors are verified exactly on the full sets: equal hashes count only if the bytes of the shingles are equal. Verified links give
   components.
4. Buckets that still hold several components get all their pairs across components compared in the same way, so that links that do not
   run through a bucket's centre are found too. Of survivors, 32 bits of each shingle's hash are compared in the bucket; pairs with enough
   in common are verified, and the components of all links are the result.

Defined cases. Null, empty and wordless texts have empty sets: no links, each is kept. A text of fewer words than a shingle is one
shingle. Each row is judged by its own text: rows that repeat a doc_id, null among them, with different texts may get different components.
Rows that repeat both doc_id and text are one document. Of a component, rows with its smallest doc_id are kept; near_rows() tells which of
one doc_id's several texts stays, that with the least hash. Null comes after all other ids. An empty table gives an empty result. Other columns are ignored.
Texts are read whole: the memory of a task grows with its longest text, to about a hundred times its bytes while it is cut into shingles.

With 48 bands of 5 a pair at similarity 0.75 is missed as a candidate with probability 2.3e-6, more similar ones with less. A bucket of
over `max_bucket` classes is dealt again by its own band together with each of the 58 bands of 4 that the other values (a byte of each)
make, which parts most pairs that aren't similar; that adds 3e-9 at most: the pair has a band in common, but none of the 58 short ones.

At scale. Pairs within a component are never made, nor rows for pairs that aren't links but by a collision of 32 bits. Signatures go to
buckets first, sets only to those of their members that survive them, and texts only to links. No bucket lands in one task: a large one has a centre for each of its parts, and what it leaves open is cut
into blocks of `block` members, of which pairs of blocks are compared. Blocks of one and the same component are not, so a group of near
copies costs rows in proportion to its size; members of a bucket that are all in different components cost pairs of signatures.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import Tables, bounded_batches, bytes_of, partitions, read_table, row_slices
from riverstone.llm.components import connected_components
from riverstone.llm.hashing import BASE, equal_segments, mixed, segment_hashes

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 48, 5
#: Values in a band by which an oversized bucket is dealt again.
SHORT = 4
BATCH = 40
MISS = 1e-6
MAX_BUCKET = 4000
SHARD_ROWS = 20_000
#: Members of a bucket that are compared with as many others in one unit of work.
BLOCK = 512

_rng = np.random.Generator(np.random.Philox(20240229))
_IN_SHINGLE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_IN_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

class Shingles:
    """The sets of word shingles of some texts.

    packed: the texts in lower case, each word followed by one space. h: hashes of the distinct shingles, sorted within each text; at: n + 1
    offsets in h; start, length: where in packed each of them stands. clean: whether equal hashes within a text stand for equal bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, check: bool = False):
        n_docs = len(offsets) - 1
        padded = np.full(len(data) + n_docs, 0x20, np.uint8)  # a separator ends each text
        padded[np.arange(len(data)) + np.repeat(np.arange(n_docs), np.diff(offsets))] = _LOWER[data]
        padded[_SEPARATORS[padded]] = 0x20
        blank = padded == 0x20
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        self.packed = padded[keep]
        self.edges = np.r_[0, np.cumsum(keep)][offsets + np.arange(n_docs + 1)]
        end = np.flatnonzero(self.packed == 0x20)
        begin = np.r_[0, end[:-1] + 1] if len(end) else end
        words = segment_hashes(self.packed, begin, end)
        first = np.searchsorted(begin, self.edges)  # of each text's words
        count = np.diff(first)
        made = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(n_docs), made)
        word = first[doc] + np.arange(len(doc)) - np.r_[0, np.cumsum(made)][doc]
        width = np.minimum(count, shingle)[doc]
        h = np.zeros(len(doc), np.uint64)
        for j in range(shingle):
            inside = j < width
            h[inside] += words[word[inside] + j] * _IN_SHINGLE[j]
        h = mixed(h + width.astype(np.uint64))
        start, length = begin[word], end[word + width - 1] - begin[word] if len(word) else word
        order = np.lexsort((h, doc))
        h, doc, start, length = h[order], doc[order], start[order], length[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        if check:
            like = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else start
            self.clean = bool((length == length[like]).all() and equal_segments(self.packed, start, self.packed, start[like], length).all())
        self.h, self.start, self.length = h[new], start[new], length[new]
        self.at = np.searchsorted(doc[new], np.arange(n_docs + 1))

    def text(self, i: int) -> np.ndarray:
        return self.packed[self.edges[i] : self.edges[i + 1]]


def shingle_words(text: bytes, shingle: int) -> set[tuple[bytes, ...]]:
    """The set itself, of words."""
    words = text.split()
    return set(zip(*(words[j:] for j in range(shingle)), strict=False)) if len(words) >= shingle else {tuple(words)} if words else set()


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, uint32, of each non-empty set."""
    begins = at[:-1][np.diff(at) > 0]
    lo, hi = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), BANDS * ROWS), np.uint32)
    x, y = np.empty_like(lo), np.empty_like(lo)
    for i in range(BANDS * ROWS):
        np.multiply(lo, _A[i], out=x)
        np.multiply(hi, _B[i], out=y)
        np.add(x, y, out=x)
        out[:, i] = np.minimum.reduceat(x, begins)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64) * _IN_BAND
    return mixed(parts.sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * BASE).view(np.int64)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches among n values with which the posterior P(similarity >= threshold) is at least `miss`; prior uniform."""
    t = threshold + (1 - threshold) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def text_hashes(text: Column) -> tuple[Column, Column]:
    """h1, h2: 128 bits that tell the texts of one doc_id apart; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def profile(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text, h1, h2, none (1 for rows without an id, whose doc_id is 0 here) to doc_id, h1, h2, none, n_shingles, k1, k2 (128 bits of BLAKE2b of the words), sig (a byte of each MinHash), bands; null for empty sets."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 1, max_bytes=1 << 19):
            sets = Shingles(*bytes_of(b.column(1)), shingle)
            size = np.diff(sets.at)
            full = np.flatnonzero(size)
            keys = np.zeros((b.num_rows, 2), np.int64)
            sig, bands = [None] * b.num_rows, [None] * b.num_rows
            if len(full):
                s = signatures(sets.h, sets.at)
                for row, x, y in zip(full.tolist(), s.astype(np.uint8), band_keys(s), strict=True):
                    sig[row], bands[row] = x.tobytes(), y
                    keys[row] = np.frombuffer(hashlib.blake2b(sets.text(row), digest_size=16).digest(), np.int64)
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(size.astype(np.int64)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "none", "n_shingles", "k1", "k2", "sig", "bands"])

    return docs.mapInArrow(kernel, "doc_id long, h1 long, h2 long, none int, n_shingles long, k1 long, k2 long, sig binary, bands array<long>")


class Verifier:
    """Which pairs survive, batch after batch of the signatures."""

    def __init__(self, percent: int, miss: float):
        n = BANDS * ROWS
        self.percent = percent
        self.steps = [(a, min(a + BATCH, n)) for a in range(0, n, BATCH)]
        self.need = [least_matches(b, percent / 100, miss) for _, b in self.steps]

    def survivors(self, one: np.ndarray, size: int, sig: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Indexes into sig that may be similar enough to one; sets too different in size can't be."""
        return self._run(lambda left, a, b: sig[left, a:b] == one[a:b], size, sizes)

    def pairwise(self, i: np.ndarray, j: np.ndarray, sig: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Indexes into i and j of the pairs that may be similar enough."""
        return self._run(lambda left, a, b: sig[i[left], a:b] == sig[j[left], a:b], sizes[i], sizes[j])

    def _run(self, equal, size, sizes) -> np.ndarray:  # noqa: ANN001
        left = np.flatnonzero(100 * np.minimum(size, sizes) >= self.percent * np.maximum(size, sizes))
        seen = np.zeros(len(left), np.int32)
        for (a, b), need in zip(self.steps, self.need, strict=True):
            if not len(left):
                break
            seen += equal(left, a, b).sum(axis=1, dtype=np.int32)
            alive = seen >= need
            left, seen = left[alive], seen[alive]
        return left

    def enough(self, one: np.ndarray, others: list[np.ndarray], size: int, sizes: np.ndarray) -> np.ndarray:
        """Which of the sets of hashes have enough in common with one."""
        joined = np.concatenate(others)
        at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
        begins = np.cumsum([0] + [len(x) for x in others[:-1]])
        both = np.add.reduceat((one[at] == joined).astype(np.int64), begins)
        return 100 * both >= self.percent * (size + sizes - both)


def _parted(table, *names: str) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    """A shard's columns sorted by bucket, and where each bucket begins (and the last ends)."""
    bucket = table.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(table.num_rows, BANDS * ROWS)
    return edges, sig[order], *(table.column(k).to_numpy()[order] for k in ("id", "n_shingles", *names))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]):  # noqa: ANN202
    """A table of distinct pairs, the smaller id first."""
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pa.table({"a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})


def _centre(sig: np.ndarray, ids: np.ndarray) -> int:
    """The member that agrees most with the others (few members) or with the commonest values."""
    if len(ids) <= 32:
        near = (sig[:, None, :] == sig[None, :, :]).sum(axis=(1, 2))
    else:
        common = np.array([np.bincount(column, minlength=256).argmax() for column in sig.T], np.uint8)
        near = (sig == common).sum(axis=1)
    return int(np.lexsort((ids, -near))[0])


def _star(percent: int, miss: float):
    def kernel(key, table):  # noqa: ANN001, ANN202
        """In each bucket of a shard, the centre against all other members."""
        edges, sig, ids, sizes = _parted(table)
        verifier = Verifier(percent, miss)
        begin, count = edges[:-1], np.diff(edges)
        two = begin[count == 2]
        found = verifier.pairwise(two, two + 1, sig, sizes)
        a, b = [ids[two[found]]], [ids[two[found] + 1]]
        for i, n in zip(begin[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            c = i + _centre(sig[i : i + n], ids[i : i + n])
            near = i + verifier.survivors(sig[c], sizes[c], sig[i : i + n], sizes[i : i + n])
            near = near[near != c]
            a.append(np.full(len(near), ids[c]))
            b.append(ids[near])
        return _pairs(a, b)

    return kernel


def _across(percent: int, miss: float, with_sets: bool):
    names = ["bucket", "side", "id", "component", "n_shingles", "sig"]

    def kernel(key, table):  # noqa: ANN001, ANN202
        """In each unit of a shard, the pairs of members in different components whose sets may be similar enough.

        A unit is one block of a bucket, or two (side 0 and 1), of which only pairs from one to the other count. Gives the members of such
        pairs; with sets (`hashes`: 32 bits of each shingle, with which the common part is never too small), the pairs that have enough in common.
        """
        table = table.take(pa.array(np.argsort(table.column("bucket").to_numpy(), kind="stable")))
        edges, sig, ids, sizes, comp, side = _parted(table, "component", "side")
        hashes = table.column("hashes").combine_chunks() if with_sets else None
        set_of = lambda i: np.frombuffer(hashes[int(i)].as_buffer(), np.uint32)
        verifier = Verifier(percent, miss)
        a, b = [], []
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            two = side[begin:end].any()
            at = begin + np.lexsort((comp[begin:end], side[begin:end]))
            own = comp[at]
            if two:
                cut = int(np.searchsorted(side[at], 1))
                asked, start = range(cut), np.full(cut, cut)
            else:
                start = np.searchsorted(own, own, side="right")  # members of later components
                asked = range(int(np.searchsorted(own, own[-1])))
            for i in asked:
                others = at[start[i] :]
                if two:
                    others = others[comp[others] != own[i]]
                near = others[verifier.survivors(sig[at[i]], sizes[at[i]], sig[others], sizes[others])]
                if with_sets and len(near):
                    near = near[verifier.enough(set_of(at[i]), [set_of(j) for j in near], sizes[at[i]], sizes[near])]
                a.append(np.full(len(near), at[i]))
                b.append(near)
        if with_sets:
            return _pairs([ids[x] for x in a], [ids[x] for x in b])
        return table.take(pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *a, *b])))).select(names)

    return kernel


def _hashes(texts: DataFrame, shingle: int) -> DataFrame:
    """id, text to id, hashes: the sorted low 32 bits of the set's hashes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 1, max_bytes=1 << 19):
            sets = Shingles(*bytes_of(b.column(1)), shingle)
            low = sets.h.astype(np.uint32)
            yield pa.record_batch([b.column(0), pa.array([np.sort(low[i:j]).tobytes() for i, j in zip(sets.at[:-1], sets.at[1:], strict=True)], pa.binary())], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(kernel, "id long, hashes binary")


def _common(x: Shingles, i: int, y: Shingles, j: int, shingle: int) -> int:
    """How many shingles two texts have in common: equal hashes whose bytes are compared too."""
    p, q = slice(x.at[i], x.at[i + 1]), slice(y.at[j], y.at[j + 1])
    h, other = x.h[p], y.h[q]
    if not len(other) or not len(h):
        return 0
    there = np.minimum(np.searchsorted(other, h), len(other) - 1)
    both = np.flatnonzero(other[there] == h)
    there = there[both]
    n = x.length[p][both]
    alike = (n == y.length[q][there]) & equal_segments(x.packed, x.start[p][both], y.packed, y.start[q][there], n)
    if x.clean and y.clean and alike.all():
        return len(both)
    return len(shingle_words(x.text(i).tobytes(), shingle) & shingle_words(y.text(j).tobytes(), shingle))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough, shingle by shingle; texts: id, text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_slices(iter([whole]), 2, max_bytes=1 << 19):
                sides = []
                for c, text in ((0, 2), (1, 3)):
                    ids, first, at = np.unique(b.column(c).to_numpy(), return_index=True, return_inverse=True)
                    sides.append((Shingles(*bytes_of(b.column(text).take(pa.array(first))), shingle, check=True), at))
                (x, own), (y, other) = sides
                ok = []
                for i, j in zip(own.tolist(), other.tolist(), strict=True):
                    both = _common(x, i, y, j, shingle)
                    sizes = (int(x.at[i + 1] - x.at[i]), int(y.at[j + 1] - y.at[j]))
                    if not (x.clean and y.clean):
                        sizes = (len(shingle_words(x.text(i).tobytes(), shingle)), len(shingle_words(y.text(j).tobytes(), shingle)))
                    ok.append(both > 0 and 100 * both >= percent * (sum(sizes) - both))
                keep = pa.array(np.flatnonzero(ok))
                yield pa.record_batch([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(kernel, "a long, b long")


def near_groups(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, max_bucket: int = MAX_BUCKET, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    return near_rows(documents, shingle, percent, miss, max_bucket, block).drop("h1", "h2", "stays")


def near_rows(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, max_bucket: int = MAX_BUCKET, block: int = BLOCK) -> DataFrame:
    """What near_groups() gives, and h1 and h2, the text_hashes() of each row, and stays: whether the row's text is the one of its component that stays."""
    spark = documents.sparkSession
    bounded_batches(spark)
    with Tables(spark) as tables:
        return _near_rows(documents, shingle, percent, miss, max_bucket, block, tables)


def _near_rows(documents: DataFrame, shingle: int, percent: int, miss: float, max_bucket: int, block: int, tables: Tables) -> DataFrame:
    own, keys = ["none", "doc_id", "h1", "h2"], ["k1", "k2", "n_shingles"]
    given = F.col("doc_id").cast("long")
    docs = documents.select(F.coalesce(given, F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *text_hashes(F.col("text")), given.isNull().cast("int").alias("none"))
    profiles = tables.write(profile(docs, shingle), "profiles")
    keyed = tables.write(profiles.drop("sig", "bands"), "keys", keep=True)
    some = keyed.filter("n_shingles > 0")
    # A class's number is its own even where its smallest doc_id also has texts of other classes; the table is written, so numbers stay.
    classes = some.groupBy(*keys).agg(F.min(F.struct(*own)).alias("first")).select(*keys, "first.*").withColumn("id", F.monotonically_increasing_id())
    classes = tables.write(classes, "sets")
    rows = profiles.filter("n_shingles > 0").select(*own, "sig", "bands").join(classes, own).dropDuplicates(["id"]).select("id", "n_shingles", "sig", "bands")
    rows = tables.write(rows, "classes")
    tables.drop("profiles")
    buckets = tables.write(_buckets(rows, max_bucket), "buckets")
    signed = rows.select("id", "n_shingles", "sig")
    # The centre of each bucket; a large one has some, of parts dealt by a hash.
    part = F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("n") / F.lit(max_bucket)).cast("long"))
    parted = buckets.select(F.xxhash64("bucket", part).alias("bucket"), "id")
    first = _in_shards(parted.join(signed, "id"), buckets.count(), SHARD_ROWS).groupBy("shard").applyInArrow(_star(percent, miss), "a long, b long").distinct()
    inside = classes.select(*own, "id").join(buckets.select("id").distinct(), "id")
    texts = tables.write(docs.join(inside, own).dropDuplicates(["id"]).select("id", "text"), "texts")
    first = tables.write(first, "pairs")
    links = tables.write(_verified(first, texts, shingle, percent), "links")
    # What is left open: buckets with several components.
    labelled = buckets.join(connected_components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
    unsettled = tables.write(labelled.join(open_, "bucket", "left_semi"), "unsettled")
    units = tables.write(_units(unsettled, block), "units")
    tables.drop("buckets")
    # Signatures first; sets go only to units where pairs have survived, and only those of the members that have.
    kept = "bucket long, side int, id long, component long, n_shingles long, sig binary"
    alive = _in_shards(units.join(signed, "id").select("bucket", "side", "id", "component", "n_shingles", "sig"), units.count(), 4 * block)
    alive = tables.write(alive.groupBy("shard").applyInArrow(_across(percent, miss, False), kept), "alive")
    sets = _hashes(texts.join(alive.select("id").distinct(), "id", "left_semi"), shingle)
    more = _in_shards(alive.join(sets, "id"), alive.count(), block).groupBy("shard").applyInArrow(_across(percent, miss, True), "a long, b long").distinct()
    more = tables.write(more.join(first, ["a", "b"], "left_anti"), "more")
    links = tables.write(links.unionByName(_verified(more, texts, shingle, percent)), "all-links")
    linked = tables.write(classes.select("id", F.struct(*own).alias("own")).join(connected_components(links), "id"), "linked")
    heads = tables.write(linked.groupBy("component").agg(F.min("own").alias("head")), "heads")
    headed = linked.join(heads, "component").select("id", "head")
    named = classes.join(headed, "id", "left").select(*keys, F.coalesce("head", F.struct(*own)).alias("head"))
    with_sets = some.select(*own, *keys).join(tables.write(named, "named", keep=True), keys)
    out = with_sets.select(*own, "n_shingles", "head").unionByName(keyed.filter("n_shingles = 0").select(*own, "n_shingles", F.struct(*own).alias("head")))
    real = lambda at: F.when(F.col(f"{at}none") == 0, F.col(f"{at}doc_id"))
    return out.select(real("").alias("doc_id"), "n_shingles", real("head.").alias("component_id"), real("").eqNullSafe(real("head.")).alias("kept"), "h1", "h2", (F.struct(*own) == F.col("head")).alias("stays"))


def _in_shards(rows: DataFrame, n_rows: int, per_shard: int) -> DataFrame:
    """Rows and the shard each is in: some thousand rows, buckets whole, that one call of a kernel gets."""
    n = max(partitions(rows.sparkSession), n_rows // per_shard)
    return rows.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(n)))


def _units(members: DataFrame, block: int) -> DataFrame:
    """bucket, id, component to bucket (a unit's number), side, id, component: all pairs of blocks that may hold a pair across components.

    A bucket's components of over `block` members have blocks of their own; the others are dealt to blocks whole.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    small = F.sum(F.when(F.col("size") <= block, F.col("size")).otherwise(0)).alias("small")
    sizes = sizes.join(sizes.groupBy("bucket").agg(small), "bucket")
    dealt = members.join(sizes, ["bucket", "component"])
    pure = F.col("size") > block
    salt = F.when(pure, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block).cast("long"))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("small") / block).cast("long")))
    dealt = dealt.select("bucket", "id", "component", F.when(pure, F.col("component")).alias("whole"), salt.alias("salt"))
    blocks = dealt.groupBy("bucket", "whole", "salt").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    blocks = blocks.select("bucket", F.struct("whole", "salt").alias("x"), "lo", "hi")
    other = blocks.select("bucket", F.col("x").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    # Of two blocks, each may hold one component only, the same one.
    pairs = blocks.join(other, "bucket").filter("x <= y and not (lo = hi and lo_y = hi_y and lo = lo_y)")
    unit = F.xxhash64("bucket", "x", "y").alias("unit")
    left = pairs.select("bucket", unit, F.lit(0).alias("side"), F.col("x.*"))
    right = pairs.filter("x != y").select("bucket", unit, F.lit(1).alias("side"), F.col("y.*"))
    asked = left.unionByName(right)
    same = [dealt[k].eqNullSafe(asked[k]) for k in ("bucket", "whole", "salt")]
    return dealt.join(asked, same).select(asked["unit"].alias("bucket"), "side", "id", "component")


def _buckets(rows: DataFrame, max_bucket: int) -> DataFrame:
    """bucket, id, n: members of all band keys that at least two classes have, and how many; oversized ones are dealt again, by short bands of the other values too."""
    keyed = rows.select("id", F.posexplode("bands").alias("pos", "bucket"))
    count = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    placed = keyed.join(count, "bucket")
    fine = placed.filter(F.col("n") <= max_bucket).select("bucket", "id", "n")
    over = placed.filter(F.col("n") > max_bucket).select(F.col("bucket").alias("own"), "pos", "id")
    short = F.explode(F.sequence(F.lit(0), F.lit(BANDS * ROWS // SHORT - 1))).alias("short")
    again = over.join(rows.select("id", "sig"), "id").select("id", "own", "pos", "sig", short)
    # Values that the whole bucket has in common part nothing.
    again = again.filter((F.col("short") * SHORT >= (F.col("pos") + 1) * ROWS) | ((F.col("short") + 1) * SHORT <= F.col("pos") * ROWS))
    again = again.select(F.xxhash64("own", "short", F.col("sig").substr(F.col("short") * SHORT + 1, F.lit(SHORT))).alias("bucket"), "id")
    twice = again.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return fine.unionByName(again.join(twice, "bucket").select("bucket", "id", "n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))


NAME = "op10_near_dedup"
