"""Quality by nearest-neighbour voting: every document against all labelled latent-semantic vectors.

A text is counted in two blocks: its words (hashed, in lower case), and hashed n-grams of its shape (runs of small letters, capitals,
digits, and each other sign) with a few measures of repetition (how few of its words and lines are distinct, how common its commonest word
is), in steps. TF-IDF of each block, with document frequencies over all documents, and a truncated SVD of both fitted on the labelled
sample give latent vectors. Each document's cosines with all labelled vectors are computed exactly, block by block; its `k` nearest vote
with weight max(0, cosine) ** `power`. Cosines are taken to six digits; of equally near vectors those that come first in the order of the
model's (labels, then the places of what isn't zero, then the values) vote, and a text's cosines don't depend on the texts beside it.

Labels are learned from at most `sample` different texts of different ids, chosen by a hash, however many rows repeat them. Defined cases. Null counts as empty; empty texts get the score of their
(zero) vector: the share of label 1 in the sample. Labels that are null, or whose document is missing, are not learned from; rows with a
null doc_id are held out. Without labels every score is 0.5. Rows that repeat a doc_id are judged row by row. Other columns are ignored.
Texts are counted whole: the memory of a task grows with its longest text, to about a hundred times its bytes.

At scale. Two passes over the text and no shuffle of it; the labelled vectors (sample x 64 floats) and the projection are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import bounded_batches, bytes_of, read_table, row_slices
from riverstone.llm.features import add_ngrams, document_frequencies, hash_share, inverse_frequencies, normalised_rows, tf_idf
from riverstone.llm.hashing import segment_hashes

DIMS_LOG2 = 10
STEPS = 8
MEASURES = 4
SHAPE_DIMS = (1 << DIMS_LOG2) + STEPS * MEASURES
WORDS_LOG2 = 12
DIMS = SHAPE_DIMS + (1 << WORDS_LOG2)
RANK = 64
SAMPLE = 4000
NEIGHBOURS = 35
POWER = 2
ACCEPT = 0.7
#: Rows of a block of cosines, and digits of a cosine that count.
ROWS = 64
DIGITS = 6
_SHAPE = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_NO_LETTER = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x2E]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _collapsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes with runs of the same sign cut to one."""
    shape = _SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    return shape[new], np.r_[0, np.cumsum(new)][offsets]


def _runs(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs that no separator and no end of a text interrupts, and the text of each."""
    starts, ends = ~separator, ~separator
    starts[1:] &= separator[:-1]
    ends[:-1] &= separator[1:]
    first, last = offsets[:-1][offsets[:-1] < len(separator)], offsets[1:][offsets[1:] > 0] - 1
    starts[first], ends[last] = ~separator[first], ~separator[last]
    a = np.flatnonzero(starts)
    return a, np.flatnonzero(ends) + 1, np.searchsorted(offsets, a, side="right") - 1


def _repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's measures, 0 to 1: distinct words, distinct lines or sentences, share of the commonest word, length."""
    n = len(offsets) - 1
    out = np.zeros((n, MEASURES))
    out[:, 3] = np.minimum(1, np.log2(1 + np.diff(offsets)) / 20)
    for col, separator in ((0, _BLANK), (1, _STOP)):
        a, b, doc = _runs(separator[data], offsets)
        if not len(a):
            continue
        key = segment_hashes(data, a, b)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        at = np.flatnonzero(new)
        times = np.diff(np.r_[at, len(key)])
        words = np.bincount(doc, minlength=n)
        out[:, col] = np.bincount(doc[at], minlength=n) / np.maximum(words, 1)
        if col == 0:
            most = np.zeros(n)
            np.maximum.at(most, doc[at], times)
            out[:, 2] = most / np.maximum(words, 1)
    return out


def count_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of both blocks, in shares of a hundred, so that long and short texts of one kind are alike."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)
    grams = np.zeros((n, 1 << DIMS_LOG2), np.float32)
    shape, at = _collapsed(data, offsets)
    add_ngrams(grams, shape, at, (1, 2, 3, 4), DIMS_LOG2)
    out[:, : 1 << DIMS_LOG2] = 100 * grams / np.maximum(grams.sum(axis=1, keepdims=True), 1)
    step = np.minimum((_repetition(data, offsets) * STEPS).astype(int), STEPS - 1)
    full = np.flatnonzero(np.diff(offsets))
    for m in range(MEASURES):
        out[full, (1 << DIMS_LOG2) + STEPS * m + step[full, m]] = 20
    low = _LOWER[data]
    a, b, doc = _runs(_NO_LETTER[low], offsets)
    if len(a):
        slot = (segment_hashes(low, a, b) >> np.uint64(64 - WORDS_LOG2)).astype(np.int64)
        words = np.bincount((doc << WORDS_LOG2) + slot, minlength=n << WORDS_LOG2).reshape(n, -1)
        out[:, SHAPE_DIMS:] = 100 * words / np.maximum(words.sum(axis=1, keepdims=True), 1)
    return out


def vectors_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows, in which both blocks have the same length."""
    cut = SHAPE_DIMS
    return normalised_rows(np.concatenate([tf_idf(counts[:, :cut], idf[:cut]), tf_idf(counts[:, cut:], idf[cut:])], axis=1))


def leading_axes(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    if not len(x):
        return np.zeros((x.shape[1], 0), np.float32)
    blocks = lambda: (x[i : i + 256].astype(np.float64) for i in range(0, len(x), 256))  # noqa: E731  # no second copy of x in doubles
    q = np.random.default_rng(11).standard_normal((x.shape[1], min(rank + 16, *x.shape)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(sum(b.T @ (b @ q) for b in blocks()))
    _, _, axes = np.linalg.svd(np.concatenate([b @ q for b in blocks()]), full_matrices=False)
    return (q @ axes.T)[:, :rank].astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, vectors: np.ndarray, labels: np.ndarray, rank: int = RANK, k: int = NEIGHBOURS, power: float = POWER):
        """vectors: vectors_of() the labelled sample."""
        self.idf, self.labels, self.k, self.power = idf, labels.astype(np.float32), k, power
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.axes = leading_axes(vectors, rank)
        self.latent = normalised_rows(vectors @ self.axes)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Of unit rows with the labelled vectors, in blocks of one size: products of other sizes may round otherwise."""
        full = np.zeros((-(-len(x) // ROWS) * ROWS, x.shape[1]), np.float32)
        full[: len(x)] = x
        return np.concatenate([full[i : i + ROWS] @ self.latent.T for i in range(0, len(full), ROWS)])[: len(x)]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.labels):
            return np.full(n, self.base)
        x = normalised_rows(vectors_of(count_features(data, offsets), self.idf) @ self.axes)
        cosine = np.round(self.cosines(x), DIGITS)
        k = min(self.k, len(self.labels))
        # All that are nearer than the k-th, and of its equals the first ones.
        edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        nearer = cosine > edge
        equal = cosine == edge
        chosen = nearer | (equal & (np.cumsum(equal, axis=1) <= k - nearer.sum(axis=1, keepdims=True)))
        near = np.nonzero(chosen)[1].reshape(n, k)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** self.power
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, vote, self.base), 0, 1).astype(np.float64)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    bounded_batches(documents.sparkSession)
    n, df = document_frequencies(documents.select("text"), count_features, DIMS)
    idf = inverse_frequencies(n, df)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).distinct()
    share = hash_share("doc_id")  # only rows under a bound that about twice as many are under are ranked
    chosen = known.filter(share < (2 * sample + 20) / max(1, known.count())).orderBy(share, "doc_id", "quality").limit(sample)  # the documented bound, broadcast
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    one = ["doc_id", "th", "quality"]
    # An id may have any number of rows and of texts: of its different texts, as many as the bound leaves.
    different = texts.select("doc_id", "th").join(F.broadcast(chosen), "doc_id").select(*one).distinct()
    taken = different.orderBy(hash_share("doc_id"), F.xxhash64("doc_id", "th"), *one).limit(sample)
    rows = texts.join(F.broadcast(taken), ["doc_id", "th"]).dropDuplicates(one).select("quality", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 1, max_bytes=1 << 20, max_rows=256):
            x = vectors_of(count_features(*bytes_of(b.column(1))), idf).astype(np.float32)
            places = [np.flatnonzero(r) for r in x]
            yield pa.record_batch([b.column(0), pa.array([p.astype(np.uint16).tobytes() for p in places], pa.binary()), pa.array([r[p].tobytes() for r, p in zip(x, places, strict=True)], pa.binary())], ["quality", "places", "values"])

    found = sorted(rows.mapInArrow(kernel, "quality int, places binary, values binary").collect())  # at most `sample` vectors, without their zeros
    x = np.zeros((len(found), DIMS), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r.places, np.uint16)] = np.frombuffer(r["values"], np.float32)
    return Model(idf, x, np.array([r.quality for r in found], float))


def score_quality(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and quality_score of each row."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 1, max_bytes=1 << 20, max_rows=256):
            yield pa.record_batch([b.column(0), pa.array(shared.value.score(*bytes_of(b.column(1))))], ["doc_id", "quality_score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, quality_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_quality(docs, train(docs, read_table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


NAME = "op6_quality"
