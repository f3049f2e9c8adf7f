"""Hashed n-gram counts of whole texts, in numpy, and document frequencies over a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverstone.llm.common import bytes_of, row_slices

#: (bytes, offsets) of n texts to an n x dims array of counts.
Counter = Callable[[np.ndarray, np.ndarray], np.ndarray]
CHUNK = 1 << 18
_SALT = (0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def add_ngrams(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], dims_log2: int) -> None:
    """Adds counts of hashed byte n-grams that don't cross texts to out, n x 2**dims_log2; in pieces, so long texts take no more memory."""
    n, dims = len(offsets) - 1, 1 << dims_log2
    flat = out.reshape(-1)
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK + max(sizes) - 1].astype(np.uint32)
        doc = np.searchsorted(offsets, np.arange(at, min(at + CHUNK, len(data))), side="right") - 1
        room = offsets[doc + 1] - np.arange(at, at + len(doc))
        for size in sizes:
            m = min(len(doc), len(piece) - size + 1)
            if m <= 0:
                continue
            code = piece[:m].copy()
            for j in range(1, size):
                code |= piece[j : j + m] << np.uint32(8 * j)
            code = (code + np.uint32(size)) * np.uint32(_SALT[size])
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x2C1B3C6D)
            slot = (code >> np.uint32(32 - dims_log2)).astype(np.int64) + doc[:m] * dims
            whole = room[:m] >= size
            first, last = int(doc[0]), int(doc[-1])
            flat[first * dims : (last + 1) * dims] += np.bincount(slot[whole] - first * dims, minlength=(last - first + 1) * dims).astype(out.dtype)
    assert n * dims == len(flat)


def normalised_rows(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return normalised_rows(np.log1p(counts) * idf)


def document_frequencies(texts: DataFrame, counter: Counter, dims: int, max_rows: int = 256) -> tuple[int, np.ndarray]:
    """Number of documents and of those that have each feature; texts has one string column. Each task adds up its own."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(dims, np.int64)
        for b in row_slices(batches, 0, max_bytes=1 << 20, max_rows=max_rows):
            df += (counter(*bytes_of(b.column(0))) > 0).sum(axis=0)
            n += b.num_rows
        if n:
            yield pa.record_batch([pa.array(np.arange(-1, dims)), pa.array(np.r_[n, df])], ["slot", "n"])

    sums = texts.mapInArrow(kernel, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = dict(tuple(r) for r in sums.toLocalIterator())  # at most dims + 1 rows
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(dims)], np.float64)


def hash_share(key: str) -> Column:
    """A number in [0, 1) from a hash of a key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def inverse_frequencies(n: int, df: np.ndarray) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
