import numpy as np
from brute import pieces
from pyspark.sql import functions as F

from riverstone.llm import packing as op
from riverstone.llm.common import read_table


def check(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark, sf):
    docs = read_table(spark, sf, "documents").collect()
    rows = op.query(spark, sf).collect()
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = sorted(pieces([(r.doc_id, r.text) for r in docs]))
    assert got == want
    n = check(rows)
    assert n <= 1.02 * -(-sum(r[3] for r in want) // 4096) + 1


def test_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "It's <|endoftext|> x\x1cy z"), (5, "word " * 9000), (6, "É!!! don't, 123.4 é?"), (7, "the,the. the!! ..the &&& a&b")]
    found = op.packed(documents(rows).withColumn("piece", F.lit("x"))).collect()
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert got == sorted(pieces([(r[0] or -1, r[1]) for r in rows]))
    check(found)
    assert op.packed(documents([])).count() == 0


def test_ids(spark, documents):
    row = op.pieces_of(documents([(1, "the cat")]), with_ids=True).first()
    assert row.ids[-1] == 1 and len(row.ids) == row.length


def test_plan_is_whole_and_tight():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 4096, 3000), np.minimum(4095, rng.lognormal(6.5, 1, 5000).astype(int) + 1), np.full(1000, 1366), np.array([4095, 1]), np.array([2049] * 7 + [2047] * 5), rng.integers(1025, 1400, 500)):
        values, counts = np.unique(lengths, return_counts=True)
        bins = op.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        seen = {v: [] for v in values.tolist()}
        for b in bins:
            assert sum(x for x, _ in b.slots) + b.room == 4096 and b.room >= 0
            for length, first in b.slots:
                seen[length] += range(first, first + b.count)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            assert sorted(seen[v]) == list(range(c))
        n = sum(b.count for b in bins)
        bound = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()), -(-int((lengths > 1365).sum()) // 2) if (lengths > 1365).all() else 0, -(-int((lengths > 1024).sum()) // 3))
        assert n <= 1.03 * bound + 2
