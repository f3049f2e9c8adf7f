import random

import numpy as np
import pytest
from brute import near
from pyspark.sql import functions as F

from riverstone.llm import near_dedup as op
from riverstone.llm.common import read_table
from riverstone.llm.components import connected_components


def compare(found, docs):
    want = near(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return want


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    want = compare(op.query(spark, sf).collect(), docs)
    assert sum(d != c for d, (_, c) in want.items()) > 3


def edited(rng, base, share):
    return " ".join(f"q{rng.randrange(10**6)}" if rng.random() < share else w for w in base)


@pytest.mark.parametrize(("limit", "block"), [(op.MAX_BUCKET, op.BLOCK), (op.MAX_BUCKET, 8), (20, 8)])
def test_groups_of_near_copies(spark, documents, limit, block):
    """Copies near a base at many distances, documents that share a passage, and a chain, against all pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(k, edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03, 0.04]))) for k in range(150)]
    passage = " ".join(f"p{rng.randrange(5000)}" for _ in range(150))
    rows += [(200 + k, passage + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(150))) for k in range(60)]
    chain = [f"c{k}" for k in range(400)]
    rows += [(300 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(30)]
    rows += [(400, "a b c"), (401, "A  b\nC"), (402, "a b"), (403, None), (404, ""), (405, " \t "), (406, "a b c")]
    found = op.near_groups(documents(rows), max_bucket=limit, block=block).collect()
    compare(found, dict(rows))


def test_cases(spark, documents):
    assert op.near_groups(documents([])).count() == 0
    rows = [(5, "x y z"), (5, "x y z"), (2, "x y z"), (None, "x y z"), (None, "other"), (9, "word " * 50000)]
    more = documents(rows).withColumn("id", F.lit(1)).withColumn("bucket", F.lit("b"))
    got = sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles, r.kept) for r in op.near_groups(more).collect())
    assert [g for g in got if g[0] >= 0] == [(2, 2, 3 if False else 1, True), (5, 2, 1, False), (5, 2, 1, False), (9, 9, 1, True)]


def test_kept_is_told_by_ids(spark, documents):
    """Rows of the smallest id are kept whatever their texts; the largest number is an id, and null comes after it."""
    words = " ".join(f"w{k}" for k in range(100))
    last = (1 << 63) - 1
    rows = [(1, words), (1, words + " x"), (2, words + " x y"), (last, "another text of some words"), (None, "another text of some words"), (None, "alone")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in op.near_groups(documents(rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (last, last, True), (None, last, False), (None, None, True)], key=str)
    assert sum(r.stays for r in op.near_rows(documents(rows)).collect()) == 3


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_pruning_bound():
    """Of pairs at the threshold, far fewer than asked for are dropped by any batch."""
    n = op.BANDS * op.ROWS
    matches = np.random.default_rng(1).random((200_000, n)) < 0.75
    need = [(b, op.least_matches(b, 0.75, 1e-3)) for b in range(op.BATCH, n + 1, op.BATCH)]
    dropped = np.zeros(len(matches), bool)
    for b, least in need:
        dropped |= matches[:, :b].sum(axis=1) < least
    assert dropped.mean() < 6e-3


def text_of(word, first, n=40):
    return " ".join(f"{word}{k}" for k in range(first, first + n))


def test_rows_under_one_key(spark, documents):
    """Different texts under a null or repeated doc_id are judged each by itself, and link what lies on both their sides."""
    chain = [text_of("c", k) for k in (0, 4, 8)]
    rows = [(1, text_of("a", 0)), (None, text_of("a", 1)), (None, text_of("b", 0)), (None, text_of("b", 1)), (None, text_of("d", 0)), (None, "")]
    rows += [(7, chain[1]), (7, text_of("e", 0)), (7, text_of("e", 0)), (7, text_of("A", 0)), (3, chain[0]), (9, chain[2]), (8, text_of("e", 1)), (7, text_of("E", 0))]
    texts = [t for _, t in rows]
    want = near({k: t for k, t in enumerate(texts)})
    last = lambda d: (1 << 63) - 1 if d is None else d
    least = {}
    for k, (_, c) in want.items():
        least[c] = min(least.get(c, last(None)), last(rows[k][0]))
    hashed = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", *op.text_hashes(F.col("text"))).collect()
    by_hash = {}
    for r in hashed:
        by_hash.setdefault((last(rows[r.k][0]), r.h1, r.h2), []).append(r.k)
    found = op.near_rows(documents(rows)).collect()
    assert len(found) == len(rows)
    kept = {}
    for r in found:
        k = by_hash[last(r.doc_id), r.h1, r.h2][0]
        assert (r.n_shingles, last(r.component_id)) == (want[k][0], least[want[k][1]]), rows[k]
        if r.stays:
            kept.setdefault(want[k][1], set()).add((last(r.doc_id), r.h1, r.h2))
    assert {c: {(d) for d, _, _ in v} for c, v in kept.items()} == {c: {d} for c, d in least.items()}
    assert all(len(v) == 1 for v in kept.values())
    assert {least[want[k][1]] for k in (6, 10, 11)} == {3}
    assert op.near_groups(documents(rows)).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_pairs_with_one_band_in_an_oversized_bucket(spark):
    """Dealing an oversized bucket again doesn't part pairs at 0.75 whose only common band is the bucket's."""
    rng = np.random.default_rng(7)
    rows, n = [], 40
    for k in range(n):
        one = rng.integers(0, 1 << 32, op.BANDS * op.ROWS, dtype=np.uint32)
        one[:5] = 1
        other = one.copy()
        for band in range(1, op.BANDS):
            gone = rng.random(op.ROWS) < 0.25
            gone[rng.integers(op.ROWS)] |= not gone.any()
            other[band * op.ROWS : (band + 1) * op.ROWS][gone] += 1
        for i, s in enumerate((one, other)):
            rows.append((2 * k + i, bytearray(s.astype(np.uint8).tobytes()), op.band_keys(s[None])[0].tolist()))
        assert len(set(rows[-1][2]) & set(rows[-2][2])) == 1
    found = op._buckets(spark.createDataFrame(rows, "id long, sig binary, bands array<long>"), 20).collect()
    held = {}
    for r in found:
        held.setdefault(r.bucket, set()).add(r.id)
    assert all(any({2 * k, 2 * k + 1} <= v for v in held.values()) for k in range(n))
    assert max(len(v) for v in held.values()) < 10


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomial_hashes_confuse(spark, documents):
    one, other = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rows = [(1, one), (2, other), (3, f"{one} x y z u v"), (4, f"{other} x y z u v")]
    compare(op.near_groups(documents(rows)).collect(), dict(rows))


def shingles_of(texts, check=True):
    raw = [t.encode() for t in texts]
    return op.Shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), check=check)


def test_equal_hashes_dont_decide(monkeypatch):
    """Common shingles are counted by their bytes, with hashes that collide within and across texts too."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(30)]
    exact = [op.shingle_words(t.encode(), 5) for t in texts]
    for kinds in (1 << 40, 2, 1):
        monkeypatch.setattr(op, "segment_hashes", lambda data, begin, end, kinds=kinds: data[begin].astype("u8") % kinds)
        s = shingles_of(texts)
        assert s.clean or kinds < 3
        assert all(op._common(s, i, s, j, 5) == len(exact[i] & exact[j]) for i in range(30) for j in range(30))


def test_a_very_long_text(spark, documents):
    rng = random.Random(5)
    long = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-50_000])), (3, " ".join(long[:200_000])), (4, "short one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_groups(documents(rows)).collect()}
    assert got == {1: (399_996, 1), 2: (349_996, 1), 3: (199_996, 3), 4: (1, 4)}


def test_a_bucket_of_many_documents_is_parted(spark):
    """All pairs across components are in some unit, and no unit has many more members than two blocks."""
    rng = random.Random(9)
    members = [(7, i, i % 3 if i < 300 else 1000 + i) for i in range(500)] + [(8, i, 5 if i < 40 else 6) for i in range(50)]
    held = {}
    for r in op._units(spark.createDataFrame(members, "bucket long, id long, component long"), 20).collect():
        held.setdefault(r.bucket, []).append((r.side, r.id, r.component))
    seen = set()
    for rows in held.values():
        two = any(s for s, _, _ in rows)
        seen |= {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows if x[2] != y[2] and (not two or x[0] < y[0])}
    own = {i: c for b, i, c in members if b == 7}
    assert all((i, j) in seen for i, j in (rng.sample(range(500), 2) for _ in range(2000)) if i < j and own[i] != own[j])
    assert max(map(len, held.values())) < 80
