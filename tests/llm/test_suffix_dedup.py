import random

import numpy as np
import pytest
from brute import repeats
from pyspark.sql import functions as F

from riverstone.llm import suffix_dedup as op
from riverstone.llm.common import read_table


def summary(found):
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return [tuple(r) for r in found.select("doc_id", "n_bytes", gone, F.size("spans"), "kept_sha256").collect()]


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    want = sorted((d, *x) for (d, _), x in zip(rows, repeats(rows), strict=True))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.query(spark, sf).collect())
    assert got == want
    assert sum(w[2] for w in want) > 1000


def noise(rng, n, letters="abcdefgh é\n"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize(("size", "limit", "hot"), [(40, op.MAX_GROUP, op.HOT), (40, 2, 3), (400, op.MAX_GROUP, op.HOT), (12, 1000, 3)])
def test_planted(spark, documents, monkeypatch, size, limit, hot):
    """Copies, passages with other surroundings, overlaps, passages shorter than a block, periodic texts, repeats inside a document."""
    monkeypatch.setattr(op, "HOT", hot)
    rng = random.Random(size)
    parts = [noise(rng, rng.randrange(size, 3 * size)) for _ in range(8)]
    rows = []
    for k in range(120):
        body = [noise(rng, rng.randrange(2, 2 * size)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(parts)
            a = rng.randrange(len(p) // 2)
            body.insert(rng.randrange(len(body) + 1), p[a : a + rng.randrange(size // 2, len(p))])
        rows.append((k, "".join(body)))
    rows += [(200, rows[0][1]), (201, "ab" * size), (202, "ab" * (size // 2)), (203, "xyz" * size), (204, None), (205, ""), (206, parts[0]), (207, "é" * (size // 2)), (208, "é" * size), (None, noise(rng, 3 * size)), (209, parts[1] + parts[1])]
    rows += [(300 + k, noise(rng, size) + parts[2] + noise(rng, size)) for k in range(60)]
    rows += [(1, rows[1][1]), (2, "other " + noise(rng, size))]
    found = op.suffix_dedup(documents(rows).withColumn("th", F.lit(1)).withColumn("ranges", F.lit(1)), size, limit)
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(summary(found), key=key) == sorted(((d, *x) for (d, _), x in zip(rows, repeats(rows, size), strict=True)), key=key)


def test_dealt_join(spark, monkeypatch):
    """A hot key's rows go to several tasks, and each row meets its key once."""
    monkeypatch.setattr(op, "HOT", 10)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("key"))
    keys = rows.groupBy("key").agg(F.count("*").alias("n")).filter("key <> 7")
    found = op.dealt_join(rows, keys, ["key"], "n", ["id"])
    want = rows.filter("key <> 7")
    assert sorted(found.select("id", "key").collect()) == sorted(want.collect())
    assert sorted(op.dealt_join(rows, keys, ["key"], "n", ["id"], "left_semi").select("id", "key").collect()) == sorted(want.collect())


def test_empty(spark, documents):
    assert op.suffix_dedup(documents([])).count() == 0
    assert summary(op.suffix_dedup(documents([(1, None), (2, "short")])))[0][2] == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 40))) for _ in range(k)]
        out = list(op.LoserTree([op.front_coded(r) for r in runs]))
        assert [s for _, s, _, _ in out] == sorted(s for r in runs for s in r)
        assert all(runs[r][i] == s for _, s, r, i in out)
        for (_, a, _, _), (n, b, _, _) in zip(out, out[1:], strict=False):
            assert n == op.common_prefix(a, b)


def test_groups_against_pairs():
    """Ranges by suffix intervals cover what all pairs of suffixes give."""
    rng = random.Random(2)
    for size, letters in ((10, b"xy"), (14, b"xxy"), (9, b"x")):
        rows = sorted((b"G" * 5 + bytes(rng.choice(letters) for _ in range(rng.randrange(0, 9))), bytes(rng.choice(letters) for _ in range(rng.randrange(0, 15))), rng.random() < 0.7) for _ in range(80))
        shared = [0] + [op.common_prefix(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
        want = [[] for _ in rows]
        for i, (right, left, is_open) in enumerate(rows):
            for j, (r, x, _) in enumerate(rows):
                n, m = op.common_prefix(right, r), op.common_prefix(left[::-1], x[::-1])
                if i != j and is_open and n + m >= size:
                    want[i].append((-m, n))
        got = op.repeated_in_group([r[1] for r in rows], shared, [r[2] for r in rows], size)
        assert got == [op.merged(x) for x in want] and any(got)


def test_one_passage_in_many_surroundings(spark, documents):
    """A gram with more classes than a group may have is parted by the bytes on both sides; nothing is lost, and no group is over the bound."""
    rng = random.Random(4)
    passage = noise(rng, 60)
    rows = []
    for k in range(300):
        a, b = rng.randrange(0, 30), rng.randrange(30, 61)
        rows.append((k, noise(rng, rng.randrange(30, 60), "uvw") + passage[a:b] + noise(rng, rng.randrange(30, 60), "xyz")))
    for limit in (10, 1):
        found = op.suffix_dedup(documents(rows), 24, limit)
        assert sorted(summary(found)) == sorted((d, *x) for (d, _), x in zip(rows, repeats(rows, 24), strict=True))


def test_a_very_long_text(spark, documents):
    rng = random.Random(6)
    long = noise(rng, 1_500_000, "abcdefgh")
    rows = [(1, long), (2, "start " + long[700_000:900_000] + " end"), (3, noise(rng, 1000))]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in op.suffix_dedup(documents(rows)).collect()}
    assert got == {1: [(700_000, 900_000)], 2: [(6, 200_006)], 3: []}


def test_blocks_that_polynomial_hashes_confuse(spark, documents):
    """Two documents of Thue-Morse letters and their complement, alike to a polynomial hash modulo 2**64, have no common strings of this size."""
    t = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    rows = [(1, "start " + t + " end"), (2, "start " + t.translate({97: "b", 98: "a"}) + " end"), (3, t[:1500] + "x")]
    found = op.suffix_dedup(documents(rows), 1024)
    assert sorted(summary(found)) == sorted((d, *x) for (d, _), x in zip(rows, repeats(rows, 1024), strict=True))


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 7, 100, 500):
        assert (op.sliding_least(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def test_repeated_rows_give_their_ranges_once(spark, documents):
    rng = random.Random(8)
    text = noise(rng, 3000, "abcdefgh")
    rows = [(None, text)] * 400 + [(1, "start " + text[500:1700])]
    docs = documents(rows).select("doc_id", F.xxhash64("text").alias("th"), "text")
    per_doc = op.ranges_of(op.repeated_ranges(docs))
    found = {r.doc_id: r.ranges for r in per_doc.collect()}
    assert all(len(x) == len({tuple(y) for y in x}) for x in found.values()) and len(found[None]) < 60
    assert sorted(map(str, summary(op.suffix_dedup(documents(rows))))) == sorted(str((d, *x)) for (d, _), x in zip(rows, repeats(rows), strict=True))


def test_all_that_is_removed_comes_through_the_merge(spark, sf, monkeypatch):
    """Without what the merge of runs finds, nothing is removed, of whole copies neither; its own ranges are of one member of each class."""
    docs = read_table(spark, sf.replace("0.001", "0.01"), "documents")
    whole = op.suffix_dedup(docs, keep_bytes=False)
    assert sum(r[2] for r in summary(whole)) > 400_000
    merge = op._merge

    def emptied(size):
        run = merge(size)
        return lambda key, table: run(key, table).slice(0, 0)

    monkeypatch.setattr(op, "_merge", emptied)
    assert sum(r[2] for r in summary(op.suffix_dedup(docs, keep_bytes=False))) == 0


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, documents):
    """Two documents share 56 words: in 399 bytes they stay, in 400 they go, and n_bytes is the length of the text either way."""
    rng = random.Random(9)
    rows, want = [], {}
    for k, end in ((1, ""), (3, ".")):
        passage = "".join(" " + noise(rng, 6, "abcdefgh") for _ in range(57)) + end
        rows += [(k, noise(rng, 500, "uvw") + passage + noise(rng, 500, "uvw")), (k + 1, noise(rng, 500, "xyz") + passage + noise(rng, 500, "xyz"))]
        want |= {d: (1000 + len(passage), 400 if end else 0) for d in (k, k + 1)}
    assert {d: (n, gone) for d, n, gone, _, _ in summary(op.suffix_dedup(documents(rows)))} == want == {1: (1399, 0), 2: (1399, 0), 3: (1400, 400), 4: (1400, 400)}
