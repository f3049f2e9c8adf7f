import hashlib
import random

import pytest
from brute import leaks
from pyspark.sql import functions as F

from riverstone.llm import decontamination as op
from riverstone.llm.common import read_table


def result(found):
    rows = found.select("doc_id", "n_words", op.n_hit().alias("n_hit"), F.size("item_ids").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("sha")).collect()
    return {r[0]: (r[1], r[2], r[3], r[4], r[2] > 0) for r in rows}


def test_whole_table(spark, sf):
    docs, bench = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    want = leaks({r.doc_id: r.text for r in docs.collect()}, [(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op.query(spark, sf).collect()}
    assert got == want
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())


@pytest.mark.parametrize("scan_bytes", [op.SCAN_BYTES, 60])
def test_cases(spark, documents, scan_bytes):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "..."), (4, "One, two THREE!"), (5, "x one two three one two three y"), (6, f"é {long} é"), (7, f"é {long.upper()} é"), (8, "w1 w2 w3"), (9, "ünë dëux"), (10, "one  \n two\x00three")]
    items = [(1, "one two three"), (2, long), (3, None), (4, "--"), (5, "ONE TWO THREE"), (12, "Ünë Dëux"), (13, "ünë dëux")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks(dict(rows), items)
    found = op.decontaminate(documents(rows), bench, scan_bytes=scan_bytes)
    assert result(found) == want
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found.collect()}
    assert spans[4] == [(0, 14)] and spans[5] == [(2, 29)] and spans[6] == [(2, 2 + len(long))]


def test_empty_tables_and_more_columns(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.decontaminate(documents([]), none).count() == 0
    more = documents([(1, "a b")]).withColumn("spans", F.lit(1)).withColumn("n_words", F.lit("x"))
    row = op.decontaminate(more, none).first()
    assert (row.n_words, row.spans, row.item_ids) == (2, [], [])


@pytest.mark.parametrize("size", [1, 2, 3, 10])
def test_random_texts_of_few_words(size):
    """Windows that overlap, repeat within and across items, and lie at all offsets, against all windows one by one."""
    rng = random.Random(size)
    text = lambda n, words="ab": " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    for words in ("ab", "abcdefgh"):
        items = [(k, text(40, words)) for k in range(25)]
        docs = {k: text(200, words) for k in range(100)} | {200 + k: f"x {t} y" for k, (_, t) in enumerate(items)}
        machine = op.Automaton([(str(i), t.encode()) for i, t in items], size)
        want = leaks(docs, items, size)
        for d, t in docs.items():
            n, spans, names = machine.scan(t.encode())
            sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert (n, sum(b - a for a, b, _, _ in spans), len(names), sha, bool(spans)) == want[d]


def test_a_large_benchmark_is_one_scan(spark, documents):
    """Ten thousand items, 6 MB: one automaton, found items are the planted ones."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(20_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=100))) for k in range(10_000)]
    assert len(list(op.in_scans(iter([(str(i), t.encode()) for i, t in items]), 10, op.SCAN_BYTES))) == 1
    rows = [(k, f"some text {' '.join(items[k * 97 % 10_000][1].split()[k : k + 10 + k % 3 - 1])} and more") for k in range(80)]
    found = op.decontaminate(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: list(r.item_ids) for r in found.collect()}
    assert got == {k: [str(k * 97 % 10_000)] if k % 3 else [] for k in range(80)}
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_items_are_cut_without_losing_windows(spark, documents):
    words = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(words[k : k + 10])) for k in range(0, 491, 7)] + [(1000, " ".join(words[3:12])), (1001, " ".join(words) * 3)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert result(op.decontaminate(documents(rows), bench, scan_bytes=300)) == leaks(dict(rows), [(1, " ".join(words))])


def test_a_very_long_text(spark, documents):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, "some words and " * 300_000 + item + " the end" * 100_000)]
    row = op.decontaminate(documents(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert row.n_words == 1_100_020 and [(s.first_word, s.end_word) for s in row.spans] == [(900_000, 900_020)]
