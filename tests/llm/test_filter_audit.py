import random
from itertools import permutations

import duckdb
import numpy as np
import pytest
from brute import BLANK
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverstone.llm import filter_audit as op

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def plain_fails(rows):
    """Failed filters of each row (doc_id, part, text)."""
    ids = {}
    for d, _, t in rows:
        ids.setdefault(t or "", []).append((d is None, d or 0))
    out = []
    for d, _, t in rows:
        t = t or ""
        w = [x for x in BLANK.split(t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": min(ids[t]) < (d is None, d or 0)}
        out.append({k for k, v in fails.items() if v})
    return out


def brute(rows, labels):
    fails = plain_fails(rows)
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    out = []
    for part in {p or "" for _, p, _ in rows}:
        own = [(d, f) for (d, p, _), f in zip(rows, fails, strict=True) if (p or "") == part]
        made, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                failing = [f for _, f in own if x in f]
                made.append((part, "".join(order), k + 1, len(left), len(gone), len(failing) - len(gone), sum(f == {x} for f in failing), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x))
        out += [(*m[:-1], shapley[m[-1]]) for m in made]
    return sorted(out)


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, 1) for d, p, t in rows], "doc_id long, text string, source string, flags int")
    return docs, spark.createDataFrame(labels, LABELS)


def some_rows(n=240):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(rng.choice([20, 2000]))}" for _ in range(rng.choice([0, 3, 199, 200, 260]))]
        text = " ".join(w.upper() if rng.random() < 0.05 else w for w in words) + rng.choice(["", " 100%", " é\x0bÜ", "\n"])
        rows.append((k, rng.choice(["hot", "hot", "b", None, ""]), text))
    rows += [(n + k, rng.choice(["hot", "c"]), rows[rng.randrange(60)][2]) for k in range(80)]
    rows += [(3, "b", rows[3][2]), (3, "b", "another text"), (None, "hot", rows[5][2]), (None, "c", None), (None, "c", ""), (900, "only nulls", None), (901, "a", "x " * 100_000)]
    return rows


def test_cases(spark):
    rows = some_rows()
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 300, 3)] + [(3, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 1), (5000, 1, 1)]
    docs, known = tables(spark, rows, labels)
    assert sorted(map(tuple, op.audit(docs.repartition(7), known).collect())) == brute(rows, labels)


def test_empty(spark):
    docs, known = tables(spark, [], [])
    assert op.audit(docs, known).count() == 0
    docs, known = tables(spark, [(1, None, None)], [])
    found = op.audit(docs, known).collect()
    assert len(found) == 600 and {r.removed for r in found} == {0, 1} and {r.part for r in found} == {""}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_bitmaps(n):
    flags = np.random.default_rng(n).integers(0, 128, n).astype(np.uint8)
    maps = op.Bitmaps(flags)
    for subset in range(op.SUBSETS):
        left = flags[flags & subset == 0]
        gone, removed = maps.counts(subset)
        assert gone == n - len(left)
        for f in range(op.N):
            own = left[left >> f & 1 == 1] if not subset >> f & 1 else left[:0]
            assert removed[:, f].tolist() == [len(own), (own >> op.GOOD & 1).sum(), (own >> op.TOXIC & 1).sum()]


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(op.ORACLE_SQL)
    found = op.query(spark, sf)
    assert found.columns == want.columns and [t for _, t in found.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_parts_are_spread(spark):
    """One part's documents are counted in many tasks, a few rows each."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    own = op.flagged(docs.repartition(8)).select("part", F.col("flags").cast("int").alias("flags"))
    assert op.subset_counts(own).agg(F.sum("n")).first()[0] == 2000
