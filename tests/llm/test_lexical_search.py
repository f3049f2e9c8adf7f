import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import lower
from pyspark.sql import functions as F

from riverstone.llm import lexical_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    """[(item_id, rank, doc_id, score)]; null ids come last among equals."""
    tfs = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    tfs = [(d, c) for d, c in tfs if c]
    total = sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tfs:
            m = 50 + 50 * sum(c.values()) * len(tfs) // total
            score = sum(math.floor(1000 * math.log((2 * len(tfs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(lower(text or ""))) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def same(found, docs, items, k):
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def some_docs(n, seed=1):
    rng = random.Random(seed)
    topics = [[f"t{t}x{j}" for j in range(60)] for t in range(12)]
    rows = [(k, " ".join(rng.choice(rng.choice([topics[k % 12], [f"c{j}" for j in range(30)]])) for _ in range(rng.choice([1, 5, 40, 120])))) for k in range(n)]
    rng.shuffle(rows)
    items = [(f"i{k}", " ".join(rng.choices(topics[k % 12], k=6) + rng.choices([f"c{j}" for j in range(30)], k=k % 4))) for k in range(30)]
    return rows, items


@pytest.mark.parametrize(("block", "shard", "visit_bytes", "first"), [(op.BLOCK, op.SHARD, op.VISIT_BYTES, op.FIRST), (100, 8, 20_000, 2), (64, 1, 4_000, 3)])
def test_ranks(spark, documents, block, shard, visit_bytes, first):
    docs, items = some_docs(700)
    docs += [(1000 + k, docs[k % 3][1]) for k in range(150)]  # copies: ties at every k
    found = op.search(documents(docs).repartition(5), spark.createDataFrame(items, "item_id string, text string"), 20, block, shard, 1 << 20, visit_bytes, first)
    same(found, docs, items, 20)


def test_cases(spark, documents):
    docs = [(5, "Red red BLUE_green"), (5, "red"), (2, "red"), (None, "red"), (None, None), (7, ""), (8, " \t-#"), (9, "blue " * 60_000 + "rot É é"), (10, "\x7fred\x00blue"), (11, "yellow 12"), ((1 << 63) - 1, "red")]
    items = [(1, "RED"), (1, "red blue red"), (2, None), (3, ""), (4, "nothing here"), (5, "É 12 green"), (None, "yellow"), (6, "-")]
    more = documents(docs).withColumn("n", F.lit(1)).withColumn("terms", F.lit("b")).withColumn("block", F.lit("c"))
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for query_bytes in (1 << 20, 1):  # all queries at once, and one at a time
        same(op.search(more, queries, query_bytes=query_bytes), docs, items, 50)
    assert op.search(documents([]), queries).count() == 0
    assert op.search(more, queries.limit(0)).count() == 0
    assert op.search(documents([(1, None)]), queries).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(op.ORACLE_SQL)
    found = op.query(spark, sf)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def log_gap(order, docs):
    """Mean log gap between the documents that share a term."""
    seen, gaps = {}, []
    for place, d in enumerate(order):
        for t in docs[d]:
            if t in seen:
                gaps.append(math.log2(place - seen[t] + 1))
            seen[t] = place
    return sum(gaps) / len(gaps)


def csr(docs):
    return np.array([t for d in docs for t in d], np.int32), np.cumsum([0] + [len(d) for d in docs])


def test_bisection_brings_documents_together():
    rng = random.Random(2)
    docs = [sorted(rng.sample(range(40 * (k % 8), 40 * (k % 8) + 40), 12)) for k in range(512)]
    order = op.bisected(*csr(docs), shard=16)
    assert sorted(order) == list(range(512))
    assert log_gap(order, docs) < log_gap(range(512), docs) - 1
    pure = [len({d % 8 for d in order[i : i + 16]}) for i in range(0, 512, 16)]
    assert sum(p == 1 for p in pure) > 20  # of 32 shards, which 16 neighbours by number would all mix
    assert op.bisected(*csr([[1], [], [1]]), shard=1).tolist() and len(op.bisected(*csr([]))) == 0


def searched(docs, items, order, shard, k):
    """A searcher over shards of this order, all of one task."""
    queries = op.Queries.of(items)
    number = queries.number
    lists = [[t for t in c if t in number] for c in (Counter(op.terms_of(t.encode())) for _, t in docs)]
    df = Counter(t for ts in lists for t in ts)
    queries.weight = op.weights(np.array([df[t] for t in number]), len(docs))
    rows = []
    for i in range(0, len(docs), shard):
        own = sorted((number[t], p) for p, d in enumerate(order[i : i + shard]) for t in lists[d])
        term, doc = (np.array(x, np.int32) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int32),) * 2
        used, first = np.unique(term, return_index=True)
        impact = np.full(len(term), 1000, np.int32)
        ids = np.array([docs[d][0] for d in order[i : i + shard]])
        rows.append({"docs": np.stack([ids, 0 * ids]).astype(np.int64).tobytes(), "terms": used.astype(np.int32).tobytes(), "most": impact[first].tobytes(), "edges": np.append(first, len(term)).astype(np.int32).tobytes(), "posting_doc": doc.tobytes(), "posting_impact": impact.tobytes()})
    s = op.Searcher(queries, k, np.zeros(queries.n, np.int64))
    s.visit(rows)
    return s


def test_few_shards_are_visited():
    """Bounds of reordered documents stop most visits, those of shuffled ones fewer; what is found is the same."""
    docs, items = some_docs(2000, 3)
    numbers = {t: k for k, t in enumerate(sorted({t for _, x in docs for t in x.split()}))}
    terms, at = csr([sorted({numbers[t] for t in x.split()}) for _, x in docs])
    near = searched(docs, items, op.bisected(terms, at, 16), 16, 10)
    far = searched(docs, items, list(range(len(docs))), 16, 10)
    assert near.found().equals(far.found())
    assert near.offered == far.offered and near.visited < 0.5 * near.offered and near.visited < 0.8 * far.visited
