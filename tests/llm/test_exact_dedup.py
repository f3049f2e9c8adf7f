import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverstone.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    for (d, t), n in zip(rows, norm, strict=True):
        groups[n].append((-len(t or ""), (d is None, d or 0)))
    out = []
    for (d, _), n in zip(rows, norm, strict=True):
        none, keep = min(groups[n])[1]
        keep = None if none else keep
        out.append((d, keep, len(groups[n]), keep == d, hashlib.sha256(n.encode()).hexdigest()))
    return out


KEY = lambda x: tuple(-1 if y is None else y for y in x)


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_cases(spark, documents, digest_bytes):
    """With digests of one byte or none, most texts collide, and byte verification has to part them."""
    rows = [(k, f"text {k % 40}" + " " * (k % 3)) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n\x0b\x0c\r"), (1003, "a b"), (1004, "ab"), (1005, "a b"), (1006, "a  b"), (1007, "A b"), (None, "null id"), (None, "nullid"), (1008, "x" * 300000), (1009, "x " * 300000), (5, "text 5  "), (7, "seven"), ((1 << 63) - 1, "last"), ((1 << 63) - 1, "text 9"), (None, "last"), ((1 << 63) - 1, "alone")]
    more = documents(rows).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(1))
    found = [tuple(r) for r in op.exact_dedup(more, memtable_rows=50, digest_bytes=digest_bytes, bucket_rows=20).collect()]
    assert sorted(found, key=KEY) == sorted(brute(rows), key=KEY)


def test_empty(spark, documents):
    assert op.exact_dedup(documents([])).count() == 0


def test_namesakes_multiply_nothing(spark, documents, monkeypatch):
    """Texts of one length under one id, or under none, are stored once each."""
    stored = {}
    write = op.Tables.write
    monkeypatch.setattr(op.Tables, "write", lambda self, df, label, keep=False: stored.setdefault(label, write(self, df, label, True)))
    rows = [(own, f"text {k % 600:05d}") for own in (None, 7) for k in range(1200)]
    found = op.exact_dedup(documents(rows)).collect()
    assert stored["hits"].count() == len(rows)
    assert sorted(map(tuple, found), key=KEY) == sorted(brute(rows), key=KEY)


def entries(rng, n):
    e = np.zeros(n, op.ENTRY)
    e["digest"] = [hashlib.sha256(str(k).encode()).digest() for k in rng.integers(0, 500, n)]
    e["none"] = rng.random(n) < 0.1
    e["keep"], e["chars"], e["count"] = rng.integers(0, 1000, n), rng.integers(0, 5, n), 1
    return e


def run_of(e):
    e = op.folded(e)
    return e, op.Bloom.of(e["digest"])


def test_compaction_equals_one_fold():
    rng = np.random.default_rng(3)
    parts = [entries(rng, n) for n in (1, 7, 300, 40, 900)]
    run, looked, spared = op.compacted([run_of(p) for p in parts])
    assert (run == op.folded(np.concatenate(parts))).all() and looked > 0
    assert len(op.compacted([])[0]) == 0


def test_filter_has_no_false_negatives():
    e, f = run_of(entries(np.random.default_rng(1), 400))
    assert f.may_have(e["digest"]).all()
    other = np.array([hashlib.sha256(f"x{k}".encode()).digest() for k in range(2000)], "S32")
    assert f.may_have(other).mean() < 0.05


def test_flushed_filters_spare_lookups(spark, documents):
    """Runs are stored with their filters, and compaction looks up hardly any key of texts that have no copy."""
    docs = documents([(k, f"text {k % 9000}") for k in range(10_000)]).repartition(4)
    digests = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.char_length("text").cast("long").alias("chars"))
    rows = op.flush_runs(digests, 2, 1000).collect()
    assert all(op.Bloom(np.frombuffer(r.filter, np.uint8)).may_have(np.frombuffer(r.run, op.ENTRY)["digest"]).all() for r in rows)
    own = [(np.frombuffer(r.run, op.ENTRY), op.Bloom(np.frombuffer(r.filter, np.uint8))) for r in rows if r.bucket == 0]
    run, looked, spared = op.compacted(own)
    copies = run["count"].sum() - len(run)
    assert copies > 300 and looked < 1.5 * copies + 0.05 * spared and spared > 5 * looked


def test_indexes_merge(spark, documents):
    rows = [(k, f"t{k % 7}") for k in range(30)]
    def index(part):
        docs = documents(part).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.char_length("text").cast("long").alias("chars"))
        return op.build_index(docs, 4)

    key = lambda df: sorted(map(tuple, df.select("digest", "keep_id", "copies").collect()))
    assert key(op.merge_indexes(index(rows[:11]), index(rows[11:]))) == key(index(rows))
