import random
import re

import numpy as np
import pytest
import xxhash
from brute import BLANK, lower
from pyspark.sql import functions as F

from riverstone.llm import simhash as op
from riverstone.llm.common import Tables, read_table


def plain_print(text, size=4):
    w = [x for x in BLANK.split(lower(text or "")) if x]
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """{fingerprint: set of those reachable} over all pairs."""
    left, out = set(prints), {}
    while left:
        edge, group = [left.pop()], set()
        while edge:
            x = edge.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            edge += near
        out |= dict.fromkeys(group, group)
    return out


def brute(rows):
    """[(doc_id, fingerprint, component_id)]; null ids come last."""
    prints = [plain_print(t) for _, t in rows]
    group = components(prints)
    ids = {}
    for (d, _), p in zip(rows, prints, strict=True):
        ids.setdefault(p, []).append((d is None, d))
    least = lambda p: min(x for q in group[p] for x in ids[q])[1]
    return [(d, f"{p:016x}", least(p)) for (d, _), p in zip(rows, prints, strict=True)]


KEY = lambda r: tuple(-1 if x is None else x for x in r)


def same(found, rows):
    assert sorted(map(tuple, found.collect()), key=KEY) == sorted(brute(rows), key=KEY)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    same(op.query(spark, sf), rows)
    assert sum(d != c for d, _, c in brute(rows)) > 3


def test_cases(spark, documents):
    assert op.simhash_groups(documents([])).count() == 0
    rows = [(5, "x y z"), (5, "X Y\nz"), (2, "x y z"), (None, "x y z"), (None, "other"), (None, None), (9, ""), (10, " \t\x0b\n"), (11, "word " * 60000), (12, "É é"), (13, "É É"), ((1 << 63) - 1, "alone at last")]
    more = documents(rows).withColumn("fp", F.lit(1)).withColumn("id", F.lit("b")).withColumn("fingerprint", F.lit("c"))
    same(op.simhash_groups(more), rows)


@pytest.mark.parametrize("block", [op.BLOCK, 16])
def test_groups_of_near_copies(spark, documents, block):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(250)]
    rows = [(k, " ".join(w if rng.random() > share else f"q{rng.randrange(10**6)}" for w in base)) for k, share in enumerate(rng.choices([0, 0.004, 0.01, 0.02], k=250))]
    rows += [(300 + k, "the same line " * 80 + f"{k % 40}") for k in range(80)]
    rng.shuffle(rows)
    same(op.simhash_groups(documents(rows), block=block), rows)


@pytest.mark.parametrize(("segments", "radius", "block"), [(3, 4, 512), (2, 4, 8), (3, 3, 8)])
def test_links_have_the_components_of_all_pairs(spark, segments, radius, block):
    """Fingerprints at distances of 1 to 9 bits of some centres, some of which share a segment: large buckets, dense groups and chains."""
    rng = np.random.default_rng(segments * 100 + radius)
    made = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            x = centre
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << b
            made.add(x)
    made |= {(int(x) << 22) & ((1 << 64) - 1) | 12345 for x in rng.integers(0, 1 << 42, 200, dtype=np.uint64)}
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    prints = spark.createDataFrame([(signed(x),) for x in made], "id long")
    with Tables(spark) as tables:
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in op.near_links(tables.write(prints, "prints"), tables, radius, segments, block).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in links)
    want = components(made, radius)
    parent = {x: {x} for x in made}
    for a, b in links:
        if parent[a] is not parent[b]:
            parent[a] |= parent[b]
            for x in parent[b]:
                parent[x] = parent[a]
    assert all(parent[x] == want[x] for x in made)
    assert len({frozenset(g) for g in want.values()}) > 100


def test_balls():
    assert op.radii(3, 4) == [1, 1, 0] and op.radii(2, 4) == [2, 1] and op.radii(4, 3) == [0, 0, 0, 0] and op.radii(4, 2) == [0, 0, 0, -1]
    assert len(op.ball_masks(22, 1)) == 22 and len(op.ball_masks(32, 2)) == 32 + 496
    assert [sum(w for _, w in op.segments_of(m)) for m in (1, 2, 3, 5)] == [64] * 4
    assert re.fullmatch("0+", f"{op.fingerprint(np.zeros(0, np.uint64)):016x}")
