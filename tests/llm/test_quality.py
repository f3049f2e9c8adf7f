import zlib

import numpy as np
from pyspark.sql import functions as F

from riverstone.llm import quality as op
from riverstone.llm.common import read_table


def test_held_out_ranking(spark, sf):
    sf = sf.replace("0.001", "0.1")
    label = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}
    rows = op.query(spark, sf).collect()
    assert len(rows) == read_table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2 > 0.99


def test_cases(spark, documents):
    rows = [(k, f"Plain words number{k} in a row here. More of them." if k % 2 else f"LOUD{k}!! WORDS!! HERE!!") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(999, 1), (5, None), (None, 0)], "doc_id long, quality int")
    docs = documents(rows)
    model = op.train(docs, labels)
    asked = documents([(1, "Some plain words in a row. And more."), (2, "SHOUT!! AT!! ALL!!"), (3, None), (4, ""), (None, "words " * 200000), (1, "Some plain words in a row. And more.")])
    found = {r.doc_id: r.quality_score for r in op.score_quality(asked.withColumn("quality_score", F.lit(3)), model).collect()}
    assert found[1] > 0.9 and found[2] < 0.1 and 0 <= found[None] <= 1 and found[3] == found[4]
    assert op.score_quality(documents([]), model).count() == 0
    nothing = op.train(docs, labels.limit(0))
    assert op.score_quality(docs, nothing).agg(F.min("quality_score")).first()[0] == 0.5


def plain_score(model, text):
    """A text's vote, labelled row by labelled row."""
    raw = (text or "").encode()
    counts = op.count_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    blocks = []
    for part in (slice(0, op.SHAPE_DIMS), slice(op.SHAPE_DIMS, op.DIMS)):
        v = np.log1p(counts[part].astype(float)) * model.idf[part]
        blocks.append(v / (np.linalg.norm(v) or 1))
    v = np.concatenate(blocks) @ model.axes.astype(float)
    length = np.linalg.norm(v)
    votes = sorted(((float(row @ v) / length if length else 0.0, y) for row, y in zip(model.latent.astype(float), model.labels, strict=True)), reverse=True)
    edge = votes[: model.k][-1][0] - votes[model.k][0]
    top = [(max(0.0, c) ** model.power, y) for c, y in votes[: model.k]]
    total = sum(w for w, _ in top)
    return (sum(w * y for w, y in top) / total if total else model.base), edge


def test_whole_query_against_plain_votes(spark, sf):
    docs = read_table(spark, sf, "documents")
    model = op.train(docs.select("doc_id", "text"), read_table(spark, sf, "labels"))
    rows = {r.doc_id: r.score for r in op.query(spark, sf).collect()}
    clear = 0
    for r in docs.collect():
        score, edge = plain_score(model, r.text)
        if edge > 1e-5:  # no tie about the last neighbour
            clear += 1
            assert abs(rows[r.doc_id] - score) < 1e-3
    assert clear > 0.8 * len(rows)


def test_words_count():
    """Texts of one shape and other words have other vectors; words don't cross texts."""
    texts = [b"good plain tea", b"evil plain hex", b"good", b" plain tea", b""]
    counts = op.count_features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    words = counts[:, op.SHAPE_DIMS :]
    assert (counts[0, : op.SHAPE_DIMS] == counts[1, : op.SHAPE_DIMS]).all() and (words[0] != words[1]).any()
    assert [int((w > 0).sum()) for w in words] == [3, 3, 1, 2, 0]
    assert set(np.flatnonzero(words[0])) == set(np.flatnonzero(words[2])) | set(np.flatnonzero(words[3]))


def test_axes_are_the_leading_ones():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 200)) @ np.diag(0.9 ** np.arange(200))
    _, _, exact = np.linalg.svd(x)
    assert np.allclose(np.abs(np.sum(op.leading_axes(x, 5) * exact[:5].T, axis=0)), 1, atol=1e-3)


def test_the_sample_is_bounded_by_rows(spark, documents, monkeypatch):
    """An id of many rows and texts, and labels that repeat it, don't add to the sample."""
    kept = []
    monkeypatch.setattr(op, "Model", lambda idf, vectors, labels, **k: kept.append(len(vectors)))
    rows = [(1, f"text number {k % 2900}") for k in range(3000)] + [(k, f"other {k}") for k in range(100, 160)]
    labels = spark.createDataFrame([(1, 1)] * 30 + [(k, k % 2) for k in range(100, 160)], "doc_id long, quality int")
    op.train(documents(rows), labels, sample=20)
    assert kept == [20]


def test_ties_have_one_order():
    """Many labelled vectors are the same: the same ones vote, whatever the batch is."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa", "Bb!", "c1", "dd"], 6)) for _ in range(12)]
    raw = lambda some: (np.frombuffer("".join(some).encode(), np.uint8), np.cumsum([0] + [len(t) for t in some]))
    x = op.vectors_of(op.count_features(*raw(texts * 20)), np.ones(op.DIMS, np.float32))
    model = op.Model(np.ones(op.DIMS, np.float32), x, np.arange(len(x)) % 3 == 0, k=7)
    asked = texts * 9
    whole = model.score(*raw(asked))
    for size in (1, 7, 64):
        parts = np.concatenate([model.score(*raw(asked[i : i + size])) for i in range(0, len(asked), size)])
        assert (parts == whole).all()
    assert len(set(whole[: len(texts)].tolist())) > 1 and (whole.reshape(9, -1) == whole[: len(texts)]).all()
