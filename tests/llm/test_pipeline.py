import re

import corpus_pipeline
import pytest
from brute import leaks, near, pieces
from pyspark.sql import functions as F

from riverstone.llm.common import read_table


def brute(docs, items):
    docs = {d: t for d, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    best = {}
    for d, t in docs.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        if key not in best or (-len(t), d) < best[key]:
            best[key] = (-len(t), d)
    docs = {d: docs[d] for _, d in best.values()}
    docs = {d: docs[d] for d, (_, c) in near(docs).items() if c == d}
    docs = {d: docs[d] for d, x in leaks(docs, items).items() if not x[4]}
    return sorted(pieces(list(docs.items())))


def test_against_a_plain_version(spark, sf):
    docs = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    want = brute(docs, items)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert 0 < len({w[0] for w in want}) < len(docs)


CLASHES = ("own_id", "text_sha256", "own_sha", "own_row", "spans", "n_words", "item_ids", "lang_letters", "lang_pred", "lang_rejected", "h1", "h2", "own_h1", "id", "bucket", "digest", "kept", "column_2", "piece", "length")


@pytest.fixture(scope="module")
def benchmark(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


#: Stage to the documents of ROWS that it keeps; the other stages' reasons to drop don't count.
KEPT = {
    "language_id": [1, 1, 2, None, 5, 6, 7],
    "exact_dedup": [2, 3, None, 5, 6, 7],
    "near_dedup": [1, 1, 3, 4, None, 6, 7],
    "decontamination": [1, 1, 2, 3, 4, None, 5, 7],
}
ROWS = [
    (1, "the cat sat here on the mat today again"),
    (1, "the cat sat here on the mat today again"),
    (2, "the  cat sat here on the mat today again"),
    (3, None),
    (4, ""),
    (None, "the mat that the cat sat on here is today a mat"),
    (5, "the cat sat here on the mat today again now"),
    (6, "so one two three four five six seven eight nine ten and on"),
    (7, "a very long text " * 20_000),
]


@pytest.mark.parametrize("name", KEPT)
def test_each_stage_on_odd_rows_and_columns(spark, documents, benchmark, name):
    """Nulls, empty and very long texts, repeated rows, and other columns of every name that the stages use: rows stay as they are or go."""
    docs = documents(ROWS)
    docs = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES))
    left = stage_of(name)(spark, docs, benchmark)
    assert left.columns == docs.columns
    rows = left.collect()
    want = [2, 3, None, 5, 6, 7] if name == "exact_dedup" else KEPT[name]
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, want))
    assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
    texts = {(d, t) for d, t in ROWS}
    assert all((r.doc_id, r.text) in texts and r.lang == "en" and r.source == "s" for r in rows)


@pytest.mark.parametrize("name", [*KEPT, "packing"])
def test_each_stage_on_an_empty_table(spark, documents, benchmark, name):
    assert stage_of(name)(spark, documents([]), benchmark).count() == 0


def test_packing_of_odd_rows(spark, documents, benchmark):
    docs = documents(ROWS)
    docs = docs.select("*", *(F.lit(1).alias(c) for c in CLASHES))
    rows = stage_of("packing")(spark, docs, benchmark).collect()
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == sorted(str(d) for d, _ in ROWS)


def test_near_copies_without_an_id(spark, documents):
    """Of rows without a doc_id, near copies go and all others stay; so with a doc_id that has several texts."""
    text = lambda word, first: " ".join(f"{word}{k}" for k in range(first, first + 40))
    rows = [(1, text("a", 0)), (None, text("a", 1)), (None, text("b", 0)), (None, text("d", 0)), (None, None), (5, text("e", 0)), (5, text("a", 2)), (5, text("f", 0)), (6, text("f", 1))]
    left = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, documents(rows), ""), "")
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [rows[k] for k in (0, 2, 3, 4, 5, 7)]
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(d), t or "") for d, t in want)


def test_copies_of_a_text_without_id_meet_in_no_task(spark):
    """Each task gives one row of those with one id and one normalised text before any shuffle of them."""
    rows = [(None, "the same words here", "en")] * 500 + [(1, "other words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    found = corpus_pipeline.drop_copies(spark, docs, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert found.count() == 2


def test_a_language_too_far_from_what_was_learned_goes(spark, sf):
    """The first stage rejects by distance too: planted texts of a language that is in no document with a lang."""
    docs = read_table(spark, sf.replace("0.001", "0.01"), "documents").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate(["ngày hôm nay trời đẹp nên chúng tôi đi dạo", "kwa sababu leo ni siku nzuri tutakwenda sokoni kununua matunda na mboga"])], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(planted), "").select("doc_id").collect()}
    assert not kept & {10**9, 10**9 + 1} and len(kept) > 0.98 * docs.count()
