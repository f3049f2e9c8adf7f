from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riverstone.llm import token_rollup as op
from riverstone.llm.common import new_path, read_table


def test_whole_table(spark, sf):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, tokens = Counter(), Counter()
    for r in read_table(spark, sf, "documents").collect():
        docs[r.source, r.lang] += 1
        tokens[r.source, r.lang] += len(model.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens, r.tokenizer_version) for r in op.query(spark, sf).collect()}
    assert got == {k: (docs[k], tokens[k], op.VERSION) for k in docs}


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches(spark):
    rollup = op.TokenRollup(spark, new_path(spark, "rollup"))
    assert totals(rollup) == {}
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), ("b", None, None), (None, "fr", 2)], "source string, lang string, n_tokens long")
    assert rollup.commit("one/first", op.inserted(rows, "v1"))
    assert not rollup.commit("one/first", op.inserted(rows, "v1"))
    first = {("a", "en", "v1"): (2, 12), ("b", None, "v1"): (1, 0), (None, "fr", "v1"): (1, 2)}
    assert totals(rollup) == first
    rollup.compact()
    assert totals(rollup) == first and not rollup.commit("one/first", op.inserted(rows, "v1"))
    change = spark.createDataFrame([("a", "en", 5, 9)], "source string, lang string, n_tokens_old long, n_tokens long")
    assert rollup.commit("two", op.revised(change, "v1")) and rollup.commit("three", op.deleted(rows.filter("source is null"), "v1"))
    assert rollup.commit("other version", op.inserted(rows.filter("n_tokens = 7"), "v2"))
    assert rollup.commit("none", op.inserted(rows.limit(0), "v1"))
    want = {("a", "en", "v1"): (2, 16), ("b", None, "v1"): (1, 0), ("a", "en", "v2"): (1, 7)}
    assert totals(rollup) == want
    rollup.compact()
    again = op.TokenRollup(spark, rollup.path)
    assert totals(again) == want and not again.commit("two", op.revised(change, "v1"))


def test_a_failed_commit_leaves_nothing(spark):
    rollup = op.TokenRollup(spark, new_path(spark, "rollup"))
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n_tokens long")
    op.inserted(rows, "v").write.parquet(f"{rollup.path}/data/late")
    assert totals(rollup) == {}
    assert rollup.commit("late", op.inserted(rows, "v")) and totals(rollup) == {("a", "en", "v"): (1, 5)}


def test_of_two_writers_one_commits(spark, monkeypatch):
    """Both have looked and found the id free: the move decides, and the loser leaves nothing."""
    one, other = (op.TokenRollup(spark, path) for path in [new_path(spark, "rollup")] * 2)
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n_tokens long")
    changes = op.inserted(rows, "v")
    done = []

    class Late:
        """Changes during whose sum the other writer commits."""

        def groupBy(self, *keys):  # noqa: N802
            done.append(other.commit("same", changes))
            return changes.groupBy(*keys)

    assert not one.commit("same", Late()) and done == [True]
    assert totals(one) == {("a", "en", "v"): (1, 5)} and len(one._names("data")) == 1


def test_counts(spark, documents):
    found = {r.doc_id: r.n_tokens for r in op.count_tokens(documents([(1, None), (2, ""), (3, "the cat"), (3, "the cat")]).withColumn("n_tokens", F.lit(0))).collect()}
    assert found == {1: 0, 2: 0, 3: 2}
