import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverstone.llm import language_id as op
from riverstone.llm.common import read_table


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in read_table(spark, sf, "documents").collect()}
    rows = op.query(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in rows) / len(rows) < 0.01


def test_cases(spark, documents):
    english, german = "the cat and the dog were there with that other thing ", "der hund und die katze waren nicht auf dem schönen haus "
    rows = [(k, (english if k % 2 else german) * (1 + k % 5), "en" if k % 2 else "de") for k in range(200)]
    model = op.train(documents(rows))
    assert set(model.languages) == {"en", "de"} and len(model.languages) == 6
    asked = [(1, "the dog and the cat", None), (2, "die katze und der hund", "en"), (3, None, "en"), (4, "", "en"), (5, "12 !? 3", "de"), (6, "Ω漢字", "en"), (7, "the " * 300000, None), (1, "the dog and the cat", None)]
    more = documents(asked).withColumn("lang_score", F.lit("x"))
    found = op.identify(more, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["en", "en", "de", "und", "und", "und", found[6].lang_pred, "en"]
    assert [r.lang_rejected for r in found] == [False, False, False, True, True, True, True, False]
    assert found[0].text == "the dog and the cat" and "source" in found[0].asDict()
    none = op.train(documents([(1, "words", None)]))
    assert op.identify(documents([(1, "words")]), none).first().lang_pred == "und"
    assert op.identify(documents([]), model).count() == 0


def test_long_texts_count_alike():
    from riverstone.llm import features

    raw = np.frombuffer(b"abcd efgh " * 300_000, np.uint8)
    out = np.zeros((1, 4096), np.float32)
    features.add_ngrams(out, raw, np.array([0, len(raw)]), (2, 3), 12)
    assert out.sum() == 2 * len(raw) - 3


def test_unlearned_languages_are_rejected(spark, sf, documents):
    """Planted texts in other languages of the same script, and letter junk, go; clean ones stay. A one-word document learned from doesn't change that."""
    learned = read_table(spark, sf.replace("0.001", "0.01"), "documents")
    junk = documents([(k, w, lang) for k, (w, lang) in enumerate([("q", "de"), ("zzz", "en"), ("xx", "es"), ("kkk", "fr")] * 3, 10**9)])
    model = op.train(learned.unionByName(junk.select(*learned.columns)))
    gone = ["ngày hôm nay trời đẹp nên chúng tôi đi dạo", "kwa sababu leo ni siku nzuri tutakwenda sokoni kununua matunda na mboga", "xkqz vbnt wrtp zzkq plmk jhgf qwrt bvcx mnbz kjhg trwq pxzv", "tänään on kaunis päivä ja menemme yhdessä torille ostamaan tuoreita hedelmiä ja vihanneksia", "function add(a, b) { const total = a + b; return total; } let x = add(1, 2); console.log(x);"]
    stay = ["the dog and the cat", "der hund und die katze waren nicht auf dem haus", "le chat et le chien sont dans la maison avec les enfants", "el perro y el gato no estaban en la casa de los padres"]
    found = op.identify(documents(list(enumerate(gone + stay))), model).orderBy("doc_id").collect()
    assert [r.lang_rejected for r in found] == [True] * len(gone) + [False] * len(stay)


@pytest.mark.parametrize("left_out", ["de", "es", "fr"])
def test_a_language_left_out_of_training_is_rejected(spark, sf, left_out):
    docs = read_table(spark, sf.replace("0.001", "0.01"), "documents")
    model = op.train(docs.filter(F.col("lang") != left_out))
    rows = op.identify(docs.select("doc_id", "lang", "text"), model, keep_text=False).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    gone = [r.lang_rejected for r in rows if r.lang == left_out]
    assert sum(gone) / len(gone) > 0.9
    assert sum(r.lang_rejected for r in held if r.lang != left_out) / len(held) < 0.02


def test_every_prediction_is_the_nearest_centroid(spark, sf):
    """The query's rows against cosines that are taken one by one from the model's own numbers, with n-grams counted in a dictionary."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = op.train(docs)
    slots = {}

    def slot(gram):
        if gram not in slots:
            one = np.zeros((1, op.DIMS), np.float32)
            op.add_ngrams(one, np.frombuffer(gram, np.uint8), np.array([0, len(gram)]), (len(gram),), op.DIMS_LOG2)
            slots[gram] = int(one[0].argmax())
        return slots[gram]

    rows = {r.doc_id: r for r in op.query(spark, sf).collect()}
    assert len(rows) == docs.count()
    for r in docs.select("doc_id", op.letters(F.col("text")).alias("letters")).orderBy("doc_id").limit(60).collect():
        raw, count = r.letters.encode(), Counter()
        for n in op.SIZES:
            count.update(slot(raw[i : i + n]) for i in range(len(raw) - n + 1))
        own = {s: math.log1p(c) * float(model.idf[s]) for s, c in count.items()}
        length = math.sqrt(sum(x * x for x in own.values()))
        cosines = [sum(x * float(c[s]) for s, x in own.items()) / length if length else 0.0 for c in model.centroids]
        best = max(cosines)
        assert abs(rows[r.doc_id].score - (min(1, max(0, best)) if raw else 0)) < 1e-4
        near = {model.languages[k] for k, x in enumerate(cosines) if x > best - 1e-5}
        assert rows[r.doc_id].lang_pred in (near if raw else {"und"})


def test_the_sample_is_bounded_by_rows(spark, documents, monkeypatch):
    """An id of many rows and texts doesn't add to the sample, and its language is learned whatever its hash is."""
    sizes = {}
    write = op.Tables.write

    def noted(self, df, label, keep=False):
        out = write(self, df, label, keep)
        sizes[label] = {r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()}
        return out

    monkeypatch.setattr(op.Tables, "write", noted)
    hot = [(1, f"the cat number {'abcdefghij'[k % 10]} {'abcdefghij'[k // 10 % 10]} {'abcdefghij'[k // 100 % 10]}", "en") for k in range(3000)]
    for own in (2, 3, 4):  # one id with one text each, some of whose hashes are high
        hot += [(own, "der hund und die katze", f"l{own}")] * 500
    model = op.train(documents(hot), per_language=20)
    assert max(sizes["sample"].values()) == 20 and set(model.languages) == {"en", *(f"l{k}" for k in (2, 3, 4) if zlib.crc32(str(k).encode()) % 5)}


def test_blocks_of_languages_are_as_good_as_one(spark, sf):
    """Learned and compared two languages at a time, predictions are the same; none of the languages is left out."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    whole, parts = op.train(docs), op.train(docs, block=1)
    assert [m.languages[0] for m in [parts, *(b.value for b in parts.rest)]] == sorted(set(whole.languages))
    asked = docs.unionByName(docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang"))
    key = lambda m: sorted((r.doc_id, r.lang_pred, round(r.lang_score, 5), r.lang_rejected) for r in op.identify(asked, m, keep_text=False).collect())
    assert key(whole) == key(parts)
