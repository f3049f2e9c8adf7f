"""Language ID by nearest centroid: normalised TF-IDF vectors of byte n-grams against several clustered centroids for each language.

Document frequencies come from all documents that may be learned from; centroids are clustered (spherical k-means) from at most
`per_language` different texts of each language, chosen by a hash, on one task for each language. Of more than `block` languages, each
block is learned and compared by itself, one pass after the other over what the one before found. Of equally near centroids, the first of the first language in alphabetical order counts.

Rejection. A text is rejected if it has no letter or if its cosine with the nearest centroid is under that language's floor. Cosines grow
with the number of different n-grams of a text, so floors do too: sampled documents and pieces cut from them, of 8 to 4,096 bytes, are held
against the centroids of the half of the sample that they aren't in, and the floor at some number of n-grams is `floor_share` of the lowest
`floor_quantile` of the cosines there. Repetitive texts have few different n-grams and are judged as the short texts that they amount to.

Defined cases. Null and letterless texts are `und` with score 0, and rejected. Texts in an unknown script are given the nearest language,
with a score near 0, and rejected. Documents with a null lang are never learned from; nor are those with a null doc_id, which are held
out. With nothing to learn from, every text is `und`. Where there are too few documents to measure a floor, it is that of fewer n-grams,
at least `LEAST_FLOOR`. Rows that repeat a doc_id are judged row by row. Other columns are ignored. Long texts are counted piece by piece.

At scale. Three passes over the text and no shuffle of it; the centroids of a block of languages (block x 3 x 4096 floats, 25 MB) are
broadcast. Each further block is learned from one more pass, and compared in the same stage as the first, by a worker of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverstone.llm.common import Tables, bounded_batches, bytes_of, read_table, row_slices
from riverstone.llm.features import add_ngrams, document_frequencies, inverse_frequencies, normalised_rows, tf_idf

DIMS_LOG2 = 12
DIMS = 1 << DIMS_LOG2
SIZES = (2, 3, 4)
PER_LANGUAGE = 400
CENTROIDS = 3
FLOOR_SHARE = 0.65
FLOOR_QUANTILE = 0.01
LEAST_FLOOR = 0.05
#: Cosines that a floor is measured from at least.
MEASURED = 20
#: Languages that are learned at a time, and compared with by one worker.
BLOCK = 512
#: Steps of the number of different n-grams, two for each power of two.
STEPS = 2 * DIMS_LOG2 + 1
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-case letters with one space between and around; empty if there is no letter."""
    only = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    return F.when(only == "", only).otherwise(F.concat(F.lit(" "), only, F.lit(" ")))


def count_ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    add_ngrams(out, data, offsets, SIZES, DIMS_LOG2)
    return out


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit rows to k unit centroids; started from rows each as far as can be from those before."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        moved = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        moved = normalised_rows(moved)
        if np.allclose(moved, c, atol=1e-5):
            break
        c = moved
    return c


def step_of(counts: np.ndarray) -> np.ndarray:
    """Which step of the floors each row of counts is judged by."""
    return (2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int)


def cut_pieces(text: str) -> list[str]:
    """The text of letters() and whole words cut out of it at places that depend on the text, for a range of lengths."""
    raw = text.encode()
    rng = np.random.default_rng(zlib.crc32(raw))
    out = [text]
    for k in range(3, DIMS_LOG2 + 1):
        if len(raw) > 1 << k:
            at = int(rng.integers(0, len(raw) - (1 << k)))
            piece = b" ".join(raw[at : at + (1 << k)].split(b" ")[1:-1]).decode()
            out += [f" {piece} "] if piece else []
    return out


class Model:
    """idf, centroids (rows), and for each centroid its language and floors (one for each step)."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], floors: np.ndarray):
        self.idf, self.centroids, self.languages, self.floors = idf, centroids, languages, floors
        #: Models of further blocks of languages, broadcast.
        self.rest: list[Broadcast] = []

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether rejected, of each text of letters()."""
        n = len(offsets) - 1
        empty = np.diff(offsets) == 0
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        counts = count_ngrams(data, offsets)
        cosine = tf_idf(counts, self.idf) @ self.centroids.T
        near = cosine.argmax(axis=1)
        score = np.where(empty, 0, np.clip(cosine[np.arange(n), near], 0, 1)).astype(np.float64)
        return [UNKNOWN if e else self.languages[c] for e, c in zip(empty, near, strict=True)], score, empty | (score < self.floors[near, step_of(counts)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, floor_share: float = FLOOR_SHARE, floor_quantile: float = FLOOR_QUANTILE, block: int = BLOCK) -> Model:
    """documents: doc_id, text, lang. Rows that held_out() names and rows without lang or letters are left out."""
    spark = documents.sparkSession
    bounded_batches(spark)
    own = documents.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = own.select(letters(F.col("text")).alias("letters")).filter("letters != ''")
    n, df = document_frequencies(known, count_ngrams, DIMS)
    idf = inverse_frequencies(n, df)

    # Of each language, the rows with the least hashes; only those under a bound that about twice as many are under are ranked.
    # Rows that repeat id, lang and text are one, so that neither a hot id nor its hash decides how many there are to learn from.
    one = ["lang", "doc_id", "th"]
    own = own.withColumn("th", F.xxhash64("text"))
    rows = own.filter(F.col("text").rlike(r"\p{L}")).select(*one).distinct().withColumn("share", F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    blocks: list[Model | Broadcast] = []
    with Tables(spark) as tables:
        rows = tables.write(rows, "rows")
        counts: dict[str, int] = {}
        for lang, n_rows in rows.groupBy("lang").count().orderBy("lang").toLocalIterator():
            counts[lang] = n_rows
            if len(counts) == block:
                blocks.append(_learned(own, rows, counts, idf, one, per_language, centroids, floor_share, floor_quantile))
                blocks[1:] = [spark.sparkContext.broadcast(b) if isinstance(b, Model) else b for b in blocks[1:]]
                counts = {}
        if counts or not blocks:
            blocks.append(_learned(own, rows, counts, idf, one, per_language, centroids, floor_share, floor_quantile))
    first = blocks[0]
    first.rest = [spark.sparkContext.broadcast(b) if isinstance(b, Model) else b for b in blocks[1:]]
    return first


def _learned(own: DataFrame, rows: DataFrame, counts: dict[str, int], idf: np.ndarray, one: list[str], per_language: int, centroids: int, floor_share: float, floor_quantile: float) -> Model:
    """The model of a block of languages: counts has the number of different texts of each."""
    spark = own.sparkSession
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(2 * per_language / c + 20 / c)) for k, c in counts.items()], F.lit(0.0))
    by_hash = Window.partitionBy("lang").orderBy("share", "doc_id", "th")
    chosen = rows.filter(F.col("share") < bound).withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= per_language).select(*one)
    # At most per_language texts of each language go to all tasks.
    sample = own.join(F.broadcast(chosen), one, "left_semi").dropDuplicates(one).select("lang", letters(F.col("text")).alias("letters"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, 1, max_bytes=1 << 20, max_rows=256):
            x = tf_idf(count_ngrams(*bytes_of(b.column(1))), idf).astype(np.float32)
            yield pa.record_batch([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "fold", "vector"])

    def cluster(key, table):  # noqa: ANN001, ANN202
        """A language's centroids: of all sampled vectors, and of each half of them if there are enough."""
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, DIMS)
        fold = table.column("fold").to_numpy()
        sets = {-1: np.ones(len(x), bool)} | ({k: fold == k for k in (0, 1)} if min((fold == 0).sum(), (fold == 1).sum()) >= MEASURED // 2 else {})
        made = [(k, c.astype(np.float32).tobytes()) for k, rows in sets.items() for c in spherical_k_means(x[rows], centroids)]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(made)), "part": pa.array([k for k, _ in made], pa.int32()), "centroid": pa.array([c for _, c in made], pa.binary())})

    with Tables(spark) as tables:
        sample = tables.write(sample.withColumn("fold", F.pmod(F.xxhash64("letters"), F.lit(2)).cast("int")), "sample")
        made = sorted(sample.mapInArrow(vectors, "lang string, fold int, vector binary").groupBy("lang").applyInArrow(cluster, "lang string, part int, centroid binary").collect())  # 3 x `centroids` rows for each language
        of = lambda lang, part: np.frombuffer(b"".join(bytes(r.centroid) for r in made if (r.lang, r.part) == (lang, part)), np.float32).reshape(-1, DIMS)
        languages = sorted({r.lang for r in made})
        halves = {(lang, part): of(lang, part) for lang in languages for part in (0, 1)}

        def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lang, text, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    other = halves[lang, 1 - fold]
                    if len(other):
                        raw = [p.encode() for p in cut_pieces(text)]
                        x = count_ngrams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
                        best = (tf_idf(x, idf) @ other.T).max(axis=1).astype(float)
                        yield pa.record_batch([pa.array([lang] * len(raw)), pa.array(step_of(x), pa.int32()), pa.array(best)], ["lang", "step", "cosine"])

        seen = sample.mapInArrow(cosines, "lang string, step int, cosine double").groupBy("lang", "step").agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(floor_quantile)).alias("low"))
        low = {(r.lang, r.step): r.low for r in seen.filter(F.col("n") >= MEASURED).collect()}  # at most STEPS rows for each language
    floors: dict[str, list[float]] = {}
    for lang in languages:
        last, floors[lang] = LEAST_FLOOR, []
        for step in range(STEPS):
            last = max(LEAST_FLOOR, floor_share * low.get((lang, step), last / floor_share))
            floors[lang].append(last)
    whole = [(lang, c) for lang in languages for c in of(lang, -1)]
    table = np.stack([c for _, c in whole]) if whole else np.zeros((0, DIMS), np.float32)
    return Model(idf, table, [lang for lang, _ in whole], np.array([floors[lang] for lang, _ in whole]))


def identify(documents: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """documents (all columns; text only if asked for) and lang_pred, lang_score, lang_rejected; columns of these names are replaced."""
    bounded_batches(documents.sparkSession)
    made = ("lang_pred", "lang_score", "lang_rejected")
    fed = documents.drop(*made, "lang_letters").withColumn("lang_letters", letters(F.col("text")))
    fed = fed if keep_text else fed.drop("text")
    names = fed.columns[:-1]
    shared = [documents.sparkSession.sparkContext.broadcast(model), *model.rest]
    schema = ", ".join(f"`{k}` {kind}" for k, kind in fed.dtypes) + ", lang_pred string, lang_score double, lang_rejected boolean"

    def compared(block: Broadcast, again: bool):  # noqa: ANN202
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in row_slices(batches, len(names), max_bytes=1 << 20, max_rows=256):
                lang, score, rejected = (np.array(x) for x in block.value.predict(*bytes_of(b.column(len(names)))))
                if again:  # only a nearer centroid of a later language counts
                    before = [b.column(len(names) + k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)]
                    nearer = score > before[1]
                    lang, score, rejected = (np.where(nearer, x, y) for x, y in zip((lang, score, rejected), before, strict=True))
                yield pa.record_batch([*b.columns[: len(names) + 1], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected.astype(bool))], [*names, "lang_letters", *made])

        return kernel

    for k, block in enumerate(shared):
        fed = fed.mapInArrow(compared(block, k > 0), schema)
    return fed.drop("lang_letters")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    unseen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = identify(unseen, train(docs), keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


NAME = "op3_language_id"
