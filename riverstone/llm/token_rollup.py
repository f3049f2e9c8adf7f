"""Token counts as delta-maintained rollups.

A batch holds signed changes: an inserted document counts +1 and +tokens, a deleted one -1 and -tokens, a revised count both. A batch is
added up by source, language and tokenizer version, written under a name of its own, and committed by moving a small file with that name
to the batch's id; the totals are the sum over the committed batches. The move fails where the id is taken, so committing an id again
changes nothing, whether the first try ended, failed midway, ran twice or runs beside this one. compact() folds committed batches into a
snapshot that remembers their ids, so a late retry of a folded batch is known too.

Defined cases. Null source, language or count: null is a group of its own, a null count counts as 0. Null text has 0 tokens. Groups that
have come to 0 documents and 0 tokens are left out of totals. Rows that repeat a doc_id are changes of their own. An empty batch is a
batch. Other columns are ignored. Texts are whole: see tokens.py for the memory that a long one takes.

At scale. Each task adds up its rows before anything is shuffled; what is stored grows with the number of groups and open batches, not of
documents. The ids of folded batches stay in a table and are asked one by one; only the names of open batches come to the driver. Any
number of writers may commit; compacting is for one at a time, while none commits a batch that was open before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverstone.llm.common import bounded_batches, new_path, read_table
from riverstone.llm.tokens import DEFAULT_VOCABULARY, encoded

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def count_tokens(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, n_tokens of whole texts, and the columns named in `also`."""
    bounded_batches(documents.sparkSession)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *also, "text")
    names = own.columns[:-1]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in encoded(batches, len(names), vocabulary):
            yield pa.record_batch([*b.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64())], [*names, "n_tokens"])

    return own.mapInArrow(kernel, ", ".join(f"`{k}` {kind}" for k, kind in own.dtypes[:-1]) + ", n_tokens long")


def inserted(counts: DataFrame, version: str) -> DataFrame:
    return _signed(counts, version, 1, F.col("n_tokens"))


def deleted(counts: DataFrame, version: str) -> DataFrame:
    return _signed(counts, version, -1, -F.col("n_tokens"))


def revised(counts: DataFrame, version: str, old: str = "n_tokens_old") -> DataFrame:
    """Documents whose count under a version is now n_tokens instead of `old`."""
    return _signed(counts, version, 0, F.coalesce("n_tokens", F.lit(0)) - F.coalesce(old, F.lit(0)))


def _signed(counts: DataFrame, version: str, docs: int, tokens) -> DataFrame:  # noqa: ANN001
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(docs).cast("long").alias("n_docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))


class TokenRollup:
    """Totals under a path in the shared store: data/ (tables), batches/ (a file for each open batch), totals/ and ids/ (snapshots)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._of(self.path).toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _names(self, folder: str) -> list[str]:
        top = self._of(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _snapshot(self) -> str | None:
        """The last snapshot whose tables are both complete."""
        whole = [n for n in self._names("totals") if all(self._fs.exists(self._of(f"{self.path}/{k}/{n}/_SUCCESS")) for k in ("totals", "ids"))]
        return max(whole, default=None)

    def _folded(self, last: str | None, names: list[str]) -> set[str]:
        """Which of these names the snapshot holds."""
        if not last or not names:
            return set()
        ids = self.spark.read.schema("batch string").parquet(f"{self.path}/ids/{last}")
        return {r[0] for r in ids.filter(F.col("batch").isin(names)).collect()}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch's changes once; False if it was committed before."""
        name = quote(batch, safe="")
        mark = self._of(f"{self.path}/batches/{name}")
        if self._fs.exists(mark) or self._folded(self._snapshot(), [name]):
            return False
        data = uuid.uuid4().hex
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.parquet(f"{self.path}/data/{data}")
        made = self._of(f"{self.path}/data/{data}.mark")
        out = self._fs.create(made, True)
        out.writeUTF(data)
        out.close()
        self._fs.mkdirs(mark.getParent())
        try:
            self._context.rename(made, mark, self._no_overwrite)
        except Py4JJavaError as error:
            if not self._fs.exists(mark):
                raise
            if "Exist" not in error.java_exception.getClass().getName():
                raise
            for left in (made, self._of(f"{self.path}/data/{data}")):
                self._fs.delete(left, True)
            return False
        return True

    def _open(self, last: str | None) -> dict[str, str]:
        """Names of the open batches and where their sums are."""
        names = [n for n in self._names("batches") if not n.startswith(".")]
        folded, found = self._folded(last, names), {}
        for name in names:
            if name not in folded:
                mark = self._fs.open(self._of(f"{self.path}/batches/{name}"))
                found[name] = f"{self.path}/data/{mark.readUTF()}"
                mark.close()
        return found

    def totals(self) -> DataFrame:
        last = self._snapshot()
        paths = [*self._open(last).values(), *([f"{self.path}/totals/{last}"] if last else [])]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Open batches go into a new snapshot; then they and the old snapshot are deleted."""
        last = self._snapshot()
        batches = self._open(last)
        name = f"{int(last or 0) + 1:012d}"
        self.totals().write.mode("overwrite").parquet(f"{self.path}/totals/{name}")
        ids = self.spark.createDataFrame([(x,) for x in batches], "batch string")
        if last:
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/ids/{last}"))
        ids.write.mode("overwrite").parquet(f"{self.path}/ids/{name}")
        old = [f"batches/{n}" for n in batches] + ([f"totals/{last}", f"ids/{last}"] if last else [])
        for gone in [*(f"{self.path}/{x}" for x in old), *batches.values()]:
            self._fs.delete(self._of(gone), True)


VERSION = "word_bpe_49k"
OLD_VERSION = "bytes/4"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents change their tokenizer version: inserted under an old one (a count guessed from bytes) and under the new one with the
    same guess, folded, then revised to the counts of the new one and deleted from the old one; each batch is sent twice."""
    guess = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    docs = read_table(spark, sf_dir, "documents").withColumn("n_tokens_old", guess)
    guessed = docs.select("source", "lang", F.col("n_tokens_old").alias("n_tokens"))
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    both = inserted(guessed, OLD_VERSION).unionByName(inserted(guessed, VERSION))
    for _ in range(2):
        rollup.commit("guessed", both)
        rollup.compact()
    counted = revised(count_tokens(docs, also=("n_tokens_old",)), VERSION)
    for _ in range(2):
        rollup.commit("counted", counted)
        rollup.commit("old version", deleted(guessed, OLD_VERSION))
    return rollup.totals()


NAME = "op9_token_counts"
