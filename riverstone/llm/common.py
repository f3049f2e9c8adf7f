"""What the operators of this subpackage share: reading tables, the shared work folder, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riverstone.session import work_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the Arrow batches that kernels on texts get, for sessions that keep Spark's own 10,000 rows.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Long texts make batches of 10,000 rows too large for a task; a session that sets its own number keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        for key, value in BATCH_SETTINGS.items():
            spark.conf.set(key, value)


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _WRITTEN.append(path := work_path(spark, label))
    return path


def drop_path(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def drop_written(spark: SparkSession) -> int:
    """Deletes what this program's operators have left in the shared folder, once their results are no longer read."""
    return sum(drop_path(spark, path) for path in list(_WRITTEN))


def written() -> set[str]:
    """Paths of what was written and not deleted."""
    return set(_WRITTEN)


class Tables:
    """Tables written in the shared folder: cuts the lineage, and what is used twice is computed once.

    As a context, deletes at its end those that were not kept: an operator's result may read only what it kept.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:  # noqa: ANN002
        for path in list(self.paths.values()):
            drop_path(self.spark, path)

    def drop(self, label: str) -> None:
        drop_path(self.spark, self.paths.pop(label))

    def write(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        """df, written and read back; a table of the same label that this one replaces is deleted."""
        path = new_path(self.spark, label)
        df.write.parquet(path)
        if not keep:
            if label in self.paths:
                drop_path(self.spark, self.paths[label])
            self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """One table that stays until drop_written()."""
    return Tables(df.sparkSession).write(df, label, keep=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_slices(batches: Iterator[pa.RecordBatch], text_col: int, max_bytes: int = 4 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cuts batches by the bytes of a text column so that a kernel's working memory is bounded (one long text stays whole)."""
    for batch in batches:
        n = batch.num_rows
        sizes = text_sizes(batch.column(text_col))
        begin = 0
        while begin < n:
            base = sizes[begin - 1] if begin else 0
            end = int(np.searchsorted(sizes, base + max_bytes, side="right"))
            end = min(max(end, begin + 1), begin + max_rows, n)
            yield batch.slice(begin, end - begin)
            begin = end


def text_sizes(column: pa.Array) -> np.ndarray:
    """Running total of the bytes of a string column, by row."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0)
    return np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text of a column as one uint8 array, and the n + 1 offsets in it; null counts as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.fill_null(column, b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]
