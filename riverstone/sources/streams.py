"""Streams of points: from files as they come, some at a time, and from a socket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None, bytes_per_trigger: int = 1 << 30, **options: str) -> DataFrame:
    """Parquet files of a folder; a micro-batch takes so many bytes of them (or so many files, if that is given), so that it doesn't grow with
    what has piled up."""
    limit = {"maxFilesPerTrigger": str(files_per_trigger)} if files_per_trigger else {"maxBytesPerTrigger": str(bytes_per_trigger)}
    return spark.readStream.schema(schema).options(**limit, **options).parquet(path)


def socket_points(spark: SparkSession, host: str, port: int) -> DataFrame:
    """id, features from lines of numbers with commas between; lines with anything else are left out. Each line's time is ts.

    A socket can't be read again: for tests and trials, as Spark's own source says. A queue that keeps its messages is read by its own
    format, with parsed_points() behind it.
    """
    lines = spark.readStream.format("socket").options(host=host, port=str(port), includeTimestamp="true").load()
    return parsed_points(lines, F.col("value")).withColumnRenamed("timestamp", "ts")


def parsed_points(lines: DataFrame, text: F.Column) -> DataFrame:
    """id (a hash of the line), features and the other columns, from lines of numbers with commas between."""
    number = r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*"
    whole = lines.filter(text.rlike(f"^{number}(,{number})*$"))
    others = [c for c in lines.columns if c != "value"]
    return whole.select(F.xxhash64(text).alias("id"), F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double")).alias("features"), *others)
