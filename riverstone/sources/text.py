"""Coresets and measurements as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_coreset_csv(coreset: DataFrame, path: str, dims: int, mode: str = "overwrite") -> None:
    """Columns w, x0, x1, ... with a header, six decimals."""
    six = lambda c: F.format_string("%.6f", c.cast("double"))
    columns = [six(F.col("weight")).alias("w"), *[six(F.get("features", F.lit(i))).alias(f"x{i}") for i in range(dims)]]
    coreset.select(*columns).write.mode(mode).csv(path, header=True)


def read_coreset_csv(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """weight, features and, if the file's name ends in _<number>, coreset_size."""
    schema = "w double, " + ", ".join(f"x{i} double" for i in range(dims))
    rows = spark.read.schema(schema).csv(path, header=True)
    size = F.nullif(F.regexp_extract(F.input_file_name(), r"coreset_(\d+)", 1), F.lit("")).cast("long")
    return rows.select(F.col("w").alias("weight"), F.array(*[F.col(f"x{i}") for i in range(dims)]).alias("features"), size.alias("coreset_size"))


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows as new files, each with a header."""
    df.write.mode("append").csv(path, header=True)


def read_coreset_folder(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """coreset_size, weight, features of all coresets below a folder (each named coreset_<size>), largest first.

    Raises an error where a file's header isn't that of a weight and `dims` features.
    """
    want = ",".join(["w", *(f"x{i}" for i in range(dims))])
    heads = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.input_file_name().alias("file")).filter("value like 'w,%'")
    bad = heads.filter(F.col("value") != want).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file} doesn't have a weight and {dims} features")
    schema = "w double, " + ", ".join(f"x{i} double" for i in range(dims))
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, header=True)
    size = F.nullif(F.regexp_extract(F.input_file_name(), r"coreset_(\d+)", 1), F.lit("")).cast("long")
    return rows.select(size.alias("coreset_size"), F.col("w").alias("weight"), F.array(*[F.col(f"x{i}") for i in range(dims)]).alias("features")).orderBy(F.col("coreset_size").desc())
