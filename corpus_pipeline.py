"""A corpus from raw documents to packed sequences: each stage works on what the one before kept, and what it decides takes effect.

Documents may have other columns of any name beside doc_id, text and lang: stages work on them under names of their own and give them back
unchanged. Rows with a null doc_id and rows that repeat one are documents of their own, told apart by their texts. Null and empty texts go
at the first stage, as no language is recognised in them; alone, the other stages keep one of them. Empty tables stay empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverstone.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from riverstone.llm.common import drop_path, read_table, write_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filtering(stage: Stage) -> Stage:
    """A stage that sees the columns it doesn't read under names that clash with none of its own, and keeps some rows as they are."""

    @functools.wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*(c if c in ("doc_id", "text", "lang") else f"column_{k}" for k, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).select(*plain.columns).toDF(*docs.columns)

    return renamed


@filtering
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the documents of this stage that aren't held out."""
    found = language_id.identify(docs, language_id.train(docs))
    return found.filter(~F.col("lang_rejected"))


@filtering
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, and one row of it."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("own_id"), "text_sha256").distinct()
    sha = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["own_id"])).withColumn("own_sha", sha).filter(F.col("own_sha") == F.col("text_sha256"))
    one = Window.partitionBy("own_id", "own_sha").orderBy(F.char_length("text").desc(), F.xxhash64("text"))
    return rows.withColumn("own_row", F.row_number().over(one)).filter("own_row = 1")


@filtering
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows are told apart by id and text."""
    kept = near_dedup.near_rows(docs).filter("stays").select(F.col("doc_id").alias("own_id"), "h1", "h2").distinct()
    h1, h2 = near_dedup.text_hashes(F.col("text"))
    rows = docs.withColumns({"own_h1": h1, "own_h2": h2})
    same = rows["doc_id"].eqNullSafe(kept["own_id"]) & (F.col("own_h1") == F.col("h1")) & (F.col("own_h2") == F.col("h2"))
    return rows.join(kept, same, "left_semi")


@filtering
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.filter(F.size("spans") == 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Near copies and token ids can't be had in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = written()
        staged = stage(spark, docs, sf_dir)
        inside = written() - before
        docs = write_table(staged, name)
        for path in inside:  # what the stage's operator has left: its result is stored now
            drop_path(spark, path)
    return docs
