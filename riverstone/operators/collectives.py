"""What collectives of a message-passing program mean for rows that carry a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REDUCE = {"sum": F.sum, "max": F.max, "min": F.min}


def reduce(df: DataFrame, value: Column, how: str = "sum") -> DataFrame:
    return df.agg(_REDUCE[how](value).alias("value"))


def all_reduce(df: DataFrame, value: Column, how: str = "sum", name: str = "total") -> DataFrame:
    """Every row sees the reduced value: one row is broadcast, the rows stay where they are."""
    return df.crossJoin(F.broadcast(df.agg(_REDUCE[how](value).alias(name))))


def gather(df: DataFrame, rank: str, value: str) -> DataFrame:
    """values: one array in order of rank. For as many rows as there are ranks."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda s: s[value]).alias("values"))


def all_to_all(df: DataFrame, rank: str, values: str) -> DataFrame:
    """rank, from_rank, value: element j of rank i's array goes to rank j. A shuffle by destination, no cross product."""
    sent = df.select(F.col(rank).alias("from_rank"), F.posexplode(values).alias("to", "value"))
    return sent.select(F.col("to").cast("long").alias("rank"), "from_rank", "value")
