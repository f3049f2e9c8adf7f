"""Connected components of a table of links, by alternating large-star and small-star rounds; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverstone.llm.common import Tables


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.select("hi", "lo").unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).withColumnsRenamed({"hi": "u", "lo": "v"})
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) to id, component (the smallest id reachable), for every id with a link to another; read from a stored table of stars."""
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    with Tables(links.sparkSession) as tables:
        edges = tables.write(edges, "edges")
        for _ in range(max_rounds):
            edges = tables.write(_small_star(_large_star(edges)), "edges")
            # A star's centre is never a node's larger end, and each larger end has one centre.
            chained = edges.join(edges.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi")
            if chained.isEmpty() and edges.groupBy("hi").count().filter("count > 1").isEmpty():
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        tables.paths.clear()  # the last one is the result
    star = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return star.unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
