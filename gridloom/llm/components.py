"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any order to rows (u, root): root is the least node of u's component.

    Nodes that are their own root have no row. No neighbour list is ever gathered in one
    place: each step takes a minimum per node and joins it back, so that a node with very
    many neighbours is pre-aggregated and its join can be split. Every round ends in a
    stored table, and the table before it goes; the number of rounds grows with the
    logarithm of the nodes. No edges: no rows.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return edges.select("u", F.col("v").alias("root"))
        mark, old = new, edges
        edges = stored(_small_star(_large_star(edges)), "edges")
        forget(old)
