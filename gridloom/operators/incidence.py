"""Gather, scatter and reductions over the links between two entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.ranking import running_before
from gridloom.session import stored

SMALL_ROWS = 1_000_000


def incidence(elements: DataFrame, id_col: str = "id", nodes_col: str = "nodes") -> DataFrame:
    """Rows (elem, slot, node), one for each link."""
    return elements.select(F.col(id_col).alias("elem"), F.posexplode(nodes_col).alias("slot", "node"))


def gather(links: DataFrame, values: DataFrame, how: str = "sum") -> DataFrame:
    """(id, value): for each element the sum or mean over its nodes' values (columns id, value)."""
    joined = links.join(values.select(F.col("id").alias("node"), "value"), "node")
    return joined.groupBy(F.col("elem").alias("id")).agg((F.sum if how == "sum" else F.avg)("value").alias("value"))


def degrees(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, deg): incidences of every node, 0 for isolated ones."""
    counts = links.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("deg"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def scatter(links: DataFrame, values: DataFrame, nodes: DataFrame, how: str = "sum") -> DataFrame:
    """(id, value): for each node the sum or mean of its elements' values, 0 for isolated nodes.

    The exchange by node gives each node to one task, so no two tasks ever write the same
    node; partial sums are made before it.
    """
    return scattered(links.join(values.select(F.col("id").alias("elem"), "value"), "elem"), nodes, how)


def scattered(links: DataFrame, nodes: DataFrame, how: str = "sum") -> DataFrame:
    """scatter for links that carry their element's value."""
    found = links.groupBy(F.col("node").alias("id")).agg((F.sum if how == "sum" else F.avg)("value").alias("value"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("value", F.lit(0)).alias("value"))


def smooth(links: DataFrame, values: DataFrame, steps: int) -> DataFrame:
    """`steps` rounds of v <- v + sum over incident elements of (sum of its nodes' v) / degree.

    Each round reads its values twice, so all but the last end in a stored table: without
    it the work would double from round to round.
    """
    degree = links.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("deg"))
    current = values.select("id", F.col("value").cast("double").alias("value"))
    for step in range(steps):
        added = scatter(links, gather(links, current), current).withColumnRenamed("value", "add")
        current = current.join(added, "id").join(degree, "id", "left").select("id", (F.col("value") + F.coalesce(F.col("add") / F.col("deg"), F.lit(0.0))).alias("value"))
        if step < steps - 1:
            current = stored(current, "smoothed")
    return current


def iterated(degree: DataFrame) -> DataFrame:
    """(id, value): v <- sqrt(v*v + 1) + 1 applied once for each incidence, from 0."""
    # Integers of a float: a node of degree 0 makes no step, and sequence(1, 0) would count down.
    steps = F.when(F.col("deg") > 0, F.sequence(F.lit(1).cast("long"), F.col("deg"))).otherwise(F.array().cast("array<bigint>"))
    return degree.select("id", F.aggregate(steps, F.lit(0.0), lambda s, _: F.sqrt(s * s + 1.0) + 1.0).alias("value"))


def csr_offsets(degree: DataFrame) -> DataFrame:
    """(id, deg, offset): where each node's list starts when lists are laid end to end by id."""
    return running_before(degree.select("id", "deg"), "id", F.col("deg"), "offset")


def ragged_sum(links: DataFrame, values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, value): for each node the sum over its whole ball of elements, however large, 0 for isolated nodes."""
    return scatter(links, values, nodes)


def padded_sum(links: DataFrame, values: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, value): the sum over the first `width` incident elements, by element and slot; what a longer ball has more is left out.

    Rows are cut by rank before they are summed, so no ball is ever gathered.
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy("elem", "slot"))
    return scatter(links.withColumn("place", place).where(F.col("place") <= width).drop("place"), values, nodes)


def remapped(elements: DataFrame, numbering: DataFrame) -> DataFrame:
    """elements (id, nodes) with each node's old_id replaced by its new_id, slots in order."""
    links = incidence(elements).join(numbering.select(F.col("old_id").alias("node"), "new_id"), "node")
    lists = links.groupBy(F.col("elem").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "new_id"))), lambda s: s["new_id"]).alias("nodes"))
    return lists


def reduce(values: DataFrame, **measures: Column) -> DataFrame:
    """Global reductions: partial in each task, then final."""
    return values.agg(*(c.alias(name) for name, c in measures.items()))
