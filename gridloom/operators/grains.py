"""Grains: contiguous parts of a numbering, coloured so that grains of one colour share no vertex."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import stored


def partition(numbering: DataFrame, count: int, grains: int) -> DataFrame:
    """(id, grain): `grains` parts of the renumbered vertices (old_id, new_id), sizes one apart at most.

    Ranges of a curve's order stand in for a graph partition; cuts are not minimal.
    """
    grain = F.floor((F.col("new_id") - 1) * grains / count).cast("long")
    return numbering.select(F.col("old_id").alias("id"), grain.alias("grain"))


def of_elements(elements: DataFrame, grains: DataFrame) -> DataFrame:
    """(id, grain): each element's grain is that of its first node."""
    first = elements.select("id", F.col("nodes")[0].alias("node"))
    return first.join(grains.select(F.col("id").alias("node"), "grain"), "node").select("id", "grain")


def adjacency(links: DataFrame, grains: DataFrame) -> DataFrame:
    """(g1, g2), g1 < g2: grains whose elements (rows elem, node with a grain) share a vertex."""
    touched = links.join(grains.select(F.col("id").alias("elem"), "grain"), "elem").select("node", "grain").distinct()
    other = touched.select("node", F.col("grain").alias("g2"))
    return touched.withColumnRenamed("grain", "g1").join(other, "node").where("g1 < g2").select("g1", "g2").distinct()


def rank2_adjacency(ball2: DataFrame, vertex_grains: DataFrame) -> DataFrame:
    """(g1, g2), g1 < g2: grains (rows id, grain) with vertices two edges apart."""
    one = vertex_grains.select("id", F.col("grain").alias("g1"))
    two = vertex_grains.select(F.col("id").alias("ngb"), F.col("grain").alias("g2"))
    return ball2.join(one, "id").join(two, "ngb").where("g1 < g2").select("g1", "g2").distinct()


def clashes(pairs: DataFrame, colors: DataFrame) -> DataFrame:
    """Rows (g1, g2) of adjacent grains that have one colour (rows grain, color)."""
    one, two = (colors.select(F.col("grain").alias(f"g{i}"), F.col("color").alias(f"c{i}")) for i in (1, 2))
    return pairs.join(one, "g1").join(two, "g2").where("c1 = c2").select("g1", "g2")


def coloring(pairs: list[tuple[int, int]], grains: int, workers: int = 1, transfers: int = 5) -> dict[int, int]:
    """Colour of each grain: most constrained first, then the least used colour its neighbours leave.

    Works on the collected grain graph: its size is bounded by the number of grains, not
    the mesh. Unconnected parts of the graph are coloured too. At the end up to `transfers`
    rounds move grains from full colours to those of fewer than `workers` grains.
    """
    around: dict[int, set[int]] = {g: set() for g in range(grains)}
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    color: dict[int, int] = {}
    used: list[int] = []
    heap = [(0, -len(around[g]), g) for g in around]
    heapq.heapify(heap)
    while heap:
        seen, _, g = heapq.heappop(heap)
        taken = {color[v] for v in around[g] if v in color}
        if g in color or -seen != len(taken):
            continue
        free = [c for c in range(len(used)) if c not in taken]
        best = min(free, key=lambda c: (used[c], c)) if free else len(used)
        if best == len(used):
            used.append(0)
        used[best] += 1
        color[g] = best
        for v in around[g]:
            if v not in color:
                heapq.heappush(heap, (-len({color[u] for u in around[v] if u in color}), -len(around[v]), v))
    for _ in range(transfers):
        poor = [c for c in range(len(used)) if used[c] < workers]
        moves = ((g, c) for c in poor for g in sorted(color) if used[color[g]] > max(workers, used[c] + 1) and c not in {color[v] for v in around[g]})
        move = next(moves, None)
        if move is None:
            break
        used[color[move[0]]] -= 1
        used[move[1]] += 1
        color[move[0]] = move[1]
    return color


def ranges(elements: DataFrame, grains: DataFrame) -> DataFrame:
    """(grain, beg, end_): least and largest new id of each grain's elements; 0 and 0 for empty grains (column grain of grains)."""
    found = elements.groupBy("grain").agg(F.min("id").alias("beg"), F.max("id").alias("end_"))
    return grains.join(found, "grain", "left").select("grain", F.coalesce("beg", F.lit(0)).cast("long").alias("beg"), F.coalesce("end_", F.lit(0)).cast("long").alias("end_"))


def dependencies(ball2: DataFrame, vertex_grains: DataFrame, colors: DataFrame) -> DataFrame:
    """(g1, g2): grains with a rank-2 link where g2's colour is the one before g1's."""
    one = vertex_grains.join(colors, "grain").select("id", F.col("grain").alias("g1"), F.col("color").alias("c1"))
    two = one.select(F.col("id").alias("ngb"), F.col("g1").alias("g2"), F.col("c1").alias("c2"))
    return ball2.join(one, "id").join(two, "ngb").where("c2 = c1 - 1").select("g1", "g2").distinct()


def apply(rows: DataFrame, procedure: Callable, schema: str) -> DataFrame:
    """A procedure on whole grains: rows grouped by grain, each given to `procedure` as a pandas frame."""
    return rows.groupBy("grain").applyInPandas(procedure, schema)


def launch_colors(rows: DataFrame, colors: list[int], step: Callable[[DataFrame, DataFrame], DataFrame], state: DataFrame) -> DataFrame:
    """The state after a step for each colour in turn: step(state, rows of that colour) sees what the colours before it left.

    Grains of one colour share no vertex, so their order inside a step does not matter. A
    step's state is stored before the next begins; colours are few.
    """
    for color in sorted(colors):
        state = stored(step(state, rows.where(F.col("color") == color)), "colour-step")
    return state
