"""Meshes generated in Spark: the subdivided cube, its shuffled numbering and a mesh of all volume kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.ranking import div
from gridloom.topology import HEX

# Axis orders of the six tetrahedra of a cell.
ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))


def cube_size(spark: SparkSession, sf_dir: str) -> int:
    """Cells per axis: the cube root of the number of parts, rounded down."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    n = round(parts ** (1 / 3))
    return n - (n**3 > parts)


def vertices(spark: SparkSession, n: int) -> DataFrame:
    """(id, x, y, z, value, ref) of the (n+1)**3 grid points; value is id % 97."""
    m, at = n + 1, F.col("id") - 1
    grid = [at % m, div(at, m) % m, div(at, m * m)]
    return spark.range(1, m**3 + 1).select("id", *(g.cast("double").alias(c) for g, c in zip(grid, "xyz")), (F.col("id") % 97).alias("value"), F.lit(0).alias("ref"))


def tetrahedra(spark: SparkSession, n: int) -> DataFrame:
    """(id, nodes, ref) of six tetrahedra a cell; ref is 1 in the lower half of x, else 2."""
    m = n + 1
    cell, part = div(F.col("c"), 6), F.col("c") % 6
    i, j, k = cell % n, div(cell, n) % n, div(cell, n * n)
    base = 1 + i + j * m + k * (m * m)
    steps = (1, m, m * m)
    choice = lambda values: F.element_at(F.array(*map(F.lit, values)), part.cast("int") + 1)
    one, two = choice([steps[o[0]] for o in ORDERS]), choice([steps[o[0]] + steps[o[1]] for o in ORDERS])
    nodes = F.array(*(v.cast("long") for v in (base, base + one, base + two, base + sum(steps))))
    return spark.range(6 * n**3).withColumnRenamed("id", "c").select((F.col("c") + 1).alias("id"), nodes.alias("nodes"), F.when(i < n // 2, 1).otherwise(2).alias("ref"))


def shuffled(node: Column, size: int, factor: int = 5) -> Column:
    """A scattered numbering of 1..size; factor must have no common divisor with size."""
    return (1 + (node - 1) * factor % size).cast("long")


def reference(number: Column) -> Column:
    """A scattered 32-bit reference: the low four bytes of 7919 times the number, signed."""
    return F.shiftright(F.shiftleft((number * 7919).cast("long"), 32), 32).cast("int")


def mixed_elements(spark: SparkSession, n: int) -> DataFrame:
    """(kind, id, nodes) of hexahedra, pyramids, prisms and tetrahedra in columns of cells; n is cut to a multiple of 3."""
    n = n // 3 * 3
    m = n + 1
    cells = spark.range(n**3).select((F.col("id") % n).alias("i"), (div(F.col("id"), n) % n).alias("j"), div(F.col("id"), n * n).alias("k"), F.col("id").alias("cell"))
    corner = [(1 + F.col("i") + a + (F.col("j") + b) * m + (F.col("k") + c) * m * m).cast("long") for a, b, c in CORNERS]
    array = lambda ids: F.array(*(corner[x] for x in ids))
    column = lambda r: cells.where(F.col("i") % 3 == r)
    rank = F.col("k") * n * (n // 3) + F.col("j") * (n // 3) + div(F.col("i"), 3)  # cell number within its kind of column
    hexes = column(0).select(F.lit("hex").alias("kind"), (rank + 1).cast("long").alias("id"), array(range(8)).alias("nodes"))
    centre = (m**3 + 1 + rank).cast("long")
    faces = F.array(*(array(f) for f in HEX.faces))
    pyramids = column(1).select(rank.alias("r"), centre.alias("c"), F.posexplode(faces).alias("f", "base")).select(F.lit("pyramid").alias("kind"), (F.col("r") * 6 + F.col("f") + 1).cast("long").alias("id"), F.concat("base", F.array("c")).alias("nodes"))
    halves = F.array(array((0, 1, 2, 4, 5, 6)), array((0, 2, 3, 4, 6, 7)))
    prisms = column(2).select(rank.alias("r"), "k", "j", "i", F.posexplode(halves).alias("h", "nodes"))
    apex = m**3 + n * n * (n // 3) + 1 + (F.col("j") * (n // 3) + div(F.col("i"), 3)) * 2 + F.col("h")
    tops = prisms.where(F.col("k") == n - 1).select(F.lit("tet").alias("kind"), ((F.col("j") * (n // 3) + div(F.col("i"), 3)) * 2 + F.col("h") + 1).cast("long").alias("id"), F.concat(F.slice("nodes", 4, 3), F.array(apex.cast("long"))).alias("nodes"))
    return hexes.union(pyramids).union(prisms.select(F.lit("prism").alias("kind"), (F.col("r") * 2 + F.col("h") + 1).cast("long").alias("id"), "nodes")).union(tops)


#: (kind, hub, elements beyond n, nodes) of the fan mesh: degrees on both sides of every limit.
FANS = (("tet", 1, 130, 4), ("triangle", 2, 33, 3), ("quad", 3, 5, 4), ("hex", 4, 9, 8), ("pyramid", 1, 20, 5), ("prism", 2, 10, 6), ("edge", 1, 5, 2), ("hex", 5, -12, 8))
FAN_HUBS = 6


def fan_nodes(n: int) -> int:
    """Vertices of the fan mesh; the last hub is isolated."""
    return FAN_HUBS + sum(max(0, more + n) * (width - 1) for _, _, more, width in FANS)


def fan_elements(spark: SparkSession, n: int) -> DataFrame:
    """(kind, id, nodes) of all linear kinds: each element is a hub and nodes of its own."""
    found, first, used = None, FAN_HUBS, {}
    for kind, hub, more, width in FANS:
        count, start = max(0, more + n), used.get(kind, 0)
        e = F.col("id")
        own = [e * (width - 1) + j + first for j in range(1, width)]
        part = spark.range(count).select(F.lit(kind).alias("kind"), (e + 1 + start).alias("id"), F.array(F.lit(hub).cast("long"), *own).alias("nodes"))
        found = part if found is None else found.union(part)
        first, used[kind] = first + count * (width - 1), start + count
    return found
