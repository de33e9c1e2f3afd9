"""Meshes as Parquet: a table of vertices and a table of elements of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.topology import KINDS, QUADRATIC

SUFFIX = ".mesh"
VERTICES, ELEMENTS = "vertices", "elements"
WIDTHS = {k.name: k.nodes for k in KINDS.values()} | QUADRATIC


def mesh_path(path: str) -> str:
    """The path with .meshb put on unless it has .mesh in it."""
    return path if SUFFIX in path else path + SUFFIX + "b"


def write_mesh(path: str, vertices: DataFrame, elements: DataFrame, by_grain: bool = False) -> None:
    """vertices (id, x, y, z, ref and what else they have) and elements (kind, id, nodes, ...) as Parquet.

    Elements lie in a folder a kind and, if asked for and known, a grain.
    """
    folders = ["kind", "grain"] if by_grain and "grain" in elements.columns else ["kind"]
    for name, df, parts in ((VERTICES, vertices, []), (ELEMENTS, elements, folders)):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*parts).parquet(f"{mesh_path(path)}/{name}")


def read_mesh(spark: SparkSession, path: str, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, elements) of a mesh; colour, grain and ref as the file has them, ref 0 where it has none.

    Only the folders of the kinds asked for are read. Raises ValueError for unknown kinds.
    """
    if unknown := set(kinds or ()) - set(WIDTHS):
        raise ValueError(f"no such kinds of elements: {', '.join(sorted(unknown))}")
    vertices, elements = (spark.read.parquet(f"{mesh_path(path)}/{name}") for name in (VERTICES, ELEMENTS))
    if kinds is not None:
        elements = elements.where(F.col("kind").isin(*kinds))
    fill = lambda df: df if "ref" in df.columns else df.withColumn("ref", F.lit(0))
    return fill(vertices), fill(elements)


def bad_elements(elements: DataFrame, vertices: DataFrame) -> DataFrame:
    """(kind, id) of elements with a wrong number of nodes or a node that is no vertex."""
    width = F.element_at(F.create_map(*(F.lit(x) for item in WIDTHS.items() for x in item)), F.col("kind"))
    short = elements.where(width.isNull() | (F.size("nodes") != width)).select("kind", "id")
    loose = elements.select("kind", "id", F.explode("nodes").alias("node")).join(vertices.select(F.col("id").alias("node")), "node", "left_anti").select("kind", "id")
    return short.union(loose).distinct()


def scan_links(spark: SparkSession, path: str, ids: list[str], nodes: list[str]) -> DataFrame:
    """A table of foreign keys as elements (elem, nodes), straight from Parquet: only the named columns are read."""
    return spark.read.parquet(path).select(F.struct(*ids).alias("elem"), F.array(*(F.col(n).cast("long") for n in nodes)).alias("nodes"))
