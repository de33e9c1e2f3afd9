"""Renumbers a mesh: python -m gridloom.cli -in mesh -out mesh [options]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.operators import blocks, extract, renumber
from gridloom.session import stored
from gridloom.sources import mesh_io
from gridloom.topology import VOLUMES


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridloom", description="Renumber a mesh along a curve.", allow_abbrev=False)
    out.add_argument("-in", dest="source", required=True, help="mesh to read")
    out.add_argument("-out", dest="target", required=True, help="mesh to write")
    out.add_argument("-scheme", type=int, default=0, choices=range(5), help="0 Hilbert, 1 octree, 2 random, 3 none, 4 Hilbert and topological")
    out.add_argument("-gmlib", default="", choices=("generic", "matrix"), help="rank 2: degrees and references, or matrix slices")
    out.add_argument("-colors", action="store_true", help="ranks 4 and 3: the vertices' colours and grains")
    out.add_argument("-fixbnd", action="store_true", help="boundary vertices keep their numbers")
    out.add_argument("-stats", action="store_true", help="print block dependencies before and after")
    out.add_argument("-nproc", type=int, default=0, help="workers; 0: all cores")
    return out


def stats(elements: DataFrame, vertices: int, workers: int) -> list[tuple[str, float, float]]:
    """(kind, average, largest share in percent) of the vertex blocks that a block of elements touches."""
    out = []
    dep = blocks.dependency_size(vertices, workers)
    for kind, rows in sorted(elements.groupBy("kind").count().collect()):
        links = elements.where(F.col("kind") == kind).select(F.col("id").alias("elem"), F.explode("nodes").alias("node"))
        size = blocks.small_size(rows, workers)
        found = blocks.dependency_stats(blocks.dependency_matrix(links, size, dep), -(-rows // size), -(-vertices // dep)).first()
        out.append((kind, found["avg_pct"], found["max_pct"]))
    return out


def renumber_mesh(vertices: DataFrame, elements: DataFrame, how: renumber.Renumbering, fixed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(vertices, elements, grain ranges) in their new order; `fixed`: boundary vertices stay, elements follow the others.

    Ranges (kind, grain, beg, end_) come with colours only.
    """
    order, moved = renumber.renumbered_mesh(vertices, elements, how)
    if fixed:
        volumes = elements.where(F.col("kind").isin(*(k.name for k in VOLUMES)))
        order = stored(renumber.fixed_boundary(vertices, extract.boundary_vertices(volumes)), "order")
        at_rest = moved.select("kind", "old_id", F.col("new_id").alias("place")).join(elements.withColumnRenamed("id", "old_id"), ["kind", "old_id"])
        links = at_rest.select("kind", "place", F.posexplode("nodes").alias("slot", "node")).join(order.select(F.col("old_id").alias("node"), "new_id"), "node")
        nodes = links.groupBy("kind", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "new_id"))), lambda s: s["new_id"]).alias("nodes"))  # a kind's nodes
        moved = moved.drop("nodes").join(nodes.withColumnRenamed("place", "new_id"), ["kind", "new_id"])
    new_vertices = renumber.permuted(vertices, order.select("old_id", "new_id"))
    new_elements = moved.select("kind", F.col("new_id").alias("id"), "nodes", "ref", "color", "grain")
    ranges = new_elements.groupBy("kind", "grain").agg(F.min("id").alias("beg"), F.max("id").alias("end_")) if how.colors else None
    return new_vertices, new_elements, ranges


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or config.start(config.EngineConfig(workers=args.nproc))
    vertices, elements = mesh_io.read_mesh(spark, args.source)
    how = renumber.Renumbering(args.scheme, args.colors, args.gmlib or "")
    moved_vertices, moved, _ = renumber_mesh(vertices, elements, how, args.fixbnd)
    mesh_io.write_mesh(args.target, moved_vertices, moved, by_grain=args.colors)
    if args.stats:
        count = vertices.count()
        for when, mesh in (("before", elements), ("after", moved)):
            for kind, mean, most in stats(mesh, count, args.nproc or config.cores()):
                print(f"{when} {kind}: {mean:.3f} % of the vertex blocks on average, {most:.3f} % at most")


if __name__ == "__main__":
    main(sys.argv[1:])
