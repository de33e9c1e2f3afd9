"""Edges, face neighbours, surfaces, boundaries and vertex balls of meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.incidence import degrees
from gridloom.topology import KINDS, TET, TET_EDGES, VOLUMES


def unique_edges(tets: DataFrame) -> DataFrame:
    """(a, b) with a < b: the distinct edges of tetrahedra (column nodes)."""
    ends = lambda p, q: F.struct(F.least(F.col("nodes")[p], F.col("nodes")[q]).alias("a"), F.greatest(F.col("nodes")[p], F.col("nodes")[q]).alias("b"))
    return tets.select(F.explode(F.array(*(ends(p, q) for p, q in TET_EDGES))).alias("e")).select("e.a", "e.b").distinct()


def edge_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, deg): how many distinct edges (a, b) end at each node, 0 for isolated ones."""
    return degrees(edges.select(F.explode(F.array("a", "b")).alias("node")), nodes)


def _sorted3(a: Column, b: Column, c: Column) -> Column:
    """Array of three ids in rising order, inside generated code."""
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    return F.array(low, a + b + c - low - high, high)


def _tet_faces(tets: DataFrame, *more: str) -> DataFrame:
    nodes = F.col("nodes")
    keys = F.array(*(_sorted3(*(nodes[i] for i in face)) for face in TET.faces))
    return tets.select(F.col("id").alias("tet_id"), *more, F.posexplode(keys).alias("face", "key"))


def _paired(faces: DataFrame, key: list[str], own: str) -> DataFrame:
    """faces with n (how many share the face) and the sums that name the other side."""
    same = Window.partitionBy(*key)
    return faces.withColumns({"n": F.count("*").over(same), "own_sum": F.sum(own).over(same), "face_sum": F.sum("face").over(same)})


def tet_neighbours(tets: DataFrame) -> DataFrame:
    """(tet_id, face, ngb, voy): the tetrahedron behind each face and the face's number there, 0 for none.

    A face of more than two tetrahedra has no neighbour. One exchange by face key: both
    sides come from sums over the pair.
    """
    nodes = F.col("key")
    faces = _tet_faces(tets).select("tet_id", "face", nodes[0].alias("k0"), nodes[1].alias("k1"), nodes[2].alias("k2"))
    two = F.col("n") == 2
    return _paired(faces, ["k0", "k1", "k2"], "tet_id").select(
        "tet_id", F.col("face").cast("long").alias("face"), F.when(two, F.col("own_sum") - F.col("tet_id")).otherwise(0).cast("long").alias("ngb"), F.when(two, F.col("face_sum") - F.col("face")).otherwise(0).cast("long").alias("voy")
    )


def surface(tets: DataFrame) -> DataFrame:
    """(n0, n1, n2, ref): boundary triangles (ref 0) and, seen from the larger tet, those between two refs (ref 1).

    Nodes keep the order of the tet's outward face.
    """
    nodes, key = F.col("nodes"), F.col("key")
    turned = F.array(*(F.array(*(nodes[i] for i in face)) for face in TET.faces))
    faces = _tet_faces(tets.withColumn("turned", turned), "ref", "turned").select("tet_id", "face", "ref", F.col("turned")[F.col("face")].alias("t"), key[0].alias("k0"), key[1].alias("k1"), key[2].alias("k2"))
    same = Window.partitionBy("k0", "k1", "k2")
    paired = _paired(faces, ["k0", "k1", "k2"], "tet_id").withColumn("ref_sum", F.sum("ref").over(same))
    bare = F.col("n") != 2
    between = (F.col("n") == 2) & (F.col("ref_sum") != 2 * F.col("ref")) & (F.col("tet_id") > F.col("own_sum") - F.col("tet_id"))
    return paired.where(bare | between).select(F.col("t")[0].alias("n0"), F.col("t")[1].alias("n1"), F.col("t")[2].alias("n2"), F.when(bare, 0).otherwise(1).cast("long").alias("ref"))


def global_ids(elements: DataFrame) -> DataFrame:
    """elements (kind, id, nodes) of the volume kinds with gid, counting through the kinds in their order."""
    counts = elements.groupBy("kind").agg(F.count("*").alias("n"))
    order = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(VOLUMES) for x in (k.name, i))), F.col("kind"))
    offsets = counts.select("kind", F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a kind
    return elements.join(F.broadcast(offsets), "kind").withColumn("gid", (F.col("before") + F.col("id")).cast("long")).drop("before")


def volume_faces(elements: DataFrame) -> DataFrame:
    """(gid, face, k0, k1, k2, fnodes) of elements (kind, id, nodes) of several volume kinds.

    Keys are the sorted nodes of a triangle; of a quad its least node, the opposite one and
    0. The local face numbering is a table of nineteen rows, joined by kind.
    """
    numbering = [(k.name, j, list(face)) for k in VOLUMES for j, face in enumerate(KINDS[k.name].faces)]
    local = elements.sparkSession.createDataFrame(numbering, "kind string, face int, at array<int>")
    faces = global_ids(elements).join(F.broadcast(local), "kind").select("gid", "face", F.transform("at", lambda i: F.get("nodes", i)).alias("fnodes"))
    a, b, c, d = (F.get("fnodes", F.lit(i)) for i in range(4))
    low, quad = F.least(a, b, c, d), F.size("fnodes") == 4
    high = F.greatest(a, b, c)
    opposite = F.when(a == low, c).when(b == low, d).when(c == low, a).otherwise(b)
    return faces.select("gid", "face", low.alias("k0"), F.when(quad, opposite).otherwise(a + b + c - low - high).alias("k1"), F.when(quad, F.lit(0).cast("long")).otherwise(high).alias("k2"), "fnodes")


def mixed_neighbours(elements: DataFrame) -> DataFrame:
    """(gid, face, ngb): the element of any volume kind behind each face, 0 for none."""
    paired = _paired(volume_faces(elements).drop("fnodes"), ["k0", "k1", "k2"], "gid")
    return paired.select("gid", F.col("face").cast("long").alias("face"), F.when(F.col("n") == 2, F.col("own_sum") - F.col("gid")).otherwise(0).cast("long").alias("ngb"))


def boundary_vertices(elements: DataFrame) -> DataFrame:
    """(id): the vertices on faces without neighbour."""
    paired = _paired(volume_faces(elements), ["k0", "k1", "k2"], "gid")
    return paired.where("n <> 2").select(F.explode("fnodes").alias("id")).distinct()


def ball_rank1(edges: DataFrame) -> DataFrame:
    """(id, ngb): both directions of every edge."""
    return edges.select(F.col("a").alias("id"), F.col("b").alias("ngb")).union(edges.select(F.col("b").alias("id"), F.col("a").alias("ngb")))


def ball_rank2(edges: DataFrame) -> DataFrame:
    """(id, ngb): distinct ends of walks of two edges, the start left out."""
    one = ball_rank1(edges)
    two = one.join(one.select(F.col("id").alias("ngb"), F.col("ngb").alias("far")), "ngb")
    return two.where("id <> far").select("id", F.col("far").alias("ngb")).distinct()
