"""Every mesh operator as a query over the driver's tables or the mesh they size."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import cli, config, fixtures, session
from gridloom.functions import ranking, sfc
from gridloom.operators import blocks, extract, grains, incidence, loops, renumber
from gridloom.plans.tasks import TaskGraph
from gridloom.sources import mesh_io

WORKERS, GRAINS = 4, 24
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Mesh:
    """The cube mesh sized by sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.n = spark, fixtures.cube_size(spark, sf_dir)
        self.nv, self.nt = (self.n + 1) ** 3, 6 * self.n**3
        self.ver, self.tet = fixtures.vertices(spark, self.n), fixtures.tetrahedra(spark, self.n)
        self.links = incidence.incidence(self.tet)
        self.tet_values = self.tet.select("id", (F.col("id") % 97).alias("value"))
        self.size, self.dep_size = blocks.small_size(self.nt, WORKERS), blocks.dependency_size(self.nv, WORKERS)
        self.matrix = blocks.dependency_matrix(self.links, self.size, self.dep_size)
        self.blocks, self.deps = -(-self.nt // self.size), -(-self.nv // self.dep_size)

    def edges(self) -> DataFrame:
        return extract.unique_edges(self.tet)

    def numbering(self) -> DataFrame:
        return renumber.numbering(renumber.codes_3d(self.ver))

    def grains(self) -> DataFrame:
        return grains.partition(self.numbering(), self.nv, GRAINS)

    def colored(self) -> tuple[DataFrame, DataFrame]:
        """(pairs of adjacent grains, their colours); the grain graph has at most GRAINS squared rows."""
        pairs = session.stored(grains.rank2_adjacency(extract.ball_rank2(self.edges()), self.grains()), "grain-pairs")
        found = grains.coloring([(r["g1"], r["g2"]) for r in pairs.collect()], GRAINS, WORKERS)
        return pairs, self.spark.createDataFrame(sorted(found.items()), "grain long, color long")


def _cube(m: Mesh) -> DataFrame:
    return m.tet.select(F.lit("tet").alias("kind"), "id", "nodes", "ref")


def _nodes_sum(nodes) -> F.Column:
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda total, x: total * 7 % 1000003 + x)


class Mixed:
    """The mesh of all volume kinds, its points on the grid, with the outer faces of two kinds of hull elements."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        n = fixtures.cube_size(spark, sf_dir) // 3 * 3
        self.n, self.nodes = n, (n + 1) ** 3 + n * n * (n // 3) + 2 * n * (n // 3)
        self.elements = fixtures.mixed_elements(spark, n)
        at = F.col("id") - 1
        self.points = spark.range(1, self.nodes + 1).select("id", *((at * k % p).cast("double").alias(c) for c, k, p in zip("xyz", (7, 11, 13), (101, 103, 107))))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), *(e[j].cast("double").alias(c) for j, c in enumerate("xyz")))



# Sources and tables


@query
def mesh_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh of two kinds with colours and grains, written by grain; its tetrahedra are read back."""
    m = Mesh(spark, sf_dir)
    path = session.scratch(spark, "scan")
    grain = F.floor((F.col("id") - 1) * 10 / m.nt).cast("long")
    tets = _cube(m).withColumn("grain", grain).withColumn("color", grain % 3)
    faces = tets.where("id % 5 = 0").select(F.lit("triangle").alias("kind"), F.col("id"), F.slice("nodes", 1, 3).alias("nodes"), "ref", "grain", "color")
    mesh_io.write_mesh(path, m.ver, tets.union(faces), by_grain=True)
    _, read = mesh_io.read_mesh(spark, path, ["tet"])
    return read.select("id", *(F.col("nodes")[i].alias(f"v{i}") for i in range(4)), *(F.col(c).cast("long").alias(c) for c in ("ref", "color", "grain")))


@query
def mesh_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    path = session.scratch(spark, "roundtrip")
    mesh_io.write_mesh(path, m.ver, _cube(m))
    ver, elements = mesh_io.read_mesh(spark, path)
    v = ver.select(F.lit("vertex").alias("kind"), "id", F.array((F.col("x") + F.col("y") * 10 + F.col("z") * 100).cast("long")).alias("a"))
    t = elements.select("kind", "id", F.col("nodes").alias("a"))
    return v.union(t).select("kind", "id", F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s * 7 + x).alias("checksum"))


@query
def link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements straight from a Parquet table of foreign keys."""
    found = mesh_io.scan_links(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return found.select("elem.l_orderkey", "elem.l_linenumber", F.col("nodes")[0].alias("v0"), F.col("nodes")[1].alias("v1"))


@query
def bad_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that a reader must refuse: each seventh tetrahedron lacks a node, each eleventh names one that is not there."""
    m = Mesh(spark, sf_dir)
    nodes = F.when(F.col("id") % 7 == 0, F.slice("nodes", 1, 3)).when(F.col("id") % 11 == 0, F.concat(F.slice("nodes", 1, 3), F.array(F.col("id") + m.nv))).otherwise(F.col("nodes"))
    return mesh_io.bad_elements(_cube(m).withColumn("nodes", nodes), m.ver)


@query
def mesh_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renumber.bounding_box(_cloud(spark, sf_dir), "x", "y", "z")


@query
def type_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    tag = lambda name, df: session.id_report(df).select(F.lit(name).alias("type"), "n", "lo", "hi", "dense")
    return tag("ver", m.ver).union(tag("tet", m.tet))


@query
def type_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    catalog, name = session.MeshSession(spark), f"ver_{uuid.uuid4().hex}"
    catalog.register(name, m.ver.select("id"))
    catalog.resize(name, spark.range(m.nv + 1, m.nv + 11))
    out = session.id_report(spark.table(name)).select("n", "lo", "hi", "dense")
    catalog.free(name)
    return out


# Maps


@query
def map_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).alias("v3"))


@query
def loop_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opaque procedure over contiguous slices."""

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pc.add(pc.multiply(batch.column(1), 3), 1)], names=["id", "v3"])

    return loops.launch(Mesh(spark, sf_dir).ver.select("id", "value"), body, "id long, v3 long", slices=WORKERS)


@query
def loop_multi_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure with arguments of its own."""

    def body(batch: pa.RecordBatch, scale: int, shift: int, names: list[str]) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pc.add(pc.multiply(batch.column(1), scale), shift)], names=names)

    return loops.launch(Mesh(spark, sf_dir).ver.select("id", "value"), body, "id long, v3 long", 5, -2, ["id", "v3"])


@query
def map_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda v, c: F.exp(F.log(F.acos(F.cos(v + c))))
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(part(F.col("p_size"), 1) + part(F.col("p_size") * 2, 2), 6).alias("v3"))


@query
def copy_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mesh(spark, sf_dir).ver.select("id", "value")


@query
def mem_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0.0).alias("o_totalprice"))


@query
def mem_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("copy"))


@query
def block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return m.tet.select("id", blocks.block_of(F.col("id"), m.size).alias("blk"))


@query
def block_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return blocks.interleaved(m.tet, m.nt, WORKERS, factor=7)


@query
def block_interleave_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return config.EngineConfig(workers=WORKERS, interleaving_size=11).interleaved(m.tet, m.nt)


@query
def block_interleave_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices too long for any worker to get one: each gets an equal part."""
    m = Mesh(spark, sf_dir)
    return blocks.interleaved(m.tet, m.nt, WORKERS, size=m.nt)


@query
def fk_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    order = m.ver.select(F.col("id").alias("old_id"), fixtures.shuffled(F.col("id"), m.nv).alias("new_id"))
    return incidence.remapped(m.tet, order).select("id", *(F.col("nodes")[i].alias(f"v{i}") for i in range(4)))


@query
def permute_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return renumber.permuted(m.ver.select("id", "value"), m.numbering())


# Gather, scatter, reductions


@query
def gather_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.gather(m.links, m.ver)


@query
def gather_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.gather(m.links, m.ver, "mean")


@query
def scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.scatter(m.links, m.tet_values, m.ver)


@query
def locked_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums as scatter_add: a commutative aggregate needs no locks."""
    return scatter_add(spark, sf_dir)


@query
def scatter_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.scatter(m.links, m.tet_values, m.ver, "mean").select("id", F.round("value", 6).alias("value"))


@query
def smooth_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.smooth(m.links, m.ver, 2).select("id", F.round("value", 6).alias("value"))


@query
def tet_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.iterated(incidence.degrees(m.links, m.ver)).select("id", F.round("value", 6).alias("value"))


@query
def reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.reduce(_table(spark, sf_dir, "lineitem"), max_price=F.max("l_extendedprice"), max_quantity=F.max("l_quantity"))


@query
def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.reduce(_table(spark, sf_dir, "lineitem"), total=F.sum(F.col("l_quantity").cast("long")), residual=F.round(F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity"))), 6))


def _fan_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, element values and vertices of the fan mesh's tetrahedra."""
    n = fixtures.cube_size(spark, sf_dir)
    tets = fixtures.fan_elements(spark, n).where("kind = 'tet'")
    return incidence.incidence(tets), tets.select("id", (F.col("id") % 97).alias("value")), spark.range(1, fixtures.fan_nodes(n) + 1)


@query
def ragged_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over whole balls, however large; the last hub of the fan mesh is isolated."""
    links, values, nodes = _fan_links(spark, sf_dir)
    return incidence.ragged_sum(links, values, nodes)


@query
def ragged_sum_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of 64 entries a ball, which leaves out what a larger ball has more."""
    links, values, nodes = _fan_links(spark, sf_dir)
    return incidence.padded_sum(links, values, nodes, 64)


@query
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.csr_offsets(incidence.degrees(m.links, m.ver))


@query
def supplier_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gather over the lineitem incidence: sizes of each order's parts."""
    links = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"))
    return incidence.gather(links, _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("value")))


@query
def part_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter over the lineitem incidence: quantity that reaches each part."""
    lines = _table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("elem"), F.col("l_partkey").alias("node"), F.col("l_quantity").cast("long").alias("value"))
    return incidence.scattered(lines, _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


# Topology


@query
def unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mesh(spark, sf_dir).edges()


@query
def edge_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return ranking.ranked(m.edges(), [F.col("a"), F.col("b")], "pos")


@query
def tet_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.tet_neighbours(Mesh(spark, sf_dir).tet)


@query
def neighbour_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.tet_neighbours(Mesh(spark, sf_dir).tet).where("ngb > 0")
    back = found.select(F.col("tet_id").alias("ngb"), F.col("face").alias("voy"), F.col("ngb").alias("back"))
    return found.join(back, ["ngb", "voy"], "left").agg(F.sum((~F.col("back").eqNullSafe(F.col("tet_id"))).cast("long")).alias("violations"))


@query
def surface_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.surface(Mesh(spark, sf_dir).tet)


@query
def mixed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.mixed_neighbours(fixtures.mixed_elements(spark, fixtures.cube_size(spark, sf_dir)))


@query
def boundary_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.boundary_vertices(fixtures.mixed_elements(spark, fixtures.cube_size(spark, sf_dir)))


@query
def ball_rank1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.ball_rank1(Mesh(spark, sf_dir).edges())


@query
def ball_rank2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.ball_rank2(Mesh(spark, sf_dir).edges())


@query
def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return incidence.degrees(m.links, m.ver)


@query
def vertex_degree_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mixed(spark, sf_dir)
    return renumber.degrees_by_kind(m.elements, m.points).select("id", "tet", "pyramid", "prism", "hex")


@query
def degree_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High and over-connected vertices of the fan mesh, the largest degree and the vector size of each kind."""
    n = fixtures.cube_size(spark, sf_dir)
    points = spark.range(1, fixtures.fan_nodes(n) + 1)
    found = renumber.degree_summary(renumber.degree_classes(renumber.degrees_by_kind(fixtures.fan_elements(spark, n), points)))
    return found.select("kind", "max_deg", "vec_size", "high", "over", F.round("high_pct", 6).alias("high_pct"), F.round("over_pct", 6).alias("over_pct"))


def _slices(degree: DataFrame, out: bool) -> DataFrame:
    return renumber.slice_histogram(degree, out).select("slice", "n", F.round("pct", 6).alias("pct"), F.round("fill_pct", 6).alias("fill_pct"))


@query
def edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return extract.edge_degrees(m.edges(), m.ver)


@query
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by unique edges."""
    m = Mesh(spark, sf_dir)
    return _slices(extract.edge_degrees(m.edges(), m.ver), False)


@query
def degree_histogram_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of the fan mesh, whose first hub has more edges than any slice holds."""
    n = fixtures.cube_size(spark, sf_dir)
    edges = extract.unique_edges(fixtures.fan_elements(spark, n).where("kind = 'tet'"))
    return _slices(extract.edge_degrees(edges, spark.range(1, fixtures.fan_nodes(n) + 1)), True)


# Curves and renumbering


@query
def hilbert_code_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renumber.codes_3d(_cloud(spark, sf_dir))


@query
def zcurve_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renumber.codes_3d(_cloud(spark, sf_dir), sfc.z_curve)


@query
def hilbert_code_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renumber.codes_2d(_cloud(spark, sf_dir))


@query
def hilbert_renumber_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renumber.numbering(renumber.codes_3d(_cloud(spark, sf_dir)))


@query
def hilbert_renumber_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renumber.numbering(renumber.codes_2d(_cloud(spark, sf_dir)))


@query
def random_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbering by hash, judged by its invariant: violations of being a permutation."""
    m = Mesh(spark, sf_dir)
    code = F.shiftrightunsigned(F.xxhash64("id"), 1)
    found = renumber.numbering(m.ver.select("id", code.alias("code")))
    return found.agg((F.abs(F.count("*") - F.count_distinct("new_id")) + F.abs(F.count("*") - F.max("new_id")) + F.abs(F.min("new_id") - 1)).cast("long").alias("violations"))


@query
def topo_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return m.tet.select("id", sfc.hilbert_pair(F.array_min("nodes"), F.array_max("nodes")).alias("code"))


@query
def barycentre(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return renumber.barycentres(m.tet, m.ver).select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query
def aniso_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return renumber.anchors(m.tet, m.ver.withColumn("z", F.col("z") * 10)).select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query
def composite_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by part of the label, then by curve code, then by id."""
    cloud = _cloud(spark, sf_dir)
    codes = renumber.codes_3d(cloud).join(_table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), F.col("label").cast("long").alias("grain")), "id")
    return ranking.ranked(codes, [F.col("grain"), F.col("code"), F.col("id")]).select(F.col("id").alias("old_id"), "new_id")


@query
def ref_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", sfc.ref_hash((F.col("o_orderkey") * 7919 % 2147483647).cast("int")).alias("code"))


@query
def renumber_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    moved = m.tet.select("id", F.transform("nodes", lambda v: fixtures.shuffled(v, m.nv)).alias("nodes"))
    tag = lambda name, df: renumber.quality(df, 4).select(F.lit(name).alias("mesh"), F.round("quality", 9).alias("quality"))
    return tag("natural", m.tet).union(tag("shuffled", moved))


@query
def mesh_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    _, moved = renumber.renumbered_mesh(m.ver, _cube(m))
    return moved.select(F.col("new_id").alias("id"), *(F.col("nodes")[i].alias(f"v{i}") for i in range(4)))


def _moved(spark: SparkSession, sf_dir: str, how: renumber.Renumbering) -> DataFrame:
    m = Mixed(spark, sf_dir)
    points = m.points.withColumns({"grain": F.col("id") % 12, "color": F.col("id") % 12 % 3})
    order, elements = renumber.renumbered_mesh(points, m.elements.withColumn("ref", fixtures.reference(F.col("id"))), how)
    vertices = order.select(F.lit("vertex").alias("kind"), "old_id", "new_id", F.lit(0).cast("long").alias("nodes"), "grain")
    return vertices.union(elements.select("kind", "old_id", "new_id", _nodes_sum(F.col("nodes")).alias("nodes"), "grain"))


@query
def mesh_renumber_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and all kinds of elements in one go."""
    return _moved(spark, sf_dir, renumber.Renumbering())


@query
def mesh_renumber_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour before grain before the curve."""
    return _moved(spark, sf_dir, renumber.Renumbering(colors=True))


@query
def mesh_renumber_octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, renumber.Renumbering(scheme=1))


@query
def mesh_renumber_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scheme that keeps the numbering."""
    return _moved(spark, sf_dir, renumber.Renumbering(scheme=3))


@query
def mesh_renumber_topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by their least and largest node."""
    return _moved(spark, sf_dir, renumber.Renumbering(scheme=4))


@query
def mesh_renumber_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the fan mesh by matrix slice, then as numbered: hubs of many edges come last."""
    n = fixtures.cube_size(spark, sf_dir)
    points = spark.range(1, fixtures.fan_nodes(n) + 1).select("id", *((F.col("id") % p).cast("double").alias(c) for c, p in zip("xyz", (101, 103, 107))))
    order, _ = renumber.renumbered_mesh(points, fixtures.fan_elements(spark, n), renumber.Renumbering(scheme=3, gmlib="matrix"))
    return order.select("old_id", "new_id")


@query
def mesh_renumber_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High vertices last; triangles and quads by the hash of their reference; then as numbered."""
    n = fixtures.cube_size(spark, sf_dir)
    points = spark.range(1, fixtures.fan_nodes(n) + 1).select("id", *((F.col("id") % p).cast("double").alias(c) for c, p in zip("xyz", (101, 103, 107))))
    elements = fixtures.fan_elements(spark, n).withColumn("ref", (F.col("id") * 7919).cast("int"))
    order, moved = renumber.renumbered_mesh(points, elements, renumber.Renumbering(scheme=3, gmlib="generic"))
    return order.select(F.lit("vertex").alias("kind"), "old_id", "new_id").union(moved.select("kind", "old_id", "new_id"))


@query
def mesh_renumber_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command's way: boundary vertices stay, and element nodes follow the others."""
    m = Mesh(spark, sf_dir)
    _, moved, _ = cli.renumber_mesh(m.ver, _cube(m), renumber.Renumbering(), fixed=True)
    return moved.select("id", *(F.col("nodes")[i].alias(f"v{i}") for i in range(4)))


@query
def renumber_fixbnd(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    surface = extract.surface(m.tet).where("ref = 0").select(F.explode(F.array("n0", "n1", "n2")).alias("id")).distinct()
    return renumber.fixed_boundary(m.ver, surface)


@query
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id both ways: where it goes, and what comes to its place."""
    m = Mesh(spark, sf_dir)
    return renumber.looked_up(m.ver, m.numbering())


@query
def restore_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    order = m.numbering()
    return renumber.restored(renumber.permuted(m.ver.select("id", "value"), order), order)


# Sorts


@query
def radix_sort_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"))
    return ranking.ranked(rows, [F.col("key"), F.col("seq")], "pos")


@query
def radix_sort_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") * 4294967296 + F.col("o_orderkey") % 1024).alias("key"), F.col("o_orderkey").alias("seq"))
    return ranking.ranked(rows, [F.col("key"), F.col("seq")], "pos")


@query
def radix_sort_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 2**63 and more, as signed longs below 0, come after all others."""
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).alias("key"), F.col("o_orderkey").alias("seq"))
    return ranking.ranked(rows, [ranking.unsigned(F.col("key")), F.col("seq")], "pos")


@query
def comparator_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ranking.ranked(rows, [F.col("c_mktsegment"), F.desc("c_acctbal"), F.col("c_custkey")], "pos").select("c_custkey", "pos")


@query
def range_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber")
    return ranking.ranked(rows, [F.col("key"), F.col("l_orderkey"), F.col("l_linenumber")], "pos")


# Blocks


@query
def block_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    tag = lambda name, df: df.select(F.lit(name).alias("level"), "blk", "beg", "end_")
    return tag("small", blocks.ranges(m.tet, m.size)).union(tag("big", blocks.big_ranges(m.tet, m.nt, WORKERS)))


@query
def dependency_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mesh(spark, sf_dir).matrix


@query
def dependency_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    more = spark.range(1, 11).select(F.col("id").alias("elem"), (m.nv + 1 - F.col("id")).alias("node"))
    sets = spark.range(1).select(F.array(F.lit(1).cast("long"), F.lit(m.nt).cast("long")).alias("elems"), F.array(F.lit(m.nv // 2).cast("long"), F.lit(1).cast("long")).alias("nodes"))
    return blocks.added_fast(blocks.added(m.matrix, more, m.size, m.dep_size), sets, m.size, m.dep_size)


@query
def dependency_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an update returns: the dependencies of the block, 0 for ids out of range."""
    m = Mesh(spark, sf_dir)
    pairs = spark.range(0, 21).select((F.col("id") * (m.nt // 10)).alias("elem"), (m.nv + 3 - F.col("id")).alias("node"))
    return blocks.counted(m.matrix, pairs, m.nt, m.nv, m.size, m.dep_size)


@query
def dependency_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block sizes of several tables, with and without a size in use before."""
    m = Mesh(spark, sf_dir)
    settings = config.EngineConfig(workers=2, small_block=8, dependency_block=16)
    cases = [(rows, before, settings.small_size(rows), settings.dependency_size(rows, before)) for rows in (1, 15, 16, 31, 32, m.nv, m.nt) for before in (0, 1, 100)]
    return spark.createDataFrame(cases, "n long, before long, small long, dep long")


@query
def dependency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    return blocks.dependency_stats(m.matrix, m.blocks, m.deps).select(F.round("avg_pct", 6).alias("avg_pct"), F.round("max_pct", 6).alias("max_pct"))


@query
def block_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.collisions(Mesh(spark, sf_dir).matrix)


@query
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_order(Mesh(spark, sf_dir).matrix)


@query
def block_launch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of launch without sorting by dependencies."""
    return config.EngineConfig(workers=WORKERS).scheduled(Mesh(spark, sf_dir).matrix).select("blk", "grp", "pos")


@query
def bitset_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.bit_algebra(Mesh(spark, sf_dir).matrix, 3, 4)


@query
def halve_small_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.halved(Mesh(spark, sf_dir).matrix, "blk")


@query
def halve_dep_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.halved(Mesh(spark, sf_dir).matrix, "dep")


@query
def adaptive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = Mesh(spark, sf_dir).matrix.groupBy("blk").agg(F.count("*").alias("weight"))
    return blocks.adaptive_split(weights, 8)


@query
def static_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the schedule: pairs of blocks of one group and different workers that share a dependency, and blocks not scheduled once."""
    m = Mesh(spark, sf_dir)
    pairs = [(r["blk"], r["dep"]) for r in m.matrix.collect()]  # block counts bound it, not the mesh
    plan = spark.createDataFrame(blocks.static_schedule(pairs, WORKERS), "blk long, grp long, worker long")
    mine = m.matrix.join(plan, "blk").select("grp", "worker", "dep").distinct()
    clashes = mine.groupBy("grp", "dep").agg(F.count("*").alias("workers")).agg(F.sum((F.col("workers") > 1).cast("long")).alias("violations"))
    missed = plan.agg((F.abs(F.count("*") - m.blocks) + F.abs(F.count_distinct("blk") - m.blocks)).alias("violations"))
    return clashes.union(missed).agg(F.sum("violations").cast("long").alias("violations"))


# Grains


@query
def grain_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mesh(spark, sf_dir).grains()


@query
def grain_coloring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the colouring: grains of one colour two edges apart, and grains without colour."""
    pairs, colors = Mesh(spark, sf_dir).colored()
    return grains.clashes(pairs, colors).agg(F.count("*").alias("violations")).union(colors.agg(F.abs(F.count_distinct("grain") - GRAINS).alias("violations"))).agg(F.sum("violations").cast("long").alias("violations"))


@query
def grain_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grain graph that colours rest on."""
    m = Mesh(spark, sf_dir)
    return grains.rank2_adjacency(extract.ball_rank2(m.edges()), m.grains())


@query
def grain_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a colouring by grain number modulo 5 gets wrong."""
    m = Mesh(spark, sf_dir)
    colors = spark.range(GRAINS).select(F.col("id").alias("grain"), (F.col("id") % 5).alias("color"))
    return grains.clashes(grains.rank2_adjacency(extract.ball_rank2(m.edges()), m.grains()), colors)


@query
def color_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three colours in turn: each adds to the vertices of its tetrahedra the sums that the colours before it left."""
    m = Mesh(spark, sf_dir)
    rows = m.tet.select("id", "nodes", (F.floor((F.col("id") - 1) * 12 / m.nt) % 3).cast("long").alias("color"))

    def step(state: DataFrame, own: DataFrame) -> DataFrame:
        links = incidence.incidence(own)
        added = incidence.scatter(links, incidence.gather(links, state).select("id", (F.col("value") % 97).alias("value")), state)
        return state.join(added.withColumnRenamed("value", "more"), "id").select("id", (F.col("value") + F.col("more")).alias("value"))

    return grains.launch_colors(rows, [0, 1, 2], step, m.ver.select("id", "value"))


@query
def color_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations under a deliberately coarse colouring, grains by hundredths of the ids and two colours."""
    m = Mesh(spark, sf_dir)
    grain = F.floor((F.col("elem") - 1) * 100 / m.nt).cast("long")
    rows = m.links.withColumn("grain", grain).withColumn("color", F.col("grain") % 2)
    return renumber.first_touch(rows)


@query
def grain_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    owned = m.tet.select("id", F.floor((F.col("id") - 1) * 10 / m.nt).cast("long").alias("grain"))
    return grains.ranges(owned, spark.range(12).withColumnRenamed("id", "grain"))


@query
def grain_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    owned = m.ver.select("id", F.floor((F.col("id") - 1) * 12 / m.nv).cast("long").alias("grain"))
    colors = spark.range(12).select(F.col("id").alias("grain"), (F.col("id") % 3).alias("color"))
    return grains.dependencies(extract.ball_rank2(m.edges()), owned, colors)


@query
def grain_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    rows = m.tet.select("id", F.floor((F.col("id") - 1) * 10 / m.nt).cast("long").alias("label")).withColumn("label", F.col("label") * 7 % 10)
    return renumber.run_labels(rows, "id", "label").select("id", "label", "run")


@query
def grain_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mesh(spark, sf_dir)
    rows = m.tet.select("id", F.floor((F.col("id") - 1) * 10 / m.nt).cast("long").alias("grain"))

    def tag(frame):
        frame["ref"] = frame["grain"] * 10 + frame["id"] % 10
        return frame[["id", "ref"]]

    return grains.apply(rows, tag, "id long, ref long")


@query
def pipeline_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reductions at once, then one task that needs both."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    graph, done = TaskGraph(3), {}
    a = graph.launch(lambda: done.update(lines=lines.count()))
    b = graph.launch(lambda: done.update(orders=orders.count()))
    graph.launch(lambda: done.update(ratio=round(done["lines"] / done["orders"], 6)), after=(a, b))
    graph.wait()
    return spark.range(1).select(F.lit(done["lines"]).cast("long").alias("lines"), F.lit(done["orders"]).cast("long").alias("orders"), F.lit(done["ratio"]).alias("ratio"))
