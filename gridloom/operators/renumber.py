"""Renumbering of vertices and elements along curves, and its use and quality."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import sfc
from gridloom.functions.ranking import ranked, running_before
from gridloom.operators.incidence import degrees, incidence
from gridloom.session import stored
from gridloom.topology import FACE_KINDS, KINDS, SLICES, TET_EDGES, VOLUMES

SMALL_VERTICES, PART_VERTICES = 1 << 17, 1 << 14
#: Up to 200 partitions Spark's shuffles keep a file with its buffers open for each, in every task and beyond its memory's accounts.
LEAST_PARTS, MANY_ROWS = 201, 1 << 17


def bounding_box(points: DataFrame, *axes: str) -> DataFrame:
    """One row: lo and hi of each axis."""
    return points.agg(*(f(c).alias(f"{c}_{n}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))))


def _boxed(points: DataFrame, axes: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    box = bounding_box(points, *axes)
    return points.crossJoin(F.broadcast(box)), [F.col(f"{c}_{n}") for n in ("lo", "hi") for c in axes]  # the box is one row


def codes_3d(points: DataFrame, curve=sfc.hilbert_3d) -> DataFrame:
    """(id, code) of points (id, x, y, z) in their own bounding box."""
    rows, box = _boxed(points, ("x", "y", "z"))
    return rows.select("id", curve(F.col("x"), F.col("y"), F.col("z"), box).alias("code"))


def codes_2d(points: DataFrame) -> DataFrame:
    """(id, code) of points (id, x, y)."""
    rows, box = _boxed(points, ("x", "y"))
    return rows.select("id", sfc.hilbert_2d(F.col("x"), F.col("y"), box).alias("code"))


def numbering(codes: DataFrame) -> DataFrame:
    """(old_id, new_id): ranks by code, ties by old id."""
    return ranked(codes, [F.col("code"), F.col("id")]).select(F.col("id").alias("old_id"), "new_id")


def barycentres(elements: DataFrame, points: DataFrame) -> DataFrame:
    """(id, x, y, z): mean of each element's nodes."""
    links = incidence(elements).join(points.select(F.col("id").alias("node"), "x", "y", "z"), "node")
    return links.groupBy(F.col("elem").alias("id")).agg(*(F.avg(c).alias(c) for c in "xyz"))


def anchors(tets: DataFrame, points: DataFrame) -> DataFrame:
    """(id, x, y, z): the barycentre, or the middle of the longest edge of a tet whose longest edge is over three times its shortest.

    The first of equally long edges counts.
    """
    links = incidence(tets).join(points.select(F.col("id").alias("node"), "x", "y", "z"), "node")
    corners = links.groupBy(F.col("elem").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slot", "x", "y", "z"))).alias("c"))
    c = F.col("c")

    def edge(p: int, q: int) -> Column:
        square = sum(((c[p][a] - c[q][a]) * (c[p][a] - c[q][a]) for a in "xyz"), F.lit(0.0))
        return F.struct(square.alias("len"), *(((c[p][a] + c[q][a]) / 2).alias(a) for a in "xyz"))

    lengths = corners.select("id", "c", F.array(*(edge(p, q) for p, q in TET_EDGES)).alias("e"))
    longest, shortest = F.array_max(F.transform("e", lambda e: e["len"])), F.array_min(F.transform("e", lambda e: e["len"]))
    middle = F.filter("e", lambda e: e["len"] == longest)[0]
    mean = {a: (c[0][a] + c[1][a] + c[2][a] + c[3][a]) / 4 for a in "xyz"}
    long = longest > 9 * shortest
    return lengths.select("id", *(F.when(long, middle[a]).otherwise(mean[a]).alias(a) for a in "xyz"))


@dataclass(frozen=True)
class Renumbering:
    """What decides the order, from rank 4 down to 1: colour, grain, degree or face reference, scheme.

    scheme: 0 Hilbert, 1 octree, 2 random, 3 as numbered, 4 Hilbert for vertices and
    topological for elements. colors: rank by the vertices' columns color and grain; an
    element has those of its first node. gmlib: "generic" ranks vertices by high degree and
    faces by the hash of their reference, "matrix" vertices by their slice of unique edges.
    """

    scheme: int = 0
    colors: bool = False
    gmlib: str = ""

    def __post_init__(self):
        if self.scheme not in range(5) or self.gmlib not in ("", "generic", "matrix"):
            raise ValueError("scheme is 0 to 4, gmlib empty, generic or matrix")


def scheme_code(scheme: int, points: DataFrame, box: list[Column]) -> Column:
    """Rank 1 of points (id, x, y, z)."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    if scheme in (0, 4):
        return sfc.hilbert_3d(x, y, z, box)
    if scheme == 1:
        return sfc.z_curve(x, y, z, box)
    return F.shiftrightunsigned(F.xxhash64("id"), 1) if scheme == 2 else F.col("id").cast("long")


def _vertex_rank2(points: DataFrame, elements: DataFrame, gmlib: str) -> DataFrame:
    """points with rank2: 1 for high degree (generic), or the number of the vertex's matrix slice."""
    if gmlib == "generic":
        high = degree_classes(degrees_by_kind(elements, points.select("id"))).select("id", F.col("high").cast("int").alias("rank2"))
        return points.join(high, "id")
    if gmlib == "matrix":
        edges = elements.where("kind = 'tet'")
        ends = F.explode(F.array(*(F.struct(F.least(F.col("nodes")[p], F.col("nodes")[q]).alias("a"), F.greatest(F.col("nodes")[p], F.col("nodes")[q]).alias("b")) for p, q in TET_EDGES)))
        links = edges.select(ends.alias("e")).select("e.a", "e.b").distinct().select(F.explode(F.array("a", "b")).alias("node"))
        return points.join(degrees(links, points.select("id")).select("id", slice_of(F.col("deg")).alias("rank2")), "id")
    return points.withColumn("rank2", F.lit(0))


def _linked(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """links (kind, elem, ref, slot, node) with the columns of their vertices, exchanged by element if the vertices are many.

    Only up to SMALL_VERTICES are broadcast: as files they are a few bytes a row, as a hash
    relation over a hundred, so Spark's own limit on the files' size would take all memory.
    Beyond, PART_VERTICES a task are hashed and links stream past them unsorted. Tasks are
    counted here, as Spark would merge small ones until each core has just one.
    """
    named = vertices.withColumnRenamed("old_id", "node")
    n = vertices.count()
    if n <= SMALL_VERTICES:
        return links.join(F.broadcast(named), "node")
    parts = max(LEAST_PARTS, -(-n // PART_VERTICES))
    return links.repartition(parts, "node").join(named.repartition(parts, "node").hint("shuffle_hash"), "node").repartition(parts, "kind", "elem")


def renumbered_mesh(points: DataFrame, elements: DataFrame, how: Renumbering = Renumbering()) -> tuple[DataFrame, DataFrame]:
    """Vertices (old_id, new_id, color, grain) and elements (kind, old_id, new_id, nodes, ref, color, grain) in their new order.

    points: id, x, y, z and, if colours count, color and grain. elements: kind, id, nodes
    and, for references, ref. Every kind is numbered from 1. Codes of points and of
    barycentres are taken in the box of the points. One exchange by element replaces nodes
    and makes barycentres at once; edges and quadratic kinds are ordered by their old ids.
    Nodes are gathered a column a slot, in rows of one size that are hashed; lists would be
    sorted link by link, with each link's own list, and fill the heap of many tasks.
    """
    box = bounding_box(points, "x", "y", "z")
    n = points.count()
    many = {"ranges": max(LEAST_PARTS, -(-n // PART_VERTICES))} if n > MANY_ROWS else {}
    at = [F.col(f"{c}_{n}") for n in ("lo", "hi") for c in "xyz"]
    colors = [F.col(c).cast("long").alias(c) if how.colors else F.lit(0).cast("long").alias(c) for c in ("color", "grain")]
    coded = _vertex_rank2(points.select("id", "x", "y", "z", *colors), elements, how.gmlib).crossJoin(F.broadcast(box))  # the box is one row
    coded = coded.withColumn("code", scheme_code(how.scheme, points, at)).drop(*(f"{c}_{n}" for n in ("lo", "hi") for c in "xyz"))
    vertices = stored(ranked(coded, [F.col(c) for c in ("color", "grain", "rank2", "code", "id")], **many).select(F.col("id").alias("old_id"), "new_id", "x", "y", "z", "color", "grain"), "vertices")
    ref = F.col("ref").cast("int") if "ref" in elements.columns else F.lit(0)
    links = _linked(elements.select("kind", F.col("id").alias("elem"), ref.alias("ref"), F.posexplode("nodes").alias("slot", "node")), vertices)
    first = F.col("slot") == 0
    width = elements.agg(F.max(F.size("nodes"))).first()[0] or 0
    moved = links.groupBy("kind", "elem", "ref").agg(
        F.array_compact(F.array(*(F.max(F.when(F.col("slot") == i, F.col("new_id"))) for i in range(max(width, 1))))).alias("nodes"),
        *(F.avg(c).alias(c) for c in "xyz"),
        *(F.max(F.when(first, F.col(c))).alias(c) for c in ("color", "grain")),
    )
    moved = moved.withColumnRenamed("elem", "id").crossJoin(F.broadcast(box))
    volumes, faces = ([k.name for k in kinds] for kinds in (VOLUMES, FACE_KINDS))
    curved = F.col("kind").isin(*volumes, *faces)
    if how.scheme == 4:
        own = sfc.hilbert_pair(*(F.when(curved, f("nodes")).otherwise(F.lit(0)) for f in (F.array_min, F.array_max)))
    else:
        own = scheme_code(how.scheme, moved, at)
    code = F.when(curved, own).otherwise(F.lit(0).cast("long")) if how.scheme in (2, 3) else own * curved.cast("long")  # no branch around a curve
    rank2 = F.when(F.col("kind").isin(*faces), sfc.ref_hash(F.col("ref"))).otherwise(F.lit(0).cast("long")) if how.gmlib == "generic" else F.lit(0).cast("long")
    keyed = moved.select("kind", "id", "nodes", "ref", "color", "grain", rank2.alias("rank2"), code.alias("code"))
    order = ranked(keyed, [F.col(c) for c in ("kind", "color", "grain", "rank2", "code", "id")], "place", **many)
    before = order.groupBy("kind").agg((F.min("place") - 1).alias("before"))  # one row a kind
    numbered = order.join(F.broadcast(before), "kind").select("kind", F.col("id").alias("old_id"), (F.col("place") - F.col("before")).alias("new_id"), "nodes", "ref", "color", "grain")
    return vertices.select("old_id", "new_id", "color", "grain"), numbered


def degrees_by_kind(elements: DataFrame, points: DataFrame) -> DataFrame:
    """(id, one column a kind): incidences of each point by elements (kind, id, nodes) of each kind, 0 for none."""
    found = elements.select("kind", F.explode("nodes").alias("id")).groupBy("id").pivot("kind", list(KINDS)).count()
    return points.select("id").join(found, "id", "left").na.fill(0)


def degree_classes(by_kind: DataFrame) -> DataFrame:
    """by_kind with high and over: a triangle, quad, tet or hex degree above the kind's low and high limit."""
    beyond = lambda limit: reduce(or_, (F.col(k.name) > getattr(k, limit) for k in KINDS.values() if k.name in ("triangle", "quad", "tet", "hex")))
    return by_kind.withColumns({"high": beyond("low_degree"), "over": beyond("high_degree")})


def degree_summary(classes: DataFrame) -> DataFrame:
    """(kind, max_deg, vec_size, high, over, high_pct, over_pct): of each kind the largest degree among high vertices and the power of two that holds it.

    The last four are of all vertices and the same in every row.
    """
    most = [F.coalesce(F.max(F.when(F.col("high"), F.col(k))), F.lit(0)).cast("long").alias(k) for k in KINDS]
    total = classes.agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("high", "over")), *most)
    rows = total.select("n", "high", "over", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("max_deg")) for k in KINDS))).alias("k"))
    size = F.when(F.col("k.max_deg") > 0, F.pow(F.lit(2.0), F.ceil(F.log2(F.col("k.max_deg").cast("double")))).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select("k.kind", "k.max_deg", size.alias("vec_size"), "high", "over", *((100.0 * F.col(c) / F.col("n")).alias(f"{c}_pct") for c in ("high", "over")))


def slice_of(degree: Column) -> Column:
    """1 to 5: the matrix slice of 16, 32, 64, 128 or 256 entries that a degree needs, the last one open."""
    number = F.lit(len(SLICES) + 1)
    for i, limit in reversed(list(enumerate(SLICES, 1))):
        number = F.when(degree <= limit, i).otherwise(number)
    return number


def slice_histogram(degree: DataFrame, out: bool = False) -> DataFrame:
    """(slice, n, pct, fill_pct) of vertices (id, deg); fill_pct, the same in every row, is the share of the slices' entries in use.

    out: degrees above 256 make a slice of their own, named 0, that has no entries;
    otherwise they join the last.
    """
    width = F.element_at(F.array(*map(F.lit, (*SLICES, 256))), slice_of(F.col("deg")))
    width = (F.when(F.col("deg") > 256, 0).otherwise(width) if out else width).cast("long")
    rows = degree.groupBy(width.alias("slice")).agg(F.count("*").alias("n"), F.sum("deg").alias("total"))
    whole = rows.agg(F.sum("n").alias("all"), F.sum("total").alias("used"), F.sum(F.col("n") * F.col("slice")).alias("room"))
    return rows.crossJoin(F.broadcast(whole)).select("slice", "n", (100.0 * F.col("n") / F.col("all")).alias("pct"), (100.0 * F.col("used") / F.col("room")).alias("fill_pct"))  # one row


def fixed_boundary(points: DataFrame, boundary: DataFrame) -> DataFrame:
    """(old_id, new_id): boundary vertices (id) keep their places; inner ones fill the others in the order of their codes."""
    marked = codes_3d(points).join(boundary.withColumn("fixed", F.lit(True)), "id", "left")
    inner = marked.where("fixed is null")
    order = ranked(inner, [F.col("code"), F.col("id")], "k").select(F.col("id").alias("old_id"), "k")
    slots = ranked(inner.select("id"), [F.col("id")], "k").select(F.col("id").alias("new_id"), "k")
    return order.join(slots, "k").select("old_id", "new_id").union(marked.where("fixed").select(F.col("id"), F.col("id")))


def quality(elements: DataFrame, width: int) -> DataFrame:
    """(quality): mean squared step between consecutive node numbers, over the square of their range.

    Steps inside an element come from its array; only first and last nodes are compared
    between elements, by a join on the next id, so no window spans the table.
    """
    nodes = F.col("nodes")
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(width - 1)), F.lit(0.0), lambda s, i: s + F.pow((nodes[i] - nodes[i - 1]).cast("double"), F.lit(2.0))) if width > 1 else F.lit(0.0)
    own = elements.select("id", inside.alias("inside"), nodes[0].alias("first"), nodes[width - 1].alias("last"), F.array_min(nodes).alias("lo"), F.array_max(nodes).alias("hi"))
    following = own.select((F.col("id") - 1).alias("id"), F.col("first").alias("next"))
    step = F.col("next") - F.col("last")
    total = own.join(following, "id", "left").agg(F.sum(F.col("inside") + F.coalesce((step * step).cast("double"), F.lit(0.0))).alias("s"), F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    reach = (F.col("hi") - F.col("lo")).cast("double")
    return total.select((F.col("s") / (F.col("n") * width * reach * reach)).alias("quality"))


def permuted(payload: DataFrame, order: DataFrame) -> DataFrame:
    """payload (id, ...) under its new ids."""
    rest = [c for c in payload.columns if c != "id"]
    return payload.join(order.withColumnRenamed("old_id", "id"), "id").select(F.col("new_id").alias("id"), *rest)


def looked_up(ids: DataFrame, order: DataFrame) -> DataFrame:
    """(id, new_id, old_id): the place that each id goes to, and the id that comes to its place."""
    to = order.select(F.col("old_id").alias("id"), "new_id")
    of = order.select(F.col("new_id").alias("id"), "old_id")
    return ids.select("id").join(to, "id", "left").join(of, "id", "left")


def restored(payload: DataFrame, order: DataFrame) -> DataFrame:
    """payload (id, ...) under its old ids: the inverse of permuted."""
    return permuted(payload, order.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")))


def run_labels(rows: DataFrame, order: str, label: str) -> DataFrame:
    """rows with `run`: 1-based number of the run of equal labels, in the order of a dense id.

    Run starts are found by joining each row to the one before; their running count goes
    through buckets.
    """
    prior = rows.select((F.col(order) + 1).alias(order), F.col(label).alias("__prior"))
    starts = rows.join(prior, order, "left").withColumn("__start", (~F.col(label).eqNullSafe(F.col("__prior"))).cast("long"))
    return running_before(starts, order, F.col("__start"), "__runs").withColumn("run", F.col("__runs") + F.col("__start")).drop("__prior", "__start", "__runs")


def first_touch(rows: DataFrame) -> DataFrame:
    """(violations): rows (color, node, grain, elem, slot) whose grain is not that of the first element to touch the node in that colour."""
    first = F.first_value("grain").over(Window.partitionBy("color", "node").orderBy("elem", "slot"))
    return rows.withColumn("first", first).agg(F.sum((F.col("grain") != F.col("first")).cast("long")).alias("violations"))
