"""Closed forms, invariants and the SQL of every mesh query on the smallest data."""

import itertools
import os
import random

import duckdb
import pytest

from gridloom import cli, config, fixtures, oracles, queries, session
from gridloom.functions import ranking, sfc
from gridloom.operators import blocks, extract, grains, incidence, loops, renumber
from gridloom.plans.tasks import TaskGraph
from gridloom.sources import mesh_io
from gridloom.sources.mesh_io import mesh_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(found):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({oracles.oracle_sql()[name]})").fetchall()
    assert rows(df.collect()) == rows(want)


@pytest.mark.parametrize("name", ["mesh_renumber_colors", "mesh_renumber_mixed", "mesh_renumber_octree", "mesh_renumber_same", "mesh_renumber_topological"])
def test_renumbering_of_large_ids(spark, monkeypatch, name):
    """Ids whose reference, 7919 times the id, does not fit an int."""
    shift = 300_000

    class Shifted(queries.Mixed):
        def __init__(self, *args):
            super().__init__(*args)
            self.elements = self.elements.withColumn("id", F.col("id") + shift)

    want = [(r.kind, r.old_id + shift * (r.kind != "vertex"), r.new_id, r.nodes, r.grain) for r in queries.QUERIES[name](spark, SF).collect()]
    monkeypatch.setattr(queries, "Mixed", Shifted)
    assert rows(queries.QUERIES[name](spark, SF).collect()) == rows(want)


@pytest.mark.parametrize("scheme", [0, 1, 4])
def test_no_curve_code_stands_in_a_branch(spark, monkeypatch, scheme):
    """Spark computes the repeated parts of a code once only outside the branches of a condition."""
    plans = []

    def seen(df, order, name="new_id"):
        if name == "place":
            plans.append(df._jdf.queryExecution().optimizedPlan())
        return ranking.ranked(df, order, name)

    monkeypatch.setattr(renumber, "ranked", seen)
    points = spark.createDataFrame([(i, float(i % 2), float(i // 2 % 2), float(i // 4)) for i in range(8)], "id long, x double, y double, z double")
    elements = spark.createDataFrame([("hex", 1, list(range(8))), ("tet", 1, [7, 2, 1, 4]), ("tet", 2, [0, 1, 2, 4]), ("edge", 1, [6, 7]), ("edge", 2, [0, 1])], "kind string, id long, nodes array<long>")
    _, moved = renumber.renumbered_mesh(points, elements, renumber.Renumbering(scheme=scheme))
    assert [(r.old_id, r.new_id) for r in moved.where("kind = 'edge'").sort("old_id").collect()] == [(1, 1), (2, 2)]

    def under(e, branch=False):
        """Whether one of the outermost array lookups stands in a branch."""
        if e.nodeName() == "ElementAt":
            return branch
        inner = branch or e.nodeName() in ("If", "CaseWhen", "Coalesce")
        return any(under(e.children().apply(i), inner) for i in range(e.children().size()))

    curve = [e for e in (plans[0].expressions().apply(i) for i in range(plans[0].expressions().size())) if e.prettyName() == "alias" and e.name() == "code"]
    assert len(curve) == 1 and "element_at" in curve[0].toString()
    assert not under(curve[0])


@pytest.mark.parametrize("name", ["mesh_renumber_octree", "mesh_renumber_same"])
def test_many_vertices_are_not_broadcast(spark, duck, monkeypatch, name):
    """Beyond a number of vertices, links meet theirs task by task; every row equals the SQL."""
    plans = []

    def seen(df, order, name="new_id"):
        if name == "place":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return ranking.ranked(df, order, name)

    monkeypatch.setattr(renumber, "ranked", seen)
    monkeypatch.setattr(renumber, "SMALL_VERTICES", 78, raising=False)
    monkeypatch.setattr(renumber, "PART_VERTICES", 30, raising=False)
    df = queries.QUERIES[name](spark, SF)
    joins = [line.split("Join")[0].split()[-1] for line in plans[0].splitlines() if "Join [node" in line]
    assert joins == ["ShuffledHash"]
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({oracles.oracle_sql()[name]})").fetchall()
    assert rows(df.collect()) == rows(want)


def test_nodes_are_gathered_without_lists(spark, monkeypatch):
    """Lists of nodes would be sorted link by link, which filled the heap of many tasks; every width keeps its order."""
    plans = []

    def seen(df, order, name="new_id"):
        if name == "place":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return ranking.ranked(df, order, name)

    monkeypatch.setattr(renumber, "ranked", seen)
    points = spark.createDataFrame([(i, float(-i), 0.0, 0.0) for i in range(1, 31)], "id long, x double, y double, z double")
    wide = [("edge", 1, [30, 1]), ("edge", 2, [7, 7]), ("hex2", 1, list(range(27, 0, -1))), ("tet", 1, [9, 3, 12, 5])]
    elements = spark.createDataFrame(wide, "kind string, id long, nodes array<long>")
    _, moved = renumber.renumbered_mesh(points, elements, renumber.Renumbering(scheme=3))
    assert sorted((r.kind, r.new_id, r.nodes) for r in moved.collect()) == wide
    assert "HashAggregate" in plans[0] and "ObjectHashAggregate" not in plans[0] and "collect_list" not in plans[0]
    _, none = renumber.renumbered_mesh(points, elements.where("false"), renumber.Renumbering(scheme=3))
    assert none.collect() == []


def test_many_rows_go_to_parts_of_managed_shuffles(spark, monkeypatch):
    """Beyond a number of rows both rankings name their ranges, more than 200 of them, whatever the session's number."""
    assert renumber.LEAST_PARTS > 200
    ranges = []

    def seen(df, order, name="new_id", **how):
        ranges.append(how.get("ranges"))
        return ranking.ranked(df, order, name, **how)

    monkeypatch.setattr(renumber, "ranked", seen)
    for name, most in (("MANY_ROWS", 20), ("SMALL_VERTICES", 20), ("LEAST_PARTS", 11)):
        monkeypatch.setattr(renumber, name, most)
    points = spark.createDataFrame([(i, float(-i), 0.0, 0.0) for i in range(1, 31)], "id long, x double, y double, z double")
    wide = [("edge", i, [i, i + 1]) for i in range(1, 30)]
    order, moved = renumber.renumbered_mesh(points, spark.createDataFrame(wide, "kind string, id long, nodes array<long>"), renumber.Renumbering(scheme=3))
    assert ranges == [11, 11]
    assert sorted((r.old_id, r.new_id) for r in order.collect()) == [(i, i) for i in range(1, 31)]
    assert sorted((r.kind, r.new_id, r.nodes) for r in moved.collect()) == wide


def test_references_are_the_low_four_bytes(spark):
    ids = [0, 1, 271_182, 271_183, 542_366, 2_315_250, 1 << 40]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", fixtures.reference(F.col("id")).alias("ref")).collect()
    assert {r.id: r.ref for r in got} == {i: (i * 7919 + (1 << 31)) % (1 << 32) - (1 << 31) for i in ids}


def test_closed_forms(spark):
    n = 4
    tets = fixtures.tetrahedra(spark, n)
    assert (fixtures.vertices(spark, n).count(), tets.count()) == ((n + 1) ** 3, 6 * n**3)
    assert extract.unique_edges(tets).count() == 7 * n**3 + 9 * n**2 + 3 * n
    assert extract.tet_neighbours(tets).where("ngb = 0").count() == 12 * n**2
    assert incidence.degrees(incidence.incidence(tets), fixtures.vertices(spark, n)).agg(F.sum("deg")).first()[0] == 4 * tets.count()


def test_mixed_mesh_figures(spark):
    elements = fixtures.mixed_elements(spark, 3)
    assert dict(elements.groupBy("kind").count().collect()) == {"hex": 9, "pyramid": 54, "prism": 18, "tet": 6}
    found = extract.mixed_neighbours(elements)
    assert (found.where("ngb = 0").count(), found.where("ngb > 0").count()) == (72, 2 * 183)


def test_face_of_three_tets_has_no_neighbour(spark):
    tets = spark.createDataFrame([(1, [1, 2, 3, 4], 1), (2, [1, 2, 3, 5], 1), (3, [1, 2, 3, 6], 1)], "id long, nodes array<bigint>, ref int")
    assert extract.tet_neighbours(tets).where("ngb <> 0").count() == 0
    assert extract.surface(tets).count() == 12


def test_hilbert_steps_are_units(spark):
    points = spark.range(1, 513).select("id", *(F.floor((F.col("id") - 1) / 8**j % 8).cast("double").alias(c) for j, c in enumerate("xyz")))
    path = [tuple(r)[1:] for r in points.join(renumber.codes_3d(points), "id").orderBy("code").select("id", "x", "y", "z").collect()]
    steps = {sum(abs(a - b) for a, b in zip(p, q)) for p, q in zip(path, path[1:])}
    assert steps == {1.0} or max(steps) <= 1.0
    assert points.join(renumber.codes_3d(points), "id").select("code").distinct().count() == 512


def test_machines_have_few_states():
    assert len(sfc.machine(sfc.START_3D, sfc.TURN_3D)[0]) // 8 == 12
    assert len(sfc.machine(sfc.START_2D, sfc.TURN_2D)[0]) // 4 == 4


def test_degenerate_points(spark):
    flat = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 1.0, 1.0, 5.0), (3, 1.0, 1.0, 5.0)], "id long, x double, y double, z double")
    order = dict(renumber.numbering(renumber.codes_3d(flat)).collect())
    assert sorted(order.values()) == [1, 2, 3] and order[2] < order[3]
    one = flat.limit(1)
    assert renumber.codes_3d(one).first()["code"] is not None


def test_ranked_equals_a_global_window(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 50).alias("key"))
    got = {r["id"]: r["new_id"] for r in ranking.ranked(df, [F.col("key"), F.col("id")]).collect()}
    assert got == {r: i + 1 for i, r in enumerate(sorted(range(500), key=lambda i: (i * 37 % 50, i)))}


def test_permutation_and_restore(spark):
    n = 3
    ver = fixtures.vertices(spark, n)
    order = renumber.numbering(renumber.codes_3d(ver))
    got = order.collect()
    assert sorted(r[1] for r in got) == sorted(r[0] for r in got) == list(range(1, (n + 1) ** 3 + 1))


def test_shuffling_worsens_quality_and_dependencies(spark):
    n = 6
    tets, nv = fixtures.tetrahedra(spark, n), (n + 1) ** 3
    moved = tets.select("id", F.transform("nodes", lambda v: fixtures.shuffled(v, nv)).alias("nodes"))
    q = lambda df: renumber.quality(df, 4).first()[0]
    assert q(tets) < q(moved)


def test_coloring_is_proper():
    rng = random.Random(1)
    for _ in range(20):
        k = rng.randint(1, 30)
        pairs = [(a, b) for a, b in itertools.combinations(range(k), 2) if rng.random() < 0.2]
        found = grains.coloring(pairs, k)
        assert sorted(found) == list(range(k)) and all(found[a] != found[b] for a, b in pairs)


def test_static_schedule_has_no_conflict():
    rng = random.Random(2)
    matrix = sorted({(b, rng.randrange(40)) for b in range(60) for _ in range(3)})
    plan = blocks.static_schedule(matrix, 4)
    assert sorted(b for b, _, _ in plan) == list(range(60))
    for (a, g, w), (b, h, v) in itertools.combinations(plan, 2):
        if g == h and w != v:
            assert not {d for x, d in matrix if x == a} & {d for x, d in matrix if x == b}


def test_task_graph_waits_and_fails():
    seen = []
    graph = TaskGraph(2)
    a = graph.launch(lambda: seen.append("a"))
    b = graph.launch(seen.append, "b", after=(a,))
    graph.launch(seen.append, "c", after=(a, b))
    graph.wait()
    assert seen == ["a", "b", "c"]
    graph = TaskGraph(2)
    bad = graph.launch(lambda: 1 / 0)
    graph.launch(seen.append, "never", after=(bad,))
    with pytest.raises(ZeroDivisionError):
        graph.wait()
    assert "never" not in seen


def test_catalogue(spark):
    catalogue = session.MeshSession(spark)
    catalogue.register("t_ids", spark.range(1, 6))
    with pytest.raises(ValueError):
        catalogue.register("t_bad", spark.range(0, 5))
    with pytest.raises(ValueError):
        catalogue.resize("t_ids", spark.range(7, 9))
    catalogue.resize("t_ids", spark.range(6, 11))
    with pytest.raises(ValueError):
        catalogue.resize("t_ids", spark.range(11, 12))
    assert catalogue.information()["types"] == 1
    catalogue.free("t_ids")
    assert catalogue.information()["types"] == 0


def test_settings_and_paths():
    assert config.EngineConfig().with_attribute("static_scheduling", True).static_scheduling
    with pytest.raises(TypeError):
        config.EngineConfig().with_attribute("no_such", 1)
    assert config.EngineConfig(adaptive_sizing=False).spark_settings()["spark.sql.adaptive.enabled"] == "false"
    assert config.cores() >= 1 and config.wall_clock() <= config.wall_clock()
    assert (mesh_path("a"), mesh_path("a.mesh"), mesh_path("a.meshb")) == ("a.meshb", "a.mesh", "a.meshb")
    assert blocks.small_size(10, 4) == 10 and blocks.small_size(1000, 4) == 3
    assert blocks.dependency_size(5000, 4) == 4 and blocks.dependency_size(5000, 4, previous=200) == 5000


def test_smoothing_with_checkpoints(spark):
    n = 2
    links = incidence.incidence(fixtures.tetrahedra(spark, n))
    ver = fixtures.vertices(spark, n)
    one = incidence.smooth(links, incidence.smooth(links, ver, 2), 3)
    got, want = ({r["id"]: r["value"] for r in df.collect()} for df in (incidence.smooth(links, ver, 5), one))
    assert all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) for i in want)


def plain_code(point, levels, start, turn, dims):
    """The curve level by level, with the rotation itself as state."""
    rotation, code = list(start), 0
    for level in reversed(range(levels)):
        octant = sum((point[j] >> level & 1) << j for j in range(dims))
        digit = rotation[octant]
        code = code << dims | digit
        if turn:
            rotation = [turn[digit][r] for r in rotation]
    return code


def test_codes_are_those_of_the_plain_loop(spark):
    rng = random.Random(4)
    points = [(i, *(rng.randrange(1 << 21) for _ in range(3))) for i in range(300)] + [(900, 0, 0, 0), (901, (1 << 21) - 1, 0, (1 << 21) - 1)]
    df = spark.createDataFrame(points, "id long, x long, y long, z long")
    axes, pair = [F.col(c) for c in "xyz"], [F.col("x") * 1024 + F.col("y") % 1024, F.col("z") * 1000]
    got = df.select("id", sfc._folded(axes, 21, *sfc.machine(sfc.START_3D, sfc.TURN_3D)).alias("h"), sfc._folded(axes, 21, list(sfc.OCTREE), [0] * 8).alias("o"), sfc.hilbert_pair(*pair).alias("t"))
    found = {r.id: (r.h, r.o, r.t) for r in got.collect()}
    for i, x, y, z in points:
        flat = (x * 1024 + y % 1024, z * 1000)
        assert found[i] == (plain_code((x, y, z), 21, sfc.START_3D, sfc.TURN_3D, 3), plain_code((x, y, z), 21, sfc.OCTREE, None, 3), plain_code(flat, 31, sfc.START_2D, sfc.TURN_2D, 2))


def test_ids_beyond_the_topological_code_raise(spark):
    df = spark.createDataFrame([(5, 1 << 31)], "a long, b long")
    with pytest.raises(Exception, match="does not fit"):
        df.select(sfc.hilbert_pair(F.col("a"), F.col("b")).alias("c")).collect()
    assert df.limit(0).select(sfc.hilbert_pair(F.col("a"), F.col("b")).alias("c")).count() == 0


def test_ranks_of_one_key_and_of_no_rows(spark):
    same = spark.range(1000).select("id", F.lit(7).alias("key"))
    got = ranking.ranked(same, [F.col("key"), F.desc("id")], "pos").collect()
    assert {(r.id, r.pos) for r in got} == {(i, 1000 - i) for i in range(1000)}
    assert ranking.ranked(same.limit(0), [F.col("key")], "pos").count() == 0


@pytest.mark.parametrize("rows,workers,factor,size", [(100, 4, 7, 0), (101, 3, 2, 0), (9, 4, 5, 0), (100, 4, 0, 6), (100, 4, 0, 25), (100, 4, 0, 26), (7, 4, 0, 0), (3, 4, 0, 0), (1000, 7, 0, 13)])
def test_interleaving_is_the_plain_deal(spark, rows, workers, factor, size):
    from fractions import Fraction

    count = factor or (rows // (size * workers) if size else 0)
    length = Fraction(rows, factor * workers) if factor else Fraction(size) if count else Fraction(rows, workers)
    count = count or 1
    want, at, turn = {}, Fraction(0), 0
    for k in range(count * workers):
        begin, end = int(at) + 1, int(at + length)
        at += length
        if k == count * workers - 1:
            end = rows
        if begin <= end:
            want.update((i, (k, turn)) for i in range(begin, end + 1))
            turn = (turn + 1) % workers
    got = {r.id: (r.slice, r.owner) for r in blocks.interleaved(spark.range(1, rows + 1), rows, workers, factor, size).collect()}
    assert got == want


def test_a_wrong_colouring_and_schedule_are_counted(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "g1 long, g2 long")
    colors = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "grain long, color long")
    assert [tuple(r) for r in grains.clashes(pairs, colors).collect()] == [(0, 2)]
    touched = spark.createDataFrame([(0, 5, 1, 1, 0), (0, 5, 2, 2, 0), (1, 5, 3, 3, 0), (0, 6, 2, 2, 1)], "color long, node long, grain long, elem long, slot int")
    assert renumber.first_touch(touched).first()[0] == 1


def test_colours_are_balanced():
    pairs = [(0, i) for i in range(1, 9)]
    found = grains.coloring(pairs, 12, workers=3)
    assert all(found[a] != found[b] for a, b in pairs)
    used = sorted(list(found.values()).count(c) for c in set(found.values()))
    assert used[0] >= 3 and sum(used) == 12


def test_opaque_loops(spark):
    import pyarrow as pa

    df = loops.launch(spark.range(1, 101), lambda b, k: pa.record_batch([b.column(0), pa.array([k] * b.num_rows)], names=["id", "k"]), "id long, k long", 7, slices=4)
    assert {(r.id, r.k) for r in df.collect()} == {(i, 7) for i in range(1, 101)}
    assert 1 <= loops.concurrency(spark.range(1, 101).repartitionByRange(4, "id")) <= 4


def test_settings_act(spark):
    matrix = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 5)], "blk long, dep long")
    order = lambda c: [r.blk for r in c.scheduled(matrix).orderBy("pos").collect()]
    base = config.EngineConfig(workers=2)
    assert order(base) == [0, 1, 2] and order(base.with_attribute("block_sorting", True)) == [1, 0, 2]
    static = base.with_attribute("static_scheduling", True).scheduled(matrix).collect()
    assert sorted(r.blk for r in static) == [0, 1, 2] and all(r.worker in (0, 1) for r in static)
    assert base.with_attribute("small_block", 4).small_size(80) == 10 and base.small_size(80) == 80
    assert config.start(base, master="local[8]") is not None and spark.range(3).count() == 3


def test_halving_goes_on_while_it_pays(spark):
    matrix = spark.createDataFrame([(b, b) for b in range(16)], "blk long, dep long")
    found, times = blocks.halved_while(matrix, "blk", lambda m: abs(m.select("blk").distinct().count() - 4))
    assert times == 2 and found.select("blk").distinct().count() == 4


def test_command_renumbers_a_file(spark, tmp_path, capsys):
    n = 3
    tets = fixtures.tetrahedra(spark, n).select(F.lit("tet").alias("kind"), "id", F.transform("nodes", lambda v: fixtures.shuffled(v, (n + 1) ** 3)).alias("nodes"), "ref")
    ver = renumber.permuted(fixtures.vertices(spark, n), spark.range(1, (n + 1) ** 3 + 1).select(F.col("id").alias("old_id"), fixtures.shuffled(F.col("id"), (n + 1) ** 3).alias("new_id")))
    source, target = str(tmp_path / "a"), str(tmp_path / "b.mesh")
    mesh_io.write_mesh(source, ver, tets)
    for options in (["-stats"], ["-scheme", "4"], ["-fixbnd"], ["-gmlib", "generic"], ["-gmlib", "matrix", "-scheme", "1"]):
        cli.main(["-in", source, "-out", target, "-nproc", "2", *options], spark)
        ver2, tets2 = mesh_io.read_mesh(spark, target)
        assert mesh_io.bad_elements(tets2, ver2).count() == 0 and session.id_report(ver2).first()["dense"] and session.id_report(tets2).first()["dense"]
        shape = lambda v, t: sorted(tuple(sorted(r)) for r in incidence.incidence(t).join(v.withColumnRenamed("id", "node"), "node").groupBy("elem").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "x", "y", "z"))).alias("c")).select(*(F.col("c")[i] for i in range(4))).collect())
        assert shape(ver2, tets2) == shape(ver, tets)
    assert "before tet" in capsys.readouterr().out
    with pytest.raises(ValueError):
        mesh_io.read_mesh(spark, target, ["no such kind"])
    with pytest.raises(ValueError):
        renumber.Renumbering(gmlib="none")


def test_renumbering_lowers_dependencies(spark):
    n = 6
    nv = (n + 1) ** 3
    tets = fixtures.tetrahedra(spark, n).select(F.lit("tet").alias("kind"), "id", F.transform("nodes", lambda v: fixtures.shuffled(v, nv)).alias("nodes"))
    points = renumber.permuted(fixtures.vertices(spark, n), spark.range(1, nv + 1).select(F.col("id").alias("old_id"), fixtures.shuffled(F.col("id"), nv).alias("new_id")))
    _, moved = renumber.renumbered_mesh(points, tets)
    share = lambda t: cli.stats(t, nv, 1)[0][1]
    assert share(moved.select("kind", F.col("new_id").alias("id"), "nodes")) < share(tets)


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            session.shared_folder(Cluster)
