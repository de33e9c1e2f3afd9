"""DuckDB SQL for each query of gridloom.queries, written against the driver's tables alone."""

from __future__ import annotations

# First rotation and rotation updates of the curves, by octant or quadrant, and the octree's digits.
START_3D = "[0, 3, 7, 4, 1, 2, 6, 5]"
TURN_3D = "[[0, 7, 6, 1, 2, 5, 4, 3], [0, 3, 4, 7, 6, 5, 2, 1], [0, 3, 4, 7, 6, 5, 2, 1], [2, 3, 0, 1, 6, 7, 4, 5], [2, 3, 0, 1, 6, 7, 4, 5], [6, 5, 2, 1, 0, 3, 4, 7], [6, 5, 2, 1, 0, 3, 4, 7], [4, 3, 2, 5, 6, 1, 0, 7]]"
START_2D = "[1, 2, 0, 3]"
TURN_2D = "[[0, 3, 2, 1], [0, 1, 2, 3], [0, 1, 2, 3], [2, 1, 0, 3]]"
OCTREE = "[5, 4, 7, 6, 1, 0, 3, 2]"

GRID = """p as (select cast(floor(cbrt(count(*)) + 1e-9) as bigint) as n from part),
g as (select unnest(range(n + 1)) as i from p),
ver as (select cast(1 + a.i + b.i * (n + 1) + c.i * (n + 1) * (n + 1) as bigint) as id, a.i::double as x, b.i::double as y, c.i::double as z from g a, g b, g c, p),
verv as (select *, id % 97 as value from ver),
ord as (select * from (values (0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2), (4, 2, 0), (5, 2, 1)) t(q, a, b)),
st as (select 0 as ax, 1::bigint as s union all select 1, n + 1 from p union all select 2, (n + 1) * (n + 1) from p),
cell as (select a.i, b.i as j, c.i as k, 1 + a.i + b.i * (n + 1) + c.i * (n + 1) * (n + 1) as base, n from g a, g b, g c, p where a.i < n and b.i < n and c.i < n),
tet as (select cast(((k * n + j) * n + i) * 6 + q + 1 as bigint) as id, cast(base as bigint) as v0, cast(base + sa.s as bigint) as v1, cast(base + sa.s + sb.s as bigint) as v2,
  cast(base + 1 + (n + 1) + (n + 1) * (n + 1) as bigint) as v3, cast(case when i < n // 2 then 1 else 2 end as bigint) as ref
  from cell, ord, st sa, st sb where sa.ax = ord.a and sb.ax = ord.b),
tetn as (select *, id % 97 as value from tet),
links as (select id as elem, 0 as slot, v0 as node from tet union all select id, 1, v1 from tet union all select id, 2, v2 from tet union all select id, 3, v3 from tet),
sz as (select n, (n + 1) ** 3 as nv_, cast((n + 1) * (n + 1) * (n + 1) as bigint) as nv, cast(6 * n * n * n as bigint) as nt from p),
bs as (select nv, nt, case when nt >= 256 then nt // 256 else nt end as small, case when nv >= 1024 then nv // 1024 else nv end as ds from sz),
matrix as (select distinct (elem - 1) // small as blk, (node - 1) // ds as dep from links, bs)"""

EDGES = """edges as (select distinct least(a, b) as a, greatest(a, b) as b from (
  select v0 as a, v1 as b from tet union all select v1, v2 from tet union all select v2, v0 from tet
  union all select v3, v0 from tet union all select v3, v1 from tet union all select v3, v2 from tet))"""
FACES = """faces as (select id as tet_id, ref, 0 as face, list_sort([v1, v2, v3]) as key, [v1, v2, v3] as t from tet
  union all select id, ref, 1, list_sort([v2, v0, v3]), [v2, v0, v3] from tet
  union all select id, ref, 2, list_sort([v3, v0, v1]), [v3, v0, v1] from tet
  union all select id, ref, 3, list_sort([v0, v2, v1]), [v0, v2, v1] from tet),
pairs as (select a.*, b.tet_id as ot, b.face as of_, b.ref as oref from faces a left join faces b on a.key = b.key and a.tet_id <> b.tet_id)"""
DEGREE = "degree as (select ver.id, count(links.node) as deg from ver left join links on links.node = ver.id group by ver.id)"
CLOUD = """cloud as (select vec_id + 1 as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
box as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from cloud)"""
MIXED = """mp as (select n // 3 * 3 as n from p),
mg as (select unnest(range(n)) as i from mp),
mc as (select a.i, b.i as j, c.i as k, n, n + 1 as m, c.i * n * (n // 3) + b.i * (n // 3) + a.i // 3 as r from mg a, mg b, mg c, mp),
mb as (select *, 1 + i + j * m + k * m * m as b from mc),
mh as (select *, [b, b + 1, b + 1 + m, b + m, b + m * m, b + 1 + m * m, b + 1 + m + m * m, b + m + m * m] as c from mb),
hexes as (select r + 1 as id, c as nd from mh where i % 3 = 0),
hf as (select * from (values (0, [1, 5, 8, 4]), (1, [2, 3, 7, 6]), (2, [1, 2, 6, 5]), (3, [4, 8, 7, 3]), (4, [1, 4, 3, 2]), (5, [5, 6, 7, 8])) t(f, o)),
pyrs as (select r * 6 + f + 1 as id, [c[o[1]], c[o[2]], c[o[3]], c[o[4]], m * m * m + 1 + r] as nd from mh, hf where i % 3 = 1),
ph as (select * from (values (0, [1, 2, 3, 5, 6, 7]), (1, [1, 3, 4, 5, 7, 8])) t(h, o)),
prs as (select r * 2 + h + 1 as id, [c[o[1]], c[o[2]], c[o[3]], c[o[4]], c[o[5]], c[o[6]]] as nd, i, j, k, n, m, h from mh, ph where i % 3 = 2),
tops as (select (j * (n // 3) + i // 3) * 2 + h + 1 as id, [nd[4], nd[5], nd[6], m * m * m + n * n * (n // 3) + 1 + (j * (n // 3) + i // 3) * 2 + h] as nd from prs where k = n - 1),
allk as (select id as gid, 3 as kd, nd from tops union all select id + (select count(*) from tops), 4, nd from pyrs
  union all select id + (select count(*) from tops) + (select count(*) from pyrs), 5, nd from prs
  union all select id + (select count(*) from tops) + (select count(*) from pyrs) + (select count(*) from prs), 6, nd from hexes),
lf as (select * from (values (3, 0, [2, 3, 4]), (3, 1, [3, 1, 4]), (3, 2, [4, 1, 2]), (3, 3, [1, 3, 2]),
  (4, 0, [1, 2, 5]), (4, 1, [2, 3, 5]), (4, 2, [3, 4, 5]), (4, 3, [4, 1, 5]), (4, 4, [4, 3, 2, 1]),
  (5, 0, [1, 3, 2]), (5, 1, [4, 5, 6]), (5, 2, [1, 2, 5, 4]), (5, 3, [2, 3, 6, 5]), (5, 4, [4, 6, 3, 1]),
  (6, 0, [1, 5, 8, 4]), (6, 1, [2, 3, 7, 6]), (6, 2, [1, 2, 6, 5]), (6, 3, [4, 8, 7, 3]), (6, 4, [1, 4, 3, 2]), (6, 5, [5, 6, 7, 8])) t(kd, face, o)),
mf as (select gid, face, list_transform(o, lambda x: nd[x]) as fn from allk join lf using (kd)),
mk as (select gid, face, fn, case when len(fn) = 3 then list_sort(fn) else [list_min(fn), fn[(list_position(fn, list_min(fn)) + 1) % 4 + 1], 0] end as key from mf),
mn as (select a.gid, a.face, a.fn, b.gid as ngb from mk a left join mk b on a.key = b.key and a.gid <> b.gid)"""


def _fold(source: str, dims: int, levels: int, start: str, turn: str | None) -> str:
    """A recursive CTE `codes` (id, code) over `source` (id, q0, q1, ...): the rotation itself goes down the levels."""
    octant = " + ".join(f"(((q{j} >> lev) & 1) << {j})" for j in range(dims))
    qs = ", ".join(f"q{j}" for j in range(dims))
    digit = f"rot[{octant} + 1]"
    after = f"list_transform(rot, lambda r: ({turn})[{digit} + 1][r + 1])" if turn else "rot"
    return f"""walk as (select id, {qs}, {levels - 1} as lev, 0::bigint as code, {start} as rot from {source}
  union all select id, {qs}, lev - 1, code * {1 << dims} + {digit}, {after} from walk where lev >= 0),
codes as (select id, code::bigint as code from walk where lev = -1)"""


def _quantised(axis: str, bits: int, top: int) -> str:
    return f"case when {axis}1 > {axis}0 then least(cast(floor(({axis} - {axis}0) * ({float(1 << bits)}::double / ({axis}1 - {axis}0))) as bigint), {top}) else 0 end"


def _codes_3d(points: str, start=START_3D, turn=TURN_3D) -> str:
    qs = ", ".join(f"{_quantised(a, 21, (1 << 21) - 1)} as q{j}" for j, a in enumerate("xyz"))
    return f"quant as (select id, {qs} from {points}, box), " + _fold("quant", 3, 21, start, turn)


def _codes_2d(points: str) -> str:
    qs = ", ".join(f"{_quantised(a, 30, 1 << 30)} as q{j}" for j, a in enumerate("xy"))
    return f"quant as (select id, {qs} from {points}, box), " + _fold("quant", 2, 31, START_2D, TURN_2D)


FAN = """fk as (select * from (values (0, 'tet', 1, 130, 4), (1, 'triangle', 2, 33, 3), (2, 'quad', 3, 5, 4), (3, 'hex', 4, 9, 8), (4, 'pyramid', 1, 20, 5), (5, 'prism', 2, 10, 6), (6, 'edge', 1, 5, 2), (7, 'hex', 5, -12, 8)) t(o, kind, hub, more, w)),
fc as (select o, kind, hub, w, cast(greatest(0, more + n) as bigint) as c from fk, p),
ff as (select *, 6 + coalesce(sum(c * (w - 1)) over (order by o rows between unbounded preceding and 1 preceding), 0) as f, coalesce(sum(c) over (partition by kind order by o rows between unbounded preceding and 1 preceding), 0) as u from fc),
fe as (select kind, hub, w, f, u, unnest(range(c)) as e from ff),
fl as (select kind, cast(e + 1 + u as bigint) as id, 0 as slot, hub::bigint as node from fe union all select kind, cast(e + 1 + u as bigint), j, cast(e * (w - 1) + j + f as bigint) from (select *, unnest(range(1, w)) as j from fe)),
fv as (select cast(unnest(range(1, 7 + (select cast(sum(c * (w - 1)) as bigint) from fc))) as bigint) as id),
ftet as (select id, max(case slot when 0 then node end) as v0, max(case slot when 1 then node end) as v1, max(case slot when 2 then node end) as v2, max(case slot when 3 then node end) as v3 from fl where kind = 'tet' group by id)"""
FAN_DEGREES = """fd as (select fv.id, """ + ", ".join(f"count(*) filter (where kind = '{k}') as {k}_" for k in ("edge", "triangle", "quad", "tet", "pyramid", "prism", "hex")) + """ from fv left join fl on fl.node = fv.id group by fv.id),
fh as (select *, triangle_ > 8 or quad_ > 4 or tet_ > 32 or hex_ > 8 as high, triangle_ > 32 or quad_ > 16 or tet_ > 128 or hex_ > 32 as over_ from fd)"""
EDGE_DEGREE = "ed as (select {v}.id, count(node) as deg from {v} left join (select a as node from edges union all select b from edges) on node = {v}.id group by {v}.id)"
_REF = "cast((" + " + ".join(f"(((r >> {s}) & 255) + 128) % 256 - 128" for s in (0, 8, 16, 24)) + ") & 255 as bigint)"


def _slices(out: bool) -> str:
    last = "when deg <= 256 then 256 else 0" if out else "else 256"
    return f"""sl as (select case when deg <= 16 then 16 when deg <= 32 then 32 when deg <= 64 then 64 when deg <= 128 then 128 {last} end::bigint as slice, deg from ed),
sg as (select slice, count(*) as n, sum(deg) as t from sl group by slice), sw as (select sum(n) as a, sum(t) as u, sum(n * slice) as room from sg)
select slice, n, round(100.0::double * n / a, 6) as pct, round(100.0::double * u / room, 6) as fill_pct from sg, sw"""


MIXED_POINTS = """mpt as (select cast(i as bigint) as id, ((i - 1) * 7 % 101)::double as x, ((i - 1) * 11 % 103)::double as y, ((i - 1) * 13 % 107)::double as z, i % 12 as g, i % 12 % 3 as c
  from (select unnest(range(1, (n + 1) * (n + 1) * (n + 1) + n * n * (n // 3) + 2 * n * (n // 3) + 1)) as i from mp)),
mkd as (select 'tet' as kind, 1 as o, id, nd from tops union all select 'pyramid', 2, id, nd from pyrs union all select 'prism', 3, id, nd from prs union all select 'hex', 4, id, nd from hexes),
box as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from mpt)"""


def _again(ctes: str) -> str:
    """The CTEs of a fold under other names, for a second fold in the same query."""
    return ctes.replace("quant", "equant").replace("walk", "ewalk").replace("codes as", "ecodes as")


def _moved(colors: bool, vertex: str, element: str) -> str:
    """Vertices and elements of the mixed mesh in their new order; vertex and element are CTEs of `codes` and `ecodes`."""
    c, g = ("c", "g") if colors else ("0", "0")
    return _with(GRID, MIXED, MIXED_POINTS, vertex,
        f"vn as (select id as old_id, x, y, z, {c} as c, cast({g} as bigint) as g, row_number() over (order by {c}, {g}, code, id) as new_id from codes join mpt using (id))",
        "ml as (select kind, o * 100000000 + e.id as id, s, v.* from (select kind, o, id, unnest(nd) as node, generate_subscripts(nd, 1) as s from mkd) e join vn v on v.old_id = e.node)",
        "el as (select kind, id, list(new_id order by s) as nodes, avg(x) as x, avg(y) as y, avg(z) as z, max(case when s = 1 then c end) as c, max(case when s = 1 then g end) as g, min(new_id) as q0, max(new_id) as q1 from ml group by kind, id)",
        element,
        "select 'vertex' as kind, old_id, new_id, 0::bigint as nodes, g as grain from vn union all select kind, id % 100000000, row_number() over (partition by kind order by c, g, code, id), cast(list_reduce(list_prepend(0::bigint, nodes), lambda t, x: t * 7 % 1000003 + x) as bigint), g from el join ecodes using (id)", recursive=True)


SAME_CODES, SAME_ECODES = "codes as (select id, id as code from mpt)", "ecodes as (select id, id as code from el)"
MESH_BOX = "box as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from ver)"
ORDER = "select id as old_id, row_number() over (order by code, id) as new_id from codes"


def _smoothed(k: int) -> str:
    """Step k of the smoothing: tables t{k} and s{k + 1} from s{k}."""
    added = f"select node, sum(t) as t from links join t{k} using (elem) group by node"
    return (
        f"t{k} as (select elem, sum(value) as t from links join s{k} on s{k}.id = links.node group by elem), "
        f"s{k + 1} as (select s{k}.id, s{k}.value + coalesce(a.t / deg, 0) as value from s{k} join degree using (id) left join ({added}) a on a.node = s{k}.id)"
    )


def _with(*parts: str, recursive: bool = False) -> str:
    *ctes, last = parts
    return f"with {'recursive ' * recursive}{', '.join(ctes)} {last}"


def _mesh(*parts: str) -> str:
    return _with(GRID, *parts)


def _numbered(*parts: str) -> str:
    return _with(GRID, MESH_BOX, _codes_3d("ver"), f"num as ({ORDER})", *parts, recursive=True)


_PAIRS = """one as (select a as id, b as ngb from edges union all select b, a from edges), two as (select distinct x.id, y.ngb from one x join one y on x.ngb = y.id where x.id <> y.ngb),
vg as (select old_id as id, (new_id - 1) * 24 // nv as grain from num, sz), gp as (select distinct a.grain as g1, b.grain as g2 from two join vg a on a.id = two.id join vg b on b.id = two.ngb where a.grain < b.grain)"""


def oracle_sql() -> dict[str, str]:
    whole_sum = "cast(sum(value) as bigint) as value"
    gathered = "from links join verv on links.node = verv.id group by elem"
    scattered = "from ver left join (select node, value from links join tetn on links.elem = tetn.id) s on s.node = ver.id group by ver.id"
    tenth = "cast((id - 1) * 10 // nt as bigint)"
    out = {
        "mesh_scan": _mesh(f"select id, v0, v1, v2, v3, ref, {tenth} % 3 as color, {tenth} as grain from tet, sz"),
        "link_scan": "select l_orderkey, l_linenumber, l_partkey as v0, l_suppkey as v1 from lineitem",
        "bad_elements": _mesh("select 'tet' as kind, id from tet where id % 7 = 0 or id % 11 = 0"),
        "loop_direct": _mesh("select id, value * 3 + 1 as v3 from verv"),
        "loop_multi_arg": _mesh("select id, value * 5 - 2 as v3 from verv"),
        "mesh_roundtrip": _mesh("select 'vertex' as kind, id, cast(x + y * 10 + z * 100 as bigint) as checksum from ver union all select 'tet', id, ((v0 * 7 + v1) * 7 + v2) * 7 + v3 from tet"),
        "mesh_bbox": _with(CLOUD, "select x0 as x_lo, x1 as x_hi, y0 as y_lo, y1 as y_hi, z0 as z_lo, z1 as z_hi from box"),
        "type_register": _mesh("select 'ver' as type, count(*) as n, min(id) as lo, max(id) as hi, true as dense from ver union all select 'tet', count(*), min(id), max(id), true from tet"),
        "type_resize": _mesh("select count(*) + 10 as n, min(id) as lo, max(id) + 10 as hi, true as dense from ver"),
        "map_direct": "select l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) as v3 from lineitem",
        "map_trig": "select p_partkey, round(exp(ln(acos(cos(p_size + 1)))) + exp(ln(acos(cos(p_size * 2 + 2)))), 6) as v3 from part",
        "copy_direct": _mesh("select id, value from verv"),
        "mem_clear": "select o_orderkey, 0::double as o_totalprice from orders",
        "mem_copy": "select o_orderkey, o_totalprice as copy from orders",
        "block_lookup": _mesh("select id, (id - 1) // small as blk from tet, bs"),
        "block_interleave": _mesh("s as (select id, least((id * 28 + nt - 1) // nt - 1, 27) as slice, nt from tet, sz)", "select id, slice, case when nt >= 28 then slice else id - 1 end % 4 as owner from s"),
        "block_interleave_size": _mesh("s as (select id, case when nt >= 44 then least((id + 10) // 11 - 1, nt // 44 * 4 - 1) else least((id * 4 + nt - 1) // nt - 1, 3) end as slice from tet, sz)", "select id, slice, slice % 4 as owner from s"),
        "block_interleave_off": _mesh("s as (select id, least((id * 4 + nt - 1) // nt - 1, 3) as slice from tet, sz)", "select id, slice, slice % 4 as owner from s"),
        "fk_remap": _mesh("select id, " + ", ".join(f"1 + (v{i} - 1) * 5 % nv as v{i}" for i in range(4)) + " from tet, sz"),
        "permute_payload": _numbered("select new_id as id, value from num join verv on verv.id = num.old_id"),
        "gather_sum": _mesh(f"select elem as id, {whole_sum} {gathered}"),
        "gather_mean": _mesh(f"select elem as id, avg(value) as value {gathered}"),
        "scatter_add": _mesh(f"select ver.id, cast(coalesce(sum(value), 0) as bigint) as value {scattered}"),
        "locked_scatter": _mesh(f"select ver.id, cast(coalesce(sum(value), 0) as bigint) as value {scattered}"),
        "scatter_mean": _mesh(f"select ver.id, round(coalesce(avg(value), 0), 6) as value {scattered}"),
        "smooth_k": _mesh(DEGREE, "s0 as (select id, value::double as value from verv)", *map(_smoothed, range(2)), "select id, round(value, 6) as value from s2"),
        "tet_iterate": _with(GRID, DEGREE, "w as (select id, deg, 0 as step, 0::double as v from degree union all select id, deg, step + 1, sqrt(v * v + 1) + 1 from w where step < deg)", "select id, round(v, 6) as value from w where step = deg", recursive=True),
        "reduce_max": "select max(l_extendedprice) as max_price, max(l_quantity) as max_quantity from lineitem",
        "reduce_sum": "select cast(sum(cast(l_quantity as bigint)) as bigint) as total, round(sqrt(sum(l_quantity * l_quantity)), 6) as residual from lineitem",
        "ragged_sum": _mesh(FAN, "select fv.id, cast(coalesce(sum(fl.id % 97), 0) as bigint) as value from fv left join fl on fl.node = fv.id and kind = 'tet' group by fv.id"),
        "ragged_sum_64": _mesh(FAN, "k as (select node, id % 97 as value, row_number() over (partition by node order by id, slot) as k from fl where kind = 'tet')", "select fv.id, cast(coalesce(sum(value), 0) as bigint) as value from fv left join k on node = fv.id and k <= 64 group by fv.id"),
        "csr_offsets": _mesh(DEGREE, "select id, deg, cast(coalesce(sum(deg) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from degree"),
        "supplier_gather": "select l_orderkey as id, cast(sum(p_size) as bigint) as value from lineitem join part on l_partkey = p_partkey group by l_orderkey",
        "part_scatter": "select p_partkey as id, cast(coalesce(sum(cast(l_quantity as bigint)), 0) as bigint) as value from part left join lineitem on l_partkey = p_partkey group by p_partkey",
        "unique_edges": _mesh(EDGES, "select a, b from edges"),
        "edge_sort": _mesh(EDGES, "select a, b, row_number() over (order by a, b) as pos from edges"),
        "tet_neighbours": _mesh(FACES, "select tet_id, face::bigint as face, coalesce(ot, 0) as ngb, coalesce(of_, 0)::bigint as voy from pairs"),
        "neighbour_symmetry": "select 0::bigint as violations",
        "surface_extract": _mesh(FACES, "select t[1] as n0, t[2] as n1, t[3] as n2, case when ot is null then 0 else 1 end::bigint as ref from pairs where ot is null or (oref <> ref and tet_id > ot)"),
        "mixed_neighbours": _mesh(MIXED, "select gid, face::bigint as face, coalesce(ngb, 0) as ngb from mn"),
        "boundary_vertices": _mesh(MIXED, "select distinct unnest(fn) as id from mn where ngb is null"),
        "ball_rank1": _mesh(EDGES, "select a as id, b as ngb from edges union all select b, a from edges"),
        "ball_rank2": _mesh(EDGES, "one as (select a as id, b as ngb from edges union all select b, a from edges)", "select distinct x.id, y.ngb from one x join one y on x.ngb = y.id where x.id <> y.ngb"),
        "vertex_degree": _mesh(DEGREE, "select id, deg from degree"),
        "vertex_degree_kinds": _mesh(MIXED, MIXED_POINTS, "dk as (select kind, unnest(nd) as id from mkd)", "select mpt.id, " + ", ".join(f"count(*) filter (where kind = '{k}') as {k}" for k in ("tet", "pyramid", "prism", "hex")) + " from mpt left join dk using (id) group by mpt.id"),
        "degree_class": _mesh(FAN, FAN_DEGREES, "t as (select count(*) as n, sum(high::int) as h, sum(over_::int) as o from fh)", "m as (" + " union all ".join(f"select '{k}' as kind, coalesce(max({k}_) filter (where high), 0) as m from fh" for k in ("edge", "triangle", "quad", "tet", "pyramid", "prism", "hex")) + ")",
            "select kind, cast(m as bigint) as max_deg, cast(case when m > 0 then pow(2, ceil(log2(m))) else 0 end as bigint) as vec_size, cast(h as bigint) as high, cast(o as bigint) as over, round(100.0::double * h / n, 6) as high_pct, round(100.0::double * o / n, 6) as over_pct from m, t"),
        "edge_degree": _mesh(EDGES, EDGE_DEGREE.format(v="ver"), "select id, deg from ed"),
        "degree_histogram": _mesh(EDGES, EDGE_DEGREE.format(v="ver") + ", " + _slices(False).rpartition("select slice")[0].rstrip(), "select slice" + _slices(False).rpartition("select slice")[2]),
        "degree_histogram_out": _mesh(FAN, EDGES.replace("from tet", "from ftet"), EDGE_DEGREE.format(v="fv") + ", " + _slices(True).rpartition("select slice")[0].rstrip(), "select slice" + _slices(True).rpartition("select slice")[2]),
        "hilbert_code_3d": _with(CLOUD, _codes_3d("cloud"), "select id, code from codes", recursive=True),
        "zcurve_code": _with(CLOUD, _codes_3d("cloud", OCTREE, None), "select id, code from codes", recursive=True),
        "hilbert_code_2d": _with(CLOUD, _codes_2d("cloud"), "select id, code from codes", recursive=True),
        "hilbert_renumber_3d": _with(CLOUD, _codes_3d("cloud"), ORDER, recursive=True),
        "hilbert_renumber_2d": _with(CLOUD, _codes_2d("cloud"), ORDER, recursive=True),
        "random_renumber": "select 0::bigint as violations",
        "topo_code": _with(GRID, "ends as (select id, least(v0, v1, v2, v3) as q0, greatest(v0, v1, v2, v3) as q1 from tet)", _fold("ends", 2, 31, START_2D, TURN_2D), "select id, code from codes", recursive=True),
        "barycentre": _mesh("select elem as id, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from links join ver on ver.id = links.node group by elem"),
        "aniso_anchor": _mesh(
            "sv as (select id, x, y, z * 10 as z from ver)",
            "el as (select elem as id, " + ", ".join(f"max(case when slot = {s} then {c} end) as {c}{s}" for s in range(4) for c in "xyz") + " from links join sv on sv.id = links.node group by elem)",
            "eg as (select id, unnest([0, 1, 2, 3, 4, 5]) as e, unnest([" + ", ".join(f"[(x{p} - x{q}) ** 2 + (y{p} - y{q}) ** 2 + (z{p} - z{q}) ** 2, (x{p} + x{q}) / 2, (y{p} + y{q}) / 2, (z{p} + z{q}) / 2]" for p, q in ((0, 1), (1, 2), (2, 0), (3, 0), (3, 1), (3, 2))) + "]) as v from el)",
            "mx as (select id, max(v[1]) as hi, min(v[1]) as lo, arg_max(v, (v[1], -e)) as top from eg group by id)",
            "select id, " + ", ".join(f"round(case when hi > 9 * lo then top[{i + 2}] else ({c}0 + {c}1 + {c}2 + {c}3) / 4 end, 6) as {c}" for i, c in enumerate("xyz")) + " from el join mx using (id)",
        ),
        "composite_sort": _with(CLOUD, _codes_3d("cloud"), "select id as old_id, row_number() over (order by label, code, id) as new_id from codes join embeddings on vec_id + 1 = id", recursive=True),
        "ref_hash": "select o_orderkey, cast((" + " + ".join(f"(((r >> {s}) & 255) + 128) % 256 - 128" for s in (0, 8, 16, 24)) + ") & 255 as bigint) as code from (select o_orderkey, o_orderkey * 7919 % 2147483647 as r from orders)",
        "renumber_quality": _mesh("nat as (select 'natural' as mesh, elem, slot, node from links union all select 'shuffled', elem, slot, 1 + (node - 1) * 5 % nv from links, sz), nx as (select mesh, node, lead(node) over (partition by mesh order by elem, slot) - node as d from nat)", "select mesh, round(sum((d * d)::double) / (count(*)::double * (max(node) - min(node)) ** 2), 9) as quality from nx group by mesh"),
        "mesh_renumber": _with(GRID, MESH_BOX, _codes_3d("ver"), f"num as ({ORDER})",
            "bc as (select elem as id, avg(x) as x, avg(y) as y, avg(z) as z from links join ver on ver.id = links.node group by elem)",
            _again(_codes_3d("bc")),
            "enum as (select id, row_number() over (order by code, id) as new_id from ecodes)",
            "select e.new_id as id, a.new_id as v0, b.new_id as v1, c.new_id as v2, d.new_id as v3 from tet join enum e using (id) join num a on a.old_id = v0 join num b on b.old_id = v1 join num c on c.old_id = v2 join num d on d.old_id = v3", recursive=True),
        "mesh_renumber_mixed": _moved(False, _codes_3d("mpt"), _again(_codes_3d("el"))),
        "mesh_renumber_colors": _moved(True, _codes_3d("mpt"), _again(_codes_3d("el"))),
        "mesh_renumber_octree": _moved(False, _codes_3d("mpt", OCTREE, None), _again(_codes_3d("el", OCTREE, None))),
        "mesh_renumber_same": _moved(False, SAME_CODES, SAME_ECODES),
        "mesh_renumber_topological": _moved(False, _codes_3d("mpt"), _again(_fold("el", 2, 31, START_2D, TURN_2D))),
        "mesh_renumber_matrix": _mesh(FAN, EDGES.replace("from tet", "from ftet"), EDGE_DEGREE.format(v="fv"), "select id as old_id, row_number() over (order by case when deg <= 16 then 1 when deg <= 32 then 2 when deg <= 64 then 3 when deg <= 128 then 4 else 5 end, id) as new_id from ed"),
        "mesh_renumber_generic": _mesh(FAN, FAN_DEGREES, f"fr as (select kind, id, case when kind in ('triangle', 'quad') then {_REF} else 0 end as h from (select distinct kind, id, id * 7919 as r from fl))", "select 'vertex' as kind, id as old_id, row_number() over (order by high, id) as new_id from fh union all select kind, id, row_number() over (partition by kind order by h, id) from fr"),
        "mesh_renumber_fixed": _numbered(FACES, "bnd as (select distinct unnest(t) as id from pairs where ot is null), inn as (select old_id, row_number() over (order by new_id) as k from num where old_id not in (select id from bnd)), slo as (select id, row_number() over (order by id) as k from ver where id not in (select id from bnd))",
            "fx as (select old_id, slo.id as new_id from inn join slo using (k) union all select id, id from bnd)", "bc as (select elem as id, avg(x) as x, avg(y) as y, avg(z) as z from links join ver on ver.id = links.node group by elem)", _again(_codes_3d("bc")), "enum as (select id, row_number() over (order by code, id) as new_id from ecodes)",
            "select e.new_id as id, a.new_id as v0, b.new_id as v1, c.new_id as v2, d.new_id as v3 from tet join enum e using (id) join fx a on a.old_id = v0 join fx b on b.old_id = v1 join fx c on c.old_id = v2 join fx d on d.old_id = v3"),
        "renumber_fixbnd": _numbered(FACES, "bnd as (select distinct unnest(t) as id from pairs where ot is null), inn as (select old_id, row_number() over (order by new_id) as k from num where old_id not in (select id from bnd)), slo as (select id, row_number() over (order by id) as k from ver where id not in (select id from bnd))", "select old_id, slo.id as new_id from inn join slo using (k) union all select id, id from bnd"),
        "index_lookup": _numbered("select a.old_id as id, a.new_id, b.old_id from num a join num b on b.new_id = a.old_id"),
        "restore_numbering": _mesh("select id, value from verv"),
        "radix_sort_32": "select o_custkey as key, o_orderkey as seq, row_number() over (order by o_custkey, o_orderkey) as pos from orders",
        "radix_sort_64": "select o_custkey * 4294967296 + o_orderkey % 1024 as key, o_orderkey as seq, row_number() over (order by o_custkey * 4294967296 + o_orderkey % 1024, o_orderkey) as pos from orders",
        "radix_sort_unsigned": "select key, seq, row_number() over (order by key < 0, key, seq) as pos from (select o_custkey * case when o_orderkey % 2 = 0 then 1 else -1 end as key, o_orderkey as seq from orders)",
        "comparator_sort": "select c_custkey, row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) as pos from customer",
        "range_sort": "select l_partkey as key, l_orderkey, l_linenumber, row_number() over (order by l_partkey, l_orderkey, l_linenumber) as pos from lineitem",
        "block_partition": _mesh("select 'small' as level, (id - 1) // small as blk, min(id) as beg, max(id) as end_ from tet, bs group by 2 union all select 'big', least((id - 1) // greatest(1, nt // 4), 3), min(id), max(id) from tet, sz group by 2"),
        "dependency_matrix": _mesh("select blk, dep from matrix"),
        "dependency_update": _mesh("select blk, dep from matrix union select (e - 1) // small, (nv - e) // ds from bs, (select unnest(range(1, 11)) as e) union select (e - 1) // small, (v - 1) // ds from bs, (select unnest([1, nt]) as e from bs), (select unnest([nv // 2, 1]) as v from bs)"),
        "dependency_count": _mesh("pr as (select i * (nt // 10) as elem, nv + 3 - i as node, nt, nv, small, ds from (select unnest(range(21)) as i), bs)", "ok as (select *, elem between 1 and nt and node between 1 and nv as fits from pr)", "mm as (select blk, dep from matrix union select (elem - 1) // small, (node - 1) // ds from ok where fits)", "mc as (select blk, count(*) as n from mm group by blk)", "select elem, node, cast(case when fits then n else 0 end as bigint) as n from ok left join mc on blk = (elem - 1) // small"),
        "dependency_sizes": _mesh("c as (select unnest([1, 15, 16, 31, 32, nv, nt])::bigint as n from sz), d as (select n, unnest([0, 1, 100])::bigint as before from c)", "select n, before, case when n >= 16 then n // 16 else n end as small, case when n >= 32 and n >= 32 * before then n // 32 else n end as dep from d"),
        "dependency_stats": _mesh("cnt as (select blk, count(*) as n from matrix group by blk)", "select round(sum(n) * 100.0::double / (((nt + small - 1) // small) * ((nv + ds - 1) // ds)), 6) as avg_pct, round(max(n) * 100.0::double / ((nv + ds - 1) // ds), 6) as max_pct from cnt, bs group by nt, nv, small, ds"),
        "block_collisions": _mesh("select distinct a.blk as b1, b.blk as b2 from matrix a join matrix b using (dep) where a.blk < b.blk"),
        "block_order": _mesh("select blk, count(*) as n, row_number() over (order by count(*) desc, blk) as pos from matrix group by blk"),
        "block_launch_order": _mesh("select blk, 0::bigint as grp, row_number() over (order by blk) as pos from (select distinct blk from matrix)"),
        "bitset_ops": _mesh("x as (select dep from matrix where blk = 3), y as (select dep from matrix where blk = 4)", "select 'and' as op, dep from x where dep in (select dep from y) union all select 'or', dep from (select dep from x union select dep from y) union all select 'sub', dep from x where dep not in (select dep from y)"),
        "halve_small_blocks": _mesh("select distinct blk // 2 as blk, dep from matrix"),
        "halve_dep_blocks": _mesh("select distinct blk, dep // 2 as dep from matrix"),
        "adaptive_split": _mesh("w as (select blk, count(*) as weight from matrix group by blk), r as (select blk, coalesce(sum(weight) over (order by blk rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over () as total from w)", "select cast(least(before * 8 // total, 7) as bigint) as part, min(blk) as beg, max(blk) as end_ from r group by 1"),
        "static_schedule": "select 0::bigint as violations",
        "grain_partition": _numbered("select old_id as id, (new_id - 1) * 24 // nv as grain from num, sz"),
        "grain_coloring": "select 0::bigint as violations",
        "grain_adjacency": _numbered(EDGES, _PAIRS, "select g1, g2 from gp"),
        "grain_clashes": _numbered(EDGES, _PAIRS, "select g1, g2 from gp where g1 % 5 = g2 % 5"),
        "color_launch": _mesh("s0 as (select id, value from verv)", "lc as (select elem, node, (elem - 1) * 12 // nt % 3 as color from links, sz)", *(
            f"t{c} as (select elem, sum(value) % 97 as t from lc join s{c} on s{c}.id = node where color = {c} group by elem), s{c + 1} as (select s{c}.id, cast(s{c}.value + coalesce(a.t, 0) as bigint) as value from s{c} left join (select node, sum(t) as t from lc join t{c} using (elem) group by node) a on a.node = s{c}.id)" for c in range(3)), "select id, value from s3"),
        "color_check": _mesh("gr as (select elem, slot, node, (elem - 1) * 100 // nt as grain from links, sz), ft as (select grain, first_value(grain) over (partition by grain % 2, node order by elem, slot) as f from gr)", "select cast(sum((grain <> f)::int) as bigint) as violations from ft"),
        "grain_ranges": _mesh(f"own as (select id, {tenth} as grain from tet, sz)", "select g.grain, coalesce(min(id), 0) as beg, coalesce(max(id), 0) as end_ from (select unnest(range(12)) as grain) g left join own using (grain) group by g.grain"),
        "grain_deps": _mesh(EDGES, "one as (select a as id, b as ngb from edges union all select b, a from edges), two as (select distinct x.id, y.ngb from one x join one y on x.ngb = y.id where x.id <> y.ngb), vg as (select id, (id - 1) * 12 // nv as grain from ver, sz)", "select distinct a.grain as g1, b.grain as g2 from two join vg a on a.id = two.id join vg b on b.id = two.ngb where b.grain % 3 = a.grain % 3 - 1"),
        "grain_relabel": _mesh(f"lb as (select id, {tenth} * 7 % 10 as label from tet, sz), ch as (select id, label, case when label is distinct from lag(label) over (order by id) then 1 else 0 end as c from lb)", "select id, label, cast(sum(c) over (order by id) as bigint) as run from ch"),
        "grain_apply": _mesh(f"select id, {tenth} * 10 + id % 10 as ref from tet, sz"),
        "pipeline_dag": "select (select count(*) from lineitem) as lines, (select count(*) from orders) as orders, round((select count(*) from lineitem)::double / (select count(*) from orders), 6) as ratio",
    }
    return out
