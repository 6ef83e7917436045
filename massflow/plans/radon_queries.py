"""Projection, sinogram, axis-algebra and cell queries over the driver tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from massflow.functions import axes as A
from massflow.functions import calls as K
from massflow.operators import cells as C
from massflow.operators import measures as M
from massflow.operators import radon as R
from massflow.operators import transport as T
from massflow.plans.tables import read

G = R.Geometry(16, 48, 8.0)
POINT_G = R.Geometry(16, 64, 2.0)
c = F.col

# ---- inputs -----------------------------------------------------------------


def part_disks(spark, d):
    """A disk per part of the first size classes: center from the key, radius from the size."""
    p = read(spark, d, "part")
    return p.select(c("p_partkey").alias("disk_id"), (((c("p_partkey") * 37) % 401) / 100.0 - 2.0).alias("cx"), (((c("p_partkey") * 53) % 397) / 100.0 - 1.98).alias("cy"), (0.1 + c("p_size") / 60.0).alias("r"), F.lit(1.0).alias("rho"))


DISKS = "disks AS (SELECT p_partkey AS disk_id, ((p_partkey * 37) % 401) / 100.0::DOUBLE - 2.0 AS cx, ((p_partkey * 53) % 397) / 100.0::DOUBLE - 1.98 AS cy, 0.1 + p_size / 60.0::DOUBLE AS r, 1.0::DOUBLE AS rho FROM part)"


def vec_points(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(c("vec_id").alias("dirac_id"), "label", c("embedding")[0].cast("double").alias("x"), c("embedding")[1].cast("double").alias("y"), F.lit(1.0).alias("w"))


POINTS = "pts AS (SELECT vec_id AS dirac_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 1.0::DOUBLE AS w FROM embeddings)"


def angles_sql(g: R.Geometry) -> str:
    return "angles(angle_id, nx, ny) AS (VALUES " + ", ".join(f"({k}, {math.cos(k * math.pi / g.nb_angles)!r}::DOUBLE, {math.sin(k * math.pi / g.nb_angles)!r}::DOUBLE)" for k in range(g.nb_angles)) + ")"


def _bins(g: R.Geometry) -> str:
    return f"bins AS (SELECT CAST(range AS INTEGER) AS bin_id, {g.s_min!r}::DOUBLE + range * {g.dw!r}::DOUBLE AS lo, {g.s_min!r}::DOUBLE + (range + 1) * {g.dw!r}::DOUBLE AS hi FROM range({g.nb_bins}))"


def sino_sql(kind: str) -> str:
    prim = {"disks": lambda t: f"({t}) * sqrt(greatest(r * r - ({t}) * ({t}), 0)) + r * r * asin(least(greatest(({t}) / r, -1.0), 1.0))", "tents": lambda t: f"(CASE WHEN ({t}) <= 0 THEN ({t}) + ({t}) * ({t}) / (2 * r) + r / 2 ELSE r / 2 + ({t}) - ({t}) * ({t}) / (2 * r) END)"}[kind]
    a, b = "least(greatest(lo - s0, -r), r)", "least(greatest(hi - s0, -r), r)"
    return f"""WITH {DISKS}, {angles_sql(G)}, {_bins(G)},
sh AS (SELECT disk_id, angle_id, nx, ny, r, rho, cx * nx + cy * ny AS s0 FROM disks, angles),
sino AS (SELECT angle_id, bin_id, sum(rho * (({prim(b)}) - ({prim(a)})) / {G.dw!r}) AS value FROM sh, bins GROUP BY 1, 2)"""


SINO = sino_sql("disks")


def _sino(spark, d):
    return R.radon_disks(part_disks(spark, d), G.angles(spark), G)


def _r(df, n, *cols):
    return df.select(*(F.round(k, n).alias(k) if k in cols else c(k) for k in df.columns))


def _rounded(x, n):
    """F.round(x, n), which goes through decimal text; only numbers near a tie or large ones need that."""
    t = x * 10.0**n
    plain = (F.abs(t) < 1e9) & (F.abs(t - F.floor(t) - 0.5) > 1e-4)
    return F.when(plain, F.floor(t + 0.5) / F.lit(10.0**n)).otherwise(F.round(x, n))


# ---- projection ---------------------------------------------------------------


def project_points(spark, d):
    return _r(R.project_points(vec_points(spark, d), POINT_G.angles(spark)).select("dirac_id", "angle_id", "s"), 9, "s")


def radon_disks(spark, d):
    return _r(_sino(spark, d), 6, "value")


def radon_tents(spark, d):
    return _r(R.radon_tents(part_disks(spark, d), G.angles(spark), G), 6, "value")


def sinogram_add_disk(spark, d):
    one = spark.createDataFrame([(0, 0.3, -0.2, 1.0, 2.0)], "disk_id int, cx double, cy double, r double, rho double")
    return _r(R.add_disks(_sino(spark, d), one, G.angles(spark), G), 6, "value")


def disk_projection_gradient(spark, d):
    at = R.disk_gradient(part_disks(spark, d), G.angles(spark), G)
    return at.select("disk_id", "angle_id", "bin_id", *(_rounded(c(k), 5).alias(k) for k in ("gx", "gy"))).where("gx != 0 OR gy != 0")


def sinogram_mass(spark, d):
    return _r(R.mass(_sino(spark, d), G), 5, "mass")


def sinogram_debias(spark, d):
    return _r(R.debias(_sino(spark, d), G), 5, "value")


def sinogram_density(spark, d):
    return _r(G.density(_sino(spark, d)), 6, "x0", "x1", "y")


def sinogram_diracs(spark, d):
    return _r(G.points(_sino(spark, d)), 6, "pos", "w")


def linear_deposit(spark, d):
    return _r(R.linear_deposit(vec_points(spark, d), POINT_G.angles(spark), POINT_G), 6, "value")


def coarse_regroup(spark, d):
    return _r(R.regroup(_sino(spark, d), R.coarse_group(G.nb_bins, 20)), 6, "value")


def coarse_repeat(spark, d):
    k = R.coarse_group(G.nb_bins, 20)
    return _r(R.repeat(R.regroup(_sino(spark, d), k), k), 6, "value")


def void_fraction(spark, d):
    return _r(R.void_fraction(vec_points(spark, d), -0.4, 0.4, 24), 9, "void")


def _sliced(spark, d):
    """Each label's points on each angle against all labels' 64-bin histogram over [-1, 1] of that angle."""
    at = R.project_points(vec_points(spark, d), POINT_G.angles(spark))
    batch = F.concat_ws("/", "label", "angle_id")
    bin_id = F.least(F.greatest(F.floor((c("s") + 1) / 2 * 64), F.lit(0)), F.lit(63)).cast("int")
    cells = at.groupBy("angle_id", bin_id.alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    labels = at.select("label", "angle_id").distinct()
    t = labels.join(cells, "angle_id").select(batch.alias("batch"), "cell_id", (-1 + c("cell_id") / 32).alias("x0"), (-1 + (c("cell_id") + 1) / 32).alias("x1"), "y")
    return M.diracs(at, batch, c("dirac_id"), c("s")), t


def sliced_cost(spark, d):
    p, t = _sliced(spark, d)
    return T.cost(T.pieces(p, t)).select(F.split("batch", "/")[0].cast("int").alias("label"), "cost").groupBy("label").agg(F.round(F.sum("cost"), 6).alias("cost"))


def point_gradient_2d(spark, d):
    return _gradient(spark, d).select("dirac_id", F.round(c("gx") * 1e3, 6).alias("gx_milli"), F.round(c("gy") * 1e3, 6).alias("gy_milli"))


def subspace_hessian(spark, d):
    p, t = _sliced(spark, d)
    bary = T.barycenters(T.pieces(p, t)).select(F.split("batch", "/")[1].cast("int").alias("angle_id"), "dirac_id", "barycenter")
    pts = vec_points(spark, d).select("dirac_id", "x", "y", c("x").alias("ax"), c("y").alias("ay"), (-c("y")).alias("bx"), c("x").alias("by"))
    h = R.subspace_hessian(pts, bary, POINT_G.angles(spark), ["a", "b"], F.lit(0.001))
    return _r(h, 6, *h.columns)


def split_points(spark, d):
    return _r(R.split_points(vec_points(spark, d), 3, F.lit(0.01)), 9, "x", "y")


def subsample_points(spark, d):
    return _r(R.subsample(vec_points(spark, d), 100).select("dirac_id", "x", "y"), 9, "x", "y")


def displacement(spark, d):
    p = vec_points(spark, d)
    q = p.select("dirac_id", (c("x") * 0.9 + 0.01).alias("x"), (c("y") * 1.1).alias("y"))
    return _r(R.displacement(p, q), 9, "most", "mean")


def direction_cosine(spark, d):
    p = vec_points(spark, d)
    q = p.select("dirac_id", (c("x") * 0.9 + 0.01).alias("x"), (c("y") * 1.1).alias("y"))
    r = q.select("dirac_id", (c("x") * 0.8).alias("x"), (c("y") + 0.3 * c("x")).alias("y"))
    return _r(R.direction_cosine(p, q, r), 9, "cosine")


# ---- axis algebra ---------------------------------------------------------------


def _table(spark, d):
    """v by (row, col): line quantities by ship mode of the key."""
    return read(spark, d, "lineitem").groupBy((c("l_orderkey") % 7).cast("int").alias("row"), (c("l_partkey") % 5).cast("int").alias("col")).agg((F.sum("l_quantity") / 1000).alias("v"))


def _row(spark, d):
    return read(spark, d, "orders").groupBy((c("o_orderkey") % 7).cast("int").alias("row")).agg((F.count(F.lit(1)) / 10.0).alias("v"))


_T = "t AS (SELECT CAST(l_orderkey % 7 AS INTEGER) AS row, CAST(l_partkey % 5 AS INTEGER) AS col, sum(l_quantity) / 1000 AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT CAST(o_orderkey % 7 AS INTEGER) AS row, count(*) / 10.0::DOUBLE AS v FROM orders GROUP BY 1)"


def axis_broadcast(spark, d):
    return _r(A.sub(_table(spark, d), _row(spark, d)), 6, "v")


def axis_floordiv_mod(spark, d):
    a, b = _table(spark, d), A.apply(_row(spark, d), lambda v: -v)
    q, m = A.floordiv(a, b), A.mod(a, b)
    return q.join(m.withColumnRenamed("v", "m"), ["row", "col"]).select("row", "col", c("v").cast("double").alias("q"), F.round("m", 6).alias("m"))


def axis_outer(spark, d):
    n = read(spark, d, "nation").select(c("n_nationkey").cast("int").alias("n"), c("n_nationkey").cast("double").alias("v"))
    r = read(spark, d, "region").select(c("r_regionkey").cast("int").alias("r"), (c("r_regionkey") + 0.5).cast("double").alias("v"))
    return A.mul(n, r)


def axis_dot(spark, d):
    return _r(A.dot(_table(spark, d), _row(spark, d), "row"), 4, "v")


def axis_reduce(spark, d):
    t = _table(spark, d)
    out = None
    for how in ("sum", "max", "min", "mean", "std"):
        one = A.reduce(t, how, ["row"]).withColumnRenamed("v", how)
        out = one if out is None else out.join(one, "col")
    return _r(out, 5, "sum", "max", "min", "mean", "std")


def axis_all_any(spark, d):
    t = A.apply(_table(spark, d), lambda v: (v > 5).cast("int"))
    return A.reduce(t, "all", ["row"]).withColumnRenamed("v", "every").join(A.reduce(t, "any", ["row"]).withColumnRenamed("v", "some"), "col")


def axis_prod(spark, d):
    return _r(A.reduce(A.apply(_table(spark, d), lambda v: 1 + v / 1e3), "prod", ["row"]), 6, "v")


def axis_argmax(spark, d):
    return A.argmax(_table(spark, d), "row").select("col", c("v").cast("int").alias("v"))


def axis_mean_ragged(spark, d):
    t = read(spark, d, "orders").select((c("o_custkey") % 10).cast("int").alias("outer"), c("o_orderkey").alias("inner"), c("o_totalprice").alias("v"))
    return _r(A.reduce(t, "mean", ["inner"]), 4, "v")


def axis_slice(spark, d):
    return _r(A.between(A.pick(_table(spark, d), "col", 2), "row", 1, 5), 6, "v")


def axis_clip_where(spark, d):
    return _r(A.apply(_table(spark, d), lambda v: A.where(v > 6, A.clip(v, 2.0, 7.5), F.sqrt(F.abs(v)))), 6, "v")


def axis_concat_pad(spark, d):
    r = _row(spark, d)
    return _r(A.padded(A.concat(A.between(r, "row", 0, 3), A.between(r, "row", 4, 7), "row", 3), "row", 9), 6, "v")


def vector_algebra(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 4).alias("m"))
    b = F.slice(c("m"), 1, 2)
    return e.select("vec_id", F.round(A.vdot(c("m"), F.reverse("m")), 8).alias("dot"), F.round(A.norm(c("m")), 8).alias("norm"), F.round(A.det2(c("m")), 8).alias("det"), F.round(F.get(A.solve2(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(3.0)), b), F.lit(0)), 8).alias("x0"))


def _other(spark, d):
    """v by (col, k): line counts by supplier and line number."""
    return read(spark, d, "lineitem").groupBy((c("l_suppkey") % 5).cast("int").alias("col"), (c("l_linenumber") % 3).cast("int").alias("k")).agg((F.count(F.lit(1)) / 100.0).alias("v"))


_O = "o AS (SELECT CAST(l_suppkey % 5 AS INTEGER) AS col, CAST(l_linenumber % 3 AS INTEGER) AS k, count(*) / 100.0::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"


def axis_matmul(spark, d):
    return _r(A.matmul(_table(spark, d), _other(spark, d).withColumnRenamed("col", "inner")), 7, "v")


def axis_assign(spark, d):
    """+= over the cells that a smaller table has, too."""
    part = A.apply(A.between(_table(spark, d), "row", 0, 3), lambda v: -v / 4)
    return _r(A.assign(_table(spark, d), part, lambda x, y: x + y), 6, "v")


def axis_views(spark, d):
    """An offset view beside evenly spaced knots, each column twice."""
    view = A.offset(A.row(A.transpose(_table(spark, d), "col", "row"), 3), row=2)
    return _r(A.repeat(A.hstack([view, A.linspace(spark, "row", 1.0, 2.0, 5)], "row", [5, 5]), "row", 2), 6, "v")


def axis_power(spark, d):
    return _r(A.power(A.apply(_table(spark, d), lambda v: v / 50), A.apply(_row(spark, d), lambda v: v / 100)), 6, "v")


def axis_arcsin(spark, d):
    return _r(A.apply(_table(spark, d), lambda v: F.asin(v / (1 + v))), 8, "v")


def vector_parts(spark, d):
    """Floor, ceil, extremes, place of the greatest and direction cosine of whole embeddings."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("m"))
    down, up = A.vmap(c("m"), F.floor), A.vmap(c("m"), F.ceil)
    return e.select("vec_id", F.aggregate(down, F.lit(0).cast("long"), lambda s, x: s + x).alias("down"), F.aggregate(up, F.lit(0).cast("long"), lambda s, x: s + x).alias("up"), F.round(F.array_min("m"), 8).alias("least"), F.round(F.array_max("m"), 8).alias("most"), A.vargmax(c("m")).alias("place"), F.round(A.cosine(c("m"), F.reverse("m")), 8).alias("cosine"))


def matrix_parts(spark, d):
    """Determinants of 3 x 3 and 4 x 4 arrays, a minor's, a diagonal's sum, and one with a column replaced."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("m"))
    four, three = F.slice("m", 1, 16), F.slice("m", 1, 9)
    return e.select("vec_id", F.round(A.det(four, 4), 5).alias("det4"), F.round(A.det(three, 3), 6).alias("det3"), F.round(A.det(A.minor(three, 3, 1, 2), 2), 7).alias("minor"), F.round(F.aggregate(A.diagonal(four, 4), F.lit(0.0), lambda s, x: s + x), 7).alias("trace"), F.round(A.det(A.replaced_column(three, 3, 1, F.slice("m", 10, 3)), 3), 6).alias("replaced"))


def _centered(item, errors, event_id, value):
    if not len(value):
        errors.report("no values in %s", item)
    return {"y": value - value.mean(), "sq": (value - value.mean()) ** 2}


def _centered_back(item, errors, columns, given):
    v = columns["value"]
    u = v - v.mean()
    g = given.get("y", np.zeros(len(v))) + 2 * u * given.get("sq", np.zeros(len(v)))
    return {"value": g - g.mean()}


CENTERED = K.Call(_centered, ("batch",), {"y": "double", "sq": "double"}, _centered_back, ("value",))


def _items(spark, d):
    return read(spark, d, "events").select(F.concat_ws("/", "event_type", (c("user_id") % 40).cast("string")).alias("batch"), "event_id", "value")


def call_forward(spark, d):
    """A user's body on every batch item's columns."""
    return _r(_r(CENTERED(_items(spark, d)).select("batch", "row", "y", "sq"), 8, "y"), 6, "sq")


def call_gradient(spark, d):
    """The user's derivative of the sum of squares, by value."""
    return _r(CENTERED.grad(_items(spark, d), "sq"), 8, "value")


def _gradient(spark, d):
    p, t = _sliced(spark, d)
    g = T.grad_position(T.pieces(p, t)).withColumn("angle_id", F.split("batch", "/")[1].cast("int"))
    return R.point_gradient(g.join(F.broadcast(POINT_G.angles(spark)), "angle_id"))


def gradient_step(spark, d):
    """All embeddings' points one step down the gradient."""
    return _r(R.descend(vec_points(spark, d), _gradient(spark, d), 0.5), 8, "x", "y")


def adam_step(spark, d):
    """All points' first Adam step: both moments are new, so it is the rate along the gradient's signs, but for epsilon."""
    moved = R.adam_step(vec_points(spark, d).select("dirac_id", "x", "y"), _gradient(spark, d), None, 1, 0.01, eps=1e-4)
    return _r(moved.select("dirac_id", "x", "y"), 7, "x", "y")


# ---- cells -------------------------------------------------------------------------


def _cells(spark, d):
    s = read(spark, d, "supplier")
    k = c("s_suppkey")
    return s.select(k.alias("cell_id"), (k % 13 / 4.0).alias("ox"), (k % 7 / 3.0).alias("oy"), (1 + k % 5 / 2.0).alias("ax"), (k % 3 / 9.0).alias("ay"), (-(k % 4) / 8.0).alias("bx"), (1 + k % 6 / 5.0).alias("by"))


_CELLS = "cells AS (SELECT s_suppkey AS cell_id, s_suppkey % 13 / 4.0::DOUBLE AS ox, s_suppkey % 7 / 3.0::DOUBLE AS oy, 1 + s_suppkey % 5 / 2.0::DOUBLE AS ax, s_suppkey % 3 / 9.0::DOUBLE AS ay, -(s_suppkey % 4) / 8.0::DOUBLE AS bx, 1 + s_suppkey % 6 / 5.0::DOUBLE AS \"by\" FROM supplier)"
_VERT = f"{_CELLS}, k(vertex_id, u, v) AS (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)), vert AS (SELECT cell_id, vertex_id, ox + u * ax + v * bx AS x, oy + u * ay + v * \"by\" AS y FROM cells, k)"


def hypercube_vertices(spark, d):
    return _r(C.hypercube_vertices(_cells(spark, d)), 9, "x", "y")


def hypercube_cuts(spark, d):
    """How far each vertex stands from its own two cuts (0) and the other two (1)."""
    v, k = C.hypercube_vertices(_cells(spark, d)), C.hypercube_cuts(_cells(spark, d))
    far = v.join(k, "cell_id").select("cell_id", "vertex_id", "cut_id", F.abs(F.round(c("offset") - c("dx") * c("x") - c("dy") * c("y"), 6)).alias("gap"))
    return far


def cell_measure(spark, d):
    return _r(C.measure(C.hypercube_vertices(_cells(spark, d))), 9, "area")


def cell_measure_grad(spark, d):
    return _r(C.measure_gradient(C.hypercube_vertices(_cells(spark, d))), 9, "gx", "gy")


def hypercube_adjoint(spark, d):
    g = C.hypercube_adjoint(C.measure_gradient(C.hypercube_vertices(_cells(spark, d))))
    return g.select("cell_id", *(F.round(k, 9).alias(k) for k in ("gax", "gay", "gbx", "gby")))


QUERIES = {f.__name__: f for f in (project_points, radon_disks, radon_tents, sinogram_add_disk, disk_projection_gradient, sinogram_mass, sinogram_debias, sinogram_density, sinogram_diracs, linear_deposit, coarse_regroup, coarse_repeat, void_fraction, sliced_cost, point_gradient_2d, subspace_hessian, split_points, subsample_points, displacement, direction_cosine, axis_broadcast, axis_floordiv_mod, axis_outer, axis_dot, axis_reduce, axis_all_any, axis_prod, axis_argmax, axis_mean_ragged, axis_slice, axis_clip_where, axis_concat_pad, axis_matmul, axis_assign, axis_views, axis_power, axis_arcsin, vector_algebra, vector_parts, matrix_parts, call_forward, call_gradient, gradient_step, adam_step, hypercube_vertices, hypercube_cuts, cell_measure, cell_measure_grad, hypercube_adjoint)}

_PROJ = f"WITH {POINTS}, {angles_sql(POINT_G)}, proj AS (SELECT dirac_id, label, angle_id, nx, ny, x, y, x * nx + y * ny AS s FROM pts, angles)"
_SLICED = f"""{_PROJ},
d AS (SELECT label, angle_id, nx, ny, label || '/' || angle_id AS batch, dirac_id AS id, s AS pos FROM proj),
cells AS (SELECT angle_id, CAST(least(greatest(floor((s + 1) / 2 * 64), 0), 63) AS INTEGER) AS cell_id, count(*)::DOUBLE AS y FROM proj GROUP BY 1, 2),
n AS (SELECT label, count(*)::DOUBLE AS n FROM pts GROUP BY 1), tot AS (SELECT count(*)::DOUBLE AS n FROM pts),
dn AS (SELECT d.*, 1 / n AS w, (row_number() OVER (PARTITION BY batch ORDER BY pos, id) - 1) / n AS q0 FROM d JOIN n USING (label)),
tn AS (SELECT angle_id, cell_id, -1 + cell_id / 32.0::DOUBLE AS x0, y / tot.n AS m, coalesce(sum(y) OVER (PARTITION BY angle_id ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / tot.n AS c0 FROM cells, tot),
ov AS (SELECT dn.*, x0, m, c0, greatest(q0, c0) AS a, least(q0 + w, c0 + m) AS b FROM dn JOIN tn ON dn.angle_id = tn.angle_id AND q0 < c0 + m AND c0 < q0 + w),
pieces AS (SELECT *, b - a AS dm, x0 + (a - c0) / m / 32 AS l, x0 + (b - c0) / m / 32 AS r FROM ov WHERE b - a > 1e-14)"""
_STEP = f"{_SLICED}, g AS (SELECT batch, id, nx, ny, 2 * any_value(w) * (any_value(pos) - sum(dm * (l + r) / 2) / sum(dm)) AS g FROM pieces GROUP BY 1, 2, 3, 4), s AS (SELECT id AS dirac_id, sum(g * nx) AS gx, sum(g * ny) AS gy FROM g GROUP BY 1)"
_CENTERED = "WITH i AS (SELECT event_type || '/' || CAST(user_id % 40 AS VARCHAR) AS batch, event_id, value FROM events), u AS (SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY event_id, value) - 1 AS INTEGER) AS row, value - avg(value) OVER (PARTITION BY batch) AS u FROM i)"


def _det_sql(at: list[list[int]]) -> str:
    """Determinant of the list's elements at the given places, expanded along the first column."""
    if len(at) == 1:
        return f"m[{at[0][0]}]"
    return "(" + " ".join(f"{'-' if i % 2 else '+'} m[{r[0]}] * {_det_sql([q[1:] for k, q in enumerate(at) if k != i])}" for i, r in enumerate(at)) + ")"


_DB = f"per AS (SELECT angle_id, sum(value) * {G.dw!r} AS mass, min(value) AS least FROM sino GROUP BY 1), lv AS (SELECT max(mass - least * {G.extent!r}) AS m FROM per)"
_chord = lambda u: f"(CASE WHEN abs({u}) < r THEN 2 * sqrt(greatest(r * r - ({u}) * ({u}), 0)) ELSE 0 END)"
_fine = R.coarse_group(G.nb_bins, 20)
_REP = f"SELECT angle_id, CAST(bin_id // {_fine} AS INTEGER) AS cbin, avg(value) AS value FROM sino GROUP BY 1, 2"
ORACLE = {
    "project_points": f"{_PROJ} SELECT dirac_id, angle_id, round(s, 9) AS s FROM proj",
    "radon_disks": f"{SINO} SELECT angle_id, bin_id, round(value, 6) AS value FROM sino",
    "radon_tents": f"{sino_sql('tents')} SELECT angle_id, bin_id, round(value, 6) AS value FROM sino",
    "sinogram_add_disk": SINO.replace("FROM part)", "FROM part UNION ALL SELECT 0, 0.3, -0.2, 1.0, 2.0)") + " SELECT angle_id, bin_id, round(value, 6) AS value FROM sino",
    "disk_projection_gradient": f"{SINO}, g AS (SELECT disk_id, angle_id, bin_id, nx, ny, -rho * ({_chord('hi - s0')} - {_chord('lo - s0')}) / {G.dw!r} AS d FROM sh, bins) SELECT disk_id, angle_id, bin_id, round(d * nx, 5) + 0.0 AS gx, round(d * ny, 5) + 0.0 AS gy FROM g WHERE round(d * nx, 5) != 0 OR round(d * ny, 5) != 0",
    "sinogram_mass": f"{SINO} SELECT angle_id, round(sum(value) * {G.dw!r}, 5) AS mass FROM sino GROUP BY 1",
    "sinogram_debias": f"{SINO}, {_DB} SELECT angle_id, bin_id, round(value - (mass - m) / {G.extent!r}, 5) AS value FROM sino JOIN per USING (angle_id), lv",
    "sinogram_density": f"{SINO} SELECT angle_id AS batch, bin_id AS cell_id, round(lo, 6) AS x0, round(hi, 6) AS x1, round(value, 6) AS y FROM sino JOIN bins USING (bin_id)",
    "sinogram_diracs": f"{SINO} SELECT angle_id AS batch, bin_id AS dirac_id, round((lo + hi) / 2, 6) AS pos, round(value, 6) AS w FROM sino JOIN bins USING (bin_id)",
    "linear_deposit": f"{_PROJ}, {_bins(POINT_G)}, dq AS (SELECT angle_id, (s - {POINT_G.s_min!r}) / {POINT_G.dw!r} - 0.5 AS q FROM proj), two AS (SELECT angle_id, CAST(floor(q) AS INTEGER) AS bin_id, 1 - (q - floor(q)) AS v FROM dq UNION ALL SELECT angle_id, CAST(floor(q) AS INTEGER) + 1, q - floor(q) FROM dq), dep AS (SELECT angle_id, bin_id, sum(v) / {POINT_G.dw!r} AS value FROM two GROUP BY 1, 2) SELECT a.angle_id, b.bin_id, round(coalesce(value, 0), 6) AS value FROM angles a CROSS JOIN bins b LEFT JOIN dep ON dep.angle_id = a.angle_id AND dep.bin_id = b.bin_id",
    "coarse_regroup": f"{SINO} SELECT angle_id, cbin, round(value, 6) AS value FROM ({_REP})",
    "coarse_repeat": f"{SINO}, co AS ({_REP}) SELECT angle_id, bin_id, round(value, 6) AS value FROM co JOIN bins ON bin_id // {_fine} = cbin",
    "void_fraction": f"WITH {POINTS}, i AS (SELECT DISTINCT floor((x + 0.4) / ({0.8 / 24!r})) AS ix, floor((y + 0.4) / ({0.8 / 24!r})) AS iy FROM pts) SELECT round(1 - count(*) / 576.0::DOUBLE, 9) AS void FROM i WHERE ix BETWEEN 0 AND 23 AND iy BETWEEN 0 AND 23",
    "sliced_cost": f"{_SLICED} SELECT label, round(sum(dm * ((l - pos) * (l - pos) + (l - pos) * (r - pos) + (r - pos) * (r - pos)) / 3), 6) AS cost FROM pieces GROUP BY 1",
    "axis_matmul": f"WITH {_T}, {_O} SELECT row, k, round(sum(t.v * o.v), 7) AS v FROM t JOIN o USING (col) GROUP BY 1, 2",
    "axis_assign": f"WITH {_T} SELECT row, col, round(CASE WHEN row < 3 THEN v - v / 4 ELSE v END, 6) AS v FROM t",
    "axis_views": f"WITH {_T}, h AS (SELECT row - 2 AS row, v FROM t WHERE col = 3 AND row >= 2 UNION ALL SELECT CAST(5 + r.range AS INTEGER), 1 + r.range / 4.0 FROM range(5) r) SELECT CAST(row * 2 + k.range AS INTEGER) AS row, round(v, 6) AS v FROM h, range(2) k",
    "axis_power": f"WITH {_T} SELECT row, col, round(pow(t.v / 50, r.v / 100), 6) AS v FROM t JOIN r USING (row)",
    "axis_arcsin": f"WITH {_T} SELECT row, col, round(asin(v / (1 + v)), 8) AS v FROM t",
    "vector_parts": "WITH m AS (SELECT vec_id, [x::DOUBLE * 10 for x in embedding] AS m FROM embeddings) SELECT vec_id, CAST(list_sum([floor(x) for x in m]) AS BIGINT) AS down, CAST(list_sum([ceil(x) for x in m]) AS BIGINT) AS up, round(list_min(m), 8) AS least, round(list_max(m), 8) AS most, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS place, round(list_cosine_similarity(m, list_reverse(m)), 8) AS cosine FROM m",
    "matrix_parts": f"WITH m AS (SELECT vec_id, [x::DOUBLE * 10 for x in embedding] AS m FROM embeddings) SELECT vec_id, round({_det_sql([[1 + 4 * i + j for j in range(4)] for i in range(4)])}, 5) AS det4, round({_det_sql([[1, 2, 3], [4, 5, 6], [7, 8, 9]])}, 6) AS det3, round(m[1] * m[8] - m[2] * m[7], 7) AS minor, round(m[1] + m[6] + m[11] + m[16], 7) AS trace, round({_det_sql([[1, 10, 3], [4, 11, 6], [7, 12, 9]])}, 6) AS replaced FROM m",
    "call_forward": f"{_CENTERED} SELECT batch, row, round(u, 8) AS y, round(u * u, 6) AS sq FROM u",
    "call_gradient": f"{_CENTERED} SELECT batch, row, round(2 * u - avg(2 * u) OVER (PARTITION BY batch), 8) AS value FROM u",
    "gradient_step": f"{_STEP} SELECT pts.dirac_id, label, round(x - 0.5 * coalesce(gx, 0), 8) AS x, round(y - 0.5 * coalesce(gy, 0), 8) AS y, w FROM pts LEFT JOIN s USING (dirac_id)",
    "adam_step": f"{_STEP} SELECT pts.dirac_id, round(x - 0.01 * coalesce(gx, 0) / (abs(coalesce(gx, 0)) + 1e-4), 7) AS x, round(y - 0.01 * coalesce(gy, 0) / (abs(coalesce(gy, 0)) + 1e-4), 7) AS y FROM pts LEFT JOIN s USING (dirac_id)",
    "point_gradient_2d": f"{_SLICED}, g AS (SELECT batch, id, nx, ny, 2 * any_value(w) * (any_value(pos) - sum(dm * (l + r) / 2) / sum(dm)) AS g FROM pieces GROUP BY 1, 2, 3, 4) SELECT id AS dirac_id, round(sum(g * nx) * 1e3, 6) AS gx_milli, round(sum(g * ny) * 1e3, 6) AS gy_milli FROM g GROUP BY 1",
    "subspace_hessian": f"{_SLICED}, b AS (SELECT id AS dirac_id, angle_id, sum(dm * (l + r) / 2) / sum(dm) AS b FROM pieces GROUP BY 1, 2), e AS (SELECT s, b, x * nx + y * ny AS e0, -y * nx + x * ny AS e1 FROM proj JOIN b USING (dirac_id, angle_id)) SELECT round(sum(0.002 * e0 * e0), 6) AS h_0_0, round(sum(0.002 * e0 * e1), 6) AS h_0_1, round(sum(0.002 * e1 * e1), 6) AS h_1_1, round(sum(0.002 * (s - b) * e0), 6) AS b_0, round(sum(0.002 * (s - b) * e1), 6) AS b_1 FROM e",
    "split_points": f"WITH {POINTS}, k AS (SELECT dirac_id * 3 + r.range AS child, x, y FROM pts, range(3) r) SELECT child AS dirac_id, round(x + 0.01 * ((child * 48271 + 11) % 2147483647 % 1000003 / 500001.5::DOUBLE - 1), 9) AS x, round(y + 0.01 * ((child * 69621 + 7) % 2147483647 % 1000003 / 500001.5::DOUBLE - 1), 9) AS y FROM k",
    "subsample_points": f"WITH {POINTS} SELECT dirac_id, round(x, 9) AS x, round(y, 9) AS y FROM pts ORDER BY (dirac_id * 48271 + 11) % 2147483647, dirac_id LIMIT 100",
    "direction_cosine": f"WITH {POINTS}, s AS (SELECT 0.01 - 0.1 * x AS ax, 0.1 * y AS ay, -0.2 * (0.9 * x + 0.01) AS bx, 0.3 * (0.9 * x + 0.01) AS b2 FROM pts) SELECT round(sum(ax * bx + ay * b2) / sqrt(sum(ax * ax + ay * ay) * sum(bx * bx + b2 * b2)), 9) AS cosine FROM s",
    "displacement": f"WITH {POINTS} SELECT round(max(greatest(abs(0.01 - 0.1 * x), abs(0.1 * y))), 9) AS most, round(avg(sqrt((0.01 - 0.1 * x) * (0.01 - 0.1 * x) + 0.01 * y * y)), 9) AS mean FROM pts",
    "axis_broadcast": f"WITH {_T} SELECT row, col, round(t.v - r.v, 6) AS v FROM t JOIN r USING (row)",
    "axis_floordiv_mod": f"WITH {_T} SELECT row, col, floor(t.v / -r.v) AS q, round(t.v + r.v * floor(t.v / -r.v), 6) AS m FROM t JOIN r USING (row)",
    "axis_outer": "SELECT CAST(n_nationkey AS INTEGER) AS n, CAST(r_regionkey AS INTEGER) AS r, n_nationkey::DOUBLE * (r_regionkey + 0.5)::DOUBLE AS v FROM nation, region",
    "axis_dot": f"WITH {_T} SELECT col, round(sum(t.v * r.v), 4) AS v FROM t JOIN r USING (row) GROUP BY 1",
    "axis_reduce": f"WITH {_T} SELECT col, round(sum(v), 5) AS sum, round(max(v), 5) AS max, round(min(v), 5) AS min, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM t GROUP BY 1",
    "axis_all_any": f"WITH {_T} SELECT col, bool_and(v > 5) AS every, bool_or(v > 5) AS some FROM t GROUP BY 1",
    "axis_prod": f"WITH {_T} SELECT col, round(product(1 + v / 1e3), 6) AS v FROM t GROUP BY 1",
    "axis_argmax": f"WITH {_T} SELECT col, row AS v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v DESC, row) AS k FROM t) WHERE k = 1",
    "axis_mean_ragged": "SELECT CAST(o_custkey % 10 AS INTEGER) AS \"outer\", round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1",
    "axis_slice": f"WITH {_T} SELECT row - 1 AS row, round(v, 6) AS v FROM t WHERE col = 2 AND row BETWEEN 1 AND 4",
    "axis_clip_where": f"WITH {_T} SELECT row, col, round(CASE WHEN v > 6 THEN least(greatest(v, 2.0), 7.5) ELSE sqrt(abs(v)) END, 6) AS v FROM t",
    "axis_concat_pad": f"WITH {_T}, k AS (SELECT CASE WHEN row < 3 THEN row ELSE row - 1 END AS row, v FROM r WHERE row != 3) SELECT CAST(g.range AS INTEGER) AS row, round(coalesce(v, 0), 6) AS v FROM range(9) g LEFT JOIN k ON k.row = g.range",
    "vector_algebra": "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings) SELECT vec_id, round(2 * (a * d + b * c), 8) AS dot, round(sqrt(a * a + b * b + c * c + d * d), 8) AS norm, round(a * d - b * c, 8) AS det, round((3 * a - b) / 5, 8) AS x0 FROM e",
    "hypercube_vertices": f"WITH {_VERT} SELECT cell_id, vertex_id, round(x, 9) AS x, round(y, 9) AS y FROM vert",
    "hypercube_cuts": f"WITH {_VERT}, cu(cut_id) AS (VALUES (0), (1), (2), (3)) SELECT cell_id, vertex_id, cut_id, CASE WHEN vertex_id = cut_id OR vertex_id = (cut_id + 1) % 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS gap FROM vert, cu",
    "cell_measure": f"WITH {_CELLS} SELECT cell_id, round(ax * \"by\" - ay * bx, 9) AS area FROM cells",
    "cell_measure_grad": f"WITH {_VERT} SELECT p.cell_id, p.vertex_id, round((n.y - q.y) / 2, 9) AS gx, round((q.x - n.x) / 2, 9) AS gy FROM vert p JOIN vert n ON n.cell_id = p.cell_id AND n.vertex_id = (p.vertex_id + 1) % 4 JOIN vert q ON q.cell_id = p.cell_id AND q.vertex_id = (p.vertex_id + 3) % 4",
    "hypercube_adjoint": f"WITH {_CELLS} SELECT cell_id, round(\"by\", 9) AS gax, round(-bx, 9) + 0.0 AS gay, round(-ay, 9) + 0.0 AS gbx, round(ax, 9) AS gby FROM cells",
}
