"""The mesh's table operator over fields and sinograms made from all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from massflow.operators import mesh as Q
from massflow.operators import mesh_tables as MT
from massflow.operators import radon as R
from massflow.plans.field_queries import _OPS, MESH, MESH_G
from massflow.plans.radon_queries import DISKS, _r, part_disks

c = F.col
SMOOTH, ITERATIONS = 0.05, 5
STEP, VARIATION, DELTA = 2e-3, 0.5, 0.05


def _mesh(spark):
    cells = Q.tiling(spark, **MESH)
    return MT.MeshTables(cells, MESH_G, Q.edges(cells)), cells.select("cell_id", "level", "ix", "iy").persist()


def _part_weights(spark, d, cells):
    """One and the number of parts whose center a cell holds."""
    sizes = [(k, MESH["cell"] * 2**k) for k in range(MESH["max_level"] + 1)]
    at = part_disks(spark, d).select("cx", "cy", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(h).alias("h")) for k, h in sizes))).alias("l"))
    held = at.groupBy(c("l.level").alias("level"), F.floor(c("cx") / c("l.h")).alias("ix"), F.floor(c("cy") / c("l.h")).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(held, ["level", "ix", "iy"], "left").select("cell_id", (1.0 + F.coalesce("n", F.lit(0))).alias("weight"))


def _part_sinogram(spark, d):
    return R.radon_disks(part_disks(spark, d), MESH_G.angles(spark), MESH_G)


def _named(df, cells):
    return df.join(F.broadcast(cells), "cell_id").drop("cell_id")


def mesh_project(spark, d):
    m, cells = _mesh(spark)
    return _r(m.project(_part_weights(spark, d, cells)), 6, "value")


def mesh_backproject(spark, d):
    m, cells = _mesh(spark)
    return _r(_named(m.backproject(_part_sinogram(spark, d)), cells), 5, "value")


def mesh_variation(spark, d):
    """Laplacian, Huber variation and its gradient of the parts' field."""
    m, cells = _mesh(spark)
    w = _part_weights(spark, d, cells)
    value, gradient = m.variation(w, 2.5)
    both = m.laplacian(w).withColumnRenamed("value", "laplacian").join(gradient.withColumnRenamed("value", "gradient"), "cell_id")
    return _r(_named(both, cells).join(F.broadcast(value.withColumnRenamed("value", "variation")), F.lit(True)), 6, "laplacian", "gradient", "variation")


def mesh_solve_cg(spark, d):
    """Five steps of conjugate gradients from the parts' sinogram."""
    m, cells = _mesh(spark)
    return _r(_named(m.conjugate_gradients(_part_sinogram(spark, d), SMOOTH, ITERATIONS), cells), 5, "weight")


def mesh_solve_fista(spark, d):
    """Five projected steps under total variation from the parts' sinogram."""
    m, cells = _mesh(spark)
    return _r(_named(m.projected_descent(_part_sinogram(spark, d), STEP, 0.0, VARIATION, DELTA, ITERATIONS), cells), 5, "weight")


QUERIES = {f.__name__: f for f in (mesh_project, mesh_backproject, mesh_variation, mesh_solve_cg, mesh_solve_fista)}

# ---- the same in SQL, from the whole operator ---------------------------------------------

_g = MESH_G
_under = lambda t: f"(least(greatest({t}, -r), r) * sqrt(greatest(r * r - least(greatest({t}, -r), r) * least(greatest({t}, -r), r), 0)) + r * r * asin(least(greatest(({t}) / r, -1.0), 1.0)))"
_edge = lambda k: f"({_g.s_min!r} + (b.range + {k}) * {_g.dw!r} - cx * nx - cy * ny)"
_CELLS = f"""{_OPS}, {DISKS}, id AS (SELECT *, CAST(row_number() OVER (ORDER BY level, ix, iy) - 1 AS INTEGER) AS i FROM tiles),
sino AS (SELECT angle_id, CAST(b.range AS INTEGER) AS bin_id, sum(({_under(_edge(1))} - {_under(_edge(0))}) / {_g.dw!r}) AS value FROM disks, angles, range({_g.nb_bins}) b GROUP BY 1, 2),
oc AS MATERIALIZED (SELECT i AS cell, angle_id, bin_id, val FROM op JOIN id USING (level, ix, iy)),
field AS (SELECT i AS cell, 1.0 + count(cx) AS w FROM id LEFT JOIN disks ON floor(cx / h) = ix AND floor(cy / h) = iy GROUP BY 1),
dd AS (SELECT p.i, q.i AS j, p.h AS hi, q.h AS hj, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM id p, id q),
ee AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, least(hi, hj) AS face, dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS n FROM dd) WHERE n <= 9 AND i != j AND dist < 0.75 * (hi + hj))"""


def _flow(k: str, w: str, flow: str) -> str:
    """f{k}(cell, v): the adjoint of differences applied to a flow of d = w_i - w_j."""
    return f"""e{k} AS (SELECT ee.*, a.w - b.w AS d FROM ee JOIN {w} a ON a.cell = i JOIN {w} b ON b.cell = j),
f{k} AS (SELECT cell, sum(v) AS v FROM (SELECT i AS cell, {flow} AS v FROM e{k} UNION ALL SELECT j, -({flow}) FROM e{k}) GROUP BY 1)"""


def _product(k: str, w: str) -> str:
    """n{k}(cell, v): the normal equations' product of a table (cell, w)."""
    return f"p{k} AS (SELECT angle_id, bin_id, sum(val * w) AS v FROM oc JOIN {w} USING (cell) GROUP BY 1, 2), n{k} AS (SELECT cell, sum(val * v) AS v FROM oc JOIN p{k} USING (angle_id, bin_id) GROUP BY 1)"


_near = lambda delta: f"least(greatest(d, -{delta!r}), {delta!r})"
_LAPLACE = "face / dist * d"
_NAMES = "level, ix, iy"


def _cg_sql() -> str:
    ctes = [
        _CELLS, "bb AS (SELECT cell, sum(val * value) AS v FROM oc JOIN sino USING (angle_id, bin_id) GROUP BY 1)",
        'kk AS (SELECT a.angle_id, a.level, sum(a.k * a.k) AS same, sum(a.k * coalesce(b.k, 0)) AS nxt FROM kern a LEFT JOIN kern b ON b.angle_id = a.angle_id AND b.level = a.level AND b."offset" = a."offset" + 1 GROUP BY 1, 2)',
        "dg AS (SELECT i AS cell, sum(((1 - (q - floor(q))) * (1 - (q - floor(q))) + (q - floor(q)) * (q - floor(q))) * same + 2 * (q - floor(q)) * (1 - (q - floor(q))) * nxt) AS v FROM pr JOIN kk USING (angle_id, level) JOIN id USING (level, ix, iy) GROUP BY 1)",
        f"deg AS (SELECT cell, {SMOOTH!r} * sum(v) AS v FROM (SELECT i AS cell, face / dist AS v FROM ee UNION ALL SELECT j, face / dist FROM ee) GROUP BY 1)",
        "s0 AS (SELECT cell, 1 / (dg.v + coalesce(deg.v, 0)) AS inverse, 0.0::DOUBLE AS x, bb.v AS r, 0.0::DOUBLE AS d, 0.0::DOUBLE AS image FROM dg LEFT JOIN deg USING (cell) JOIN bb USING (cell))", "z0 AS (SELECT 0.0::DOUBLE AS energy)",
    ]
    for k in range(1, ITERATIONS + 1):
        ctes.append(f"t{k} AS (SELECT coalesce(sum(inverse * r * image) / nullif(any_value(energy), 0), 0) AS beta FROM s{k - 1}, z{k - 1})")
        ctes.append(f"y{k} AS (SELECT cell, inverse, x, r, inverse * r - beta * d AS w FROM s{k - 1}, t{k})")
        ctes.append(_product(f"_{k}", f"y{k}"))
        ctes.append(_flow(f"_{k}", f"y{k}", _LAPLACE))
        ctes.append(f"m{k} AS (SELECT y.*, n.v + {SMOOTH!r} * coalesce(f.v, 0) AS image FROM y{k} y JOIN n_{k} n USING (cell) LEFT JOIN f_{k} f USING (cell))")
        ctes.append(f"z{k} AS (SELECT sum(w * image) AS energy, sum(w * r) AS along FROM m{k})")
        ctes.append(f"s{k} AS (SELECT cell, inverse, x + along / energy * w AS x, r - along / energy * image AS r, w AS d, image FROM m{k}, z{k})")
    return f"{', '.join(ctes)} SELECT {_NAMES}, round(s{ITERATIONS}.x, 5) AS weight FROM s{ITERATIONS} JOIN id ON i = cell"


def _fista_sql() -> str:
    ctes = [_CELLS, "bb AS (SELECT cell, sum(val * value) AS v FROM oc JOIN sino USING (angle_id, bin_id) GROUP BY 1)", "s0 AS (SELECT cell, 0.0::DOUBLE AS w, 0.0::DOUBLE AS move FROM bb)", "k0 AS (SELECT 0 AS k)"]
    for k in range(1, ITERATIONS + 1):
        ctes.append(f"y{k} AS (SELECT cell, s.w AS here, s.w + k / (k + 3) * move AS w FROM s{k - 1} s, k{k - 1})")
        ctes.append(_product(f"_{k}", f"y{k}"))
        ctes.append(_flow(f"_{k}", f"y{k}", f"face * {_near(DELTA)} / {DELTA!r}"))
        ctes.append(f"g{k} AS (SELECT cell, here, y.w, n.v + {VARIATION!r} * coalesce(f.v, 0) - bb.v AS g FROM y{k} y JOIN n_{k} n USING (cell) JOIN bb USING (cell) LEFT JOIN f_{k} f USING (cell))")
        ctes.append(f"s{k} AS (SELECT cell, greatest(w - {STEP!r} * g, 0) AS w, greatest(w - {STEP!r} * g, 0) - here AS move, g FROM g{k})")
        ctes.append(f"k{k} AS (SELECT CASE WHEN (SELECT sum(g * move) FROM s{k}) > 0 THEN 0 ELSE k + 1 END AS k FROM k{k - 1})")
    return f"{', '.join(ctes)} SELECT {_NAMES}, round(w, 5) AS weight FROM s{ITERATIONS} JOIN id ON i = cell"


ORACLE = {
    "mesh_project": f"{_CELLS} SELECT angle_id, bin_id, round(sum(val * w), 6) AS value FROM oc JOIN field USING (cell) GROUP BY 1, 2",
    "mesh_backproject": f"{_CELLS} SELECT {_NAMES}, round(sum(val * value), 5) AS value FROM oc JOIN sino USING (angle_id, bin_id) JOIN id ON i = cell GROUP BY 1, 2, 3",
    "mesh_variation": f"{_CELLS}, {_flow('l', 'field', _LAPLACE)}, {_flow('v', 'field', f'face * {_near(2.5)} / 2.5')}, vv AS (SELECT sum(face * ({_near(2.5)} * d - {_near(2.5)} * {_near(2.5)} / 2)) / 2.5 AS v FROM ev) SELECT {_NAMES}, round(fl.v, 6) AS laplacian, round(fv.v, 6) AS gradient, round(vv.v, 6) AS variation FROM fl JOIN fv USING (cell) JOIN id ON i = cell, vv",
    "mesh_solve_cg": _cg_sql(),
    "mesh_solve_fista": _fista_sql(),
}
