"""One-dimensional transport queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from massflow.functions.prefix import buckets_for
from massflow.operators import measures as M
from massflow.operators import transport as T
from massflow.plans import tables as B

COST = "sum(dm * ((l - pos) * (l - pos) + (l - pos) * (r - pos) + (r - pos) * (r - pos)) / 3)"
BARY = "SELECT batch, id, any_value(pos) AS pos, any_value(w) AS w, sum(dm * (l + r) / 2) / sum(dm) AS b, max(r) AS t FROM pieces GROUP BY 1, 2"
PHI = f"""bary AS ({BARY}),
jump AS (SELECT *, CASE WHEN lead(pos) OVER o IS NULL THEN (t - pos) * (t - pos) ELSE (t - pos) * (t - pos) - (t - lead(pos) OVER o) * (t - lead(pos) OVER o) END AS phi_m FROM bary WINDOW o AS (PARTITION BY batch ORDER BY pos, id)),
pot AS (SELECT batch, id, pos, w, sum(phi_m) OVER (PARTITION BY batch ORDER BY pos, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS phi FROM jump)"""


def _events(spark, d):
    return T.pieces(B.event_points(spark, d), B.event_target(spark, d))


def _round(df, n, *cols):
    return df.select(*(F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns))


def ot1d_cost(spark, d):
    return _round(T.cost(_events(spark, d)), 6, "cost")


def ot1d_cost_weighted(spark, d):
    p = T.pieces(*B.lineitem_problem(spark, d))
    return T.cost(p).select("batch", F.round(F.col("cost") / 1e6, 6).alias("cost_millions"))


def ot1d_cost_presorted(spark, d):
    """Running masses made once, then the plan without sorting or normalizing again."""
    points, t = B.event_points(spark, d), B.event_target(spark, d)
    k = buckets_for(points, "batch")
    return _round(T.cost(T.pieces_presorted(T.sorted_points(points, k), T.cell_cum_mass(t, k), k)), 6, "cost")


def measure_plan(spark, d):
    """Two measures asked for what they can: masses, and the plan's cost of some batches."""
    points, cells = M.Measure("diracs", B.event_points(spark, d)), M.Measure("density", B.event_target(spark, d))
    some = ("click", "error")
    p = points.batch_slice(*some).plan_to(cells.batch_slice(*some))
    return T.cost(p).join(points.mass, "batch").select("batch", F.round("cost", 6).alias("cost"), F.round("mass", 4).alias("mass"))


def ot1d_cost_moments(spark, d):
    return _round(T.cost_by_moments(B.event_points(spark, d), B.event_target(spark, d)), 5, "cost")


def ot1d_cost_barycentric(spark, d):
    return _round(T.cost_by_barycenters(_events(spark, d)), 5, "cost")


def ot1d_barycenters(spark, d):
    return T.barycenters(_events(spark, d)).select("batch", "dirac_id", F.round("barycenter", 6).alias("barycenter"))


def ot1d_grad_position(spark, d):
    return T.grad_position(_events(spark, d)).select("batch", "dirac_id", F.round(F.col("grad") * 1e3, 6).alias("grad_milli"))


def ot1d_grad_weight(spark, d):
    points = B.event_points(spark, d)
    k = buckets_for(points, "batch")
    return T.grad_weight(T.pieces(points, B.event_target(spark, d), k), points, k).select("batch", "dirac_id", F.round("grad", 6).alias("grad"))


def ot1d_grad_density(spark, d):
    return T.grad_density(B.event_points(spark, d), B.event_target(spark, d)).select("batch", "cell_id", F.round("grad", 6).alias("grad"))


def ot1d_total_cost(spark, d):
    p = T.pieces(B.order_points(spark, d), B.order_target(spark, d))
    return T.cost(p).agg(F.round(F.sum("cost") / 1e6, 6).alias("total_cost_millions"))


def ot1d_udp_lookup(spark, d):
    levels = B.order_points(spark, d).select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("level_id")).withColumn("level", F.col("level_id") / 100)
    # In units of the density's width, to more digits than a share of a cell in 1024ths has: those would be ties.
    t = B.order_target(spark, d)
    side = t.groupBy("batch").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    return T.lookup(levels, t).join(side, "batch").select("batch", "level_id", F.round((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")), 10).alias("x"))


def fused_cost_grad(spark, d):
    return T.cost_and_gradient(_events(spark, d)).select("batch", "dirac_id", F.round(F.col("cost") * 1e3, 5).alias("cost_milli"), F.round(F.col("grad") * 1e3, 6).alias("grad_milli"))


def mass_points(spark, d):
    return _round(M.point_mass(B.lineitem_points(spark, d)), 4, "mass")


def mass_density(spark, d):
    return _round(M.density_mass(B.event_target(spark, d)), 4, "mass")


def normalize_points(spark, d):
    return M.normalize_points(B.lineitem_points(spark, d)).select("batch", "dirac_id", F.round(F.col("w") * 1e3, 9).alias("w_milli"))


def normalize_density(spark, d):
    return M.normalize_density(B.event_target(spark, d)).select("batch", "cell_id", F.round("y", 9).alias("y"))


def cell_cum_mass(spark, d):
    return T.cell_cum_mass(B.event_target(spark, d)).select("batch", "cell_id", F.round("c0", 9).alias("c0"))


QUERIES = {f.__name__: f for f in (ot1d_cost, ot1d_cost_weighted, ot1d_cost_presorted, measure_plan, ot1d_cost_moments, ot1d_cost_barycentric, ot1d_barycenters, ot1d_grad_position, ot1d_grad_weight, ot1d_grad_density, ot1d_total_cost, ot1d_udp_lookup, fused_cost_grad, mass_points, mass_density, normalize_points, normalize_density, cell_cum_mass)}

_E = B.plan_sql("events")
ORACLE = {
    "ot1d_cost": f"{_E} SELECT batch, round({COST}, 6) AS cost FROM pieces GROUP BY 1",
    "ot1d_cost_weighted": f"{B.plan_sql('lineitem')} SELECT batch, round({COST} / 1e6, 6) AS cost_millions FROM pieces GROUP BY 1",
    "ot1d_cost_presorted": f"{_E} SELECT batch, round({COST}, 6) AS cost FROM pieces GROUP BY 1",
    "measure_plan": f"{_E} SELECT batch, round({COST}, 6) AS cost, round(any_value(mass), 4) AS mass FROM pieces JOIN (SELECT event_type AS batch, count(*)::DOUBLE AS mass FROM events GROUP BY 1) USING (batch) WHERE batch IN ('click', 'error') GROUP BY 1",
    "ot1d_cost_moments": f"{_E} SELECT batch, round({COST}, 5) AS cost FROM pieces GROUP BY 1",
    "ot1d_cost_barycentric": f"{_E} SELECT batch, round({COST}, 5) AS cost FROM pieces GROUP BY 1",
    "ot1d_barycenters": f"{_E} SELECT batch, id AS dirac_id, round(b, 6) AS barycenter FROM ({BARY})",
    "ot1d_grad_position": f"{_E} SELECT batch, id AS dirac_id, round(2 * w * (pos - b) * 1e3, 6) AS grad_milli FROM ({BARY})",
    "ot1d_grad_weight": f"{_E}, {PHI}, mean AS (SELECT batch, sum(w * phi) AS mean FROM pot GROUP BY 1) SELECT batch, id AS dirac_id, round((phi - mean) / mass, 6) AS grad FROM pot JOIN mean USING (batch) JOIN dm USING (batch)",
    "ot1d_grad_density": f"""{_E}, {PHI},
own AS (SELECT p.batch, p.cell_id, sum((p.r - p.l) * (((p.l - p.pos) * (p.l - p.pos) + (p.l - p.pos) * (p.r - p.pos) + (p.r - p.pos) * (p.r - p.pos)) / 3 - phi)) AS g FROM pieces p JOIN pot USING (batch, id) GROUP BY 1, 2),
void AS (SELECT tn.batch, cell_id, (x1 - x0) * (((x0 - pos) * (x0 - pos) + (x0 - pos) * (x1 - pos) + (x1 - pos) * (x1 - pos)) / 3 - phi) AS g FROM tn JOIN (SELECT dn.*, phi, lead(q0) OVER (PARTITION BY dn.batch ORDER BY q0, dn.pos) AS qn FROM dn JOIN pot ON dn.batch = pot.batch AND dn.id = pot.id) k ON tn.batch = k.batch AND tn.c0 >= k.q0 AND (k.qn IS NULL OR tn.c0 < k.qn) WHERE m <= 0),
g AS (SELECT * FROM own UNION ALL SELECT * FROM void),
al AS (SELECT tw.batch, tw.cell_id, tw.y, x1 - x0 AS dx, coalesce(g.g, 0) AS g FROM tw LEFT JOIN g ON g.batch = tw.batch AND g.cell_id = tw.cell_id),
mn AS (SELECT batch, sum(g * y) AS mean FROM al GROUP BY 1)
SELECT batch, cell_id, round((g - dx * mean) / mass, 6) AS grad FROM al JOIN mn USING (batch) JOIN tm USING (batch)""",
    "ot1d_total_cost": f"{B.plan_sql('orders')} SELECT round({COST} / 1e6, 6) AS total_cost_millions FROM pieces",
    "ot1d_udp_lookup": f"""{B.plan_sql('orders')}, lv AS (SELECT DISTINCT batch, CAST(r.range AS BIGINT) AS level_id, r.range / 100.0 AS level FROM d, range(101) r)
SELECT batch, level_id, round((x0 + least((level - c0) / m, 1.0) * (x1 - x0) - lo) / (hi - lo), 10) AS x FROM hb, (SELECT lv.batch, level_id, level, x0, x1, m, c0, row_number() OVER (PARTITION BY lv.batch, level_id ORDER BY c0 DESC) AS k FROM lv JOIN tn ON lv.batch = tn.batch AND m > 0 AND (c0 < level OR c0 <= 0)) WHERE k = 1""",
    "fused_cost_grad": f"{_E}, g AS (SELECT batch, id, {COST} AS cost, any_value(pos) AS pos, any_value(w) AS w, sum(dm * (l + r) / 2) / sum(dm) AS b FROM pieces GROUP BY 1, 2) SELECT batch, id AS dirac_id, round(cost * 1e3, 5) AS cost_milli, round(2 * w * (pos - b) * 1e3, 6) AS grad_milli FROM g",
    "mass_points": f"{B.plan_sql('lineitem')} SELECT batch, round(mass, 4) AS mass FROM dm",
    "mass_density": f"{_E} SELECT batch, round(mass, 4) AS mass FROM tm",
    "normalize_points": f"{B.plan_sql('lineitem')} SELECT batch, id AS dirac_id, round(w * 1e3, 9) AS w_milli FROM dw",
    "normalize_density": f"{_E} SELECT batch, cell_id, round(y, 9) AS y FROM tw",
    "cell_cum_mass": f"{_E} SELECT batch, cell_id, round(c0, 9) AS c0 FROM tn",
}
