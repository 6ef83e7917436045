"""Halo, mesh, reconstruction, run and live queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from massflow.functions.stored import Store
from massflow.operators import descent as D
from massflow.operators import halo as H
from massflow.operators import mesh as Q
from massflow.operators import radon as R
from massflow.operators import reconstruct as X
from massflow.operators import sliced as S
from massflow.plans.radon_queries import DISKS, G, POINT_G, POINTS, SINO, _r, angles_sql, part_disks, vec_points
from massflow.plans.tables import read
from massflow.sources import phantoms, runs
from massflow.streaming import live

c = F.col
HALO_G = R.Geometry(6, 32, 4.0)
MESH_G = R.Geometry(5, 24, 6.0)
MESH = {"inner": 2.0, "outer": 6.0, "cell": 0.5, "max_level": 2}
DISK_G = R.Geometry(8, 201, 6.0)

# ---- halo ------------------------------------------------------------------------


def _halo_cells(spark):
    return H.build_cells(spark, 2.0, 5.0, 1.6, 8)


def _part_sites(spark, d):
    return part_disks(spark, d).select((c("cx") * 1.8).alias("x"), (c("cy") * 1.8).alias("y"))


def _held(spark, d):
    """Parts per halo cell."""
    return H.locate(_halo_cells(spark), _part_sites(spark, d)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def halo_cells(spark, d):
    """The cells, with the parts that each holds."""
    cells = _halo_cells(spark).join(_held(spark, d), "cell_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _r(cells, 9, "a", "b", "phi0", "phi1")


def _part_operator(spark, d):
    op = H.operator(_halo_cells(spark), HALO_G.angles(spark), HALO_G)
    return op.join(F.broadcast(_held(spark, d)), "cell_id").select("cell_id", "angle_id", "bin_id", (c("val") * c("n")).alias("val"))


def halo_operator(spark, d):
    """The operator's entries, weighted by the parts of each cell."""
    return _r(_part_operator(spark, d), 4, "val").where("val != 0")


def halo_gram(spark, d):
    op = _part_operator(spark, d).withColumn("val", c("val") / 100)
    return _r(H.gram(op, ["angle_id", "bin_id"]), 4, "v").where("v != 0")


def halo_smoothness(spark, d):
    """Differences of the parts' number between neighbouring sectors."""
    rows = H.smoothness_rows(_halo_cells(spark)).join(_held(spark, d), "cell_id", "left")
    return rows.groupBy("row").agg(F.sum(c("coef") * F.coalesce("n", F.lit(0))).alias("difference"))


def _part_field(spark, d, g):
    """The sinogram of all parts, those beyond the detector's reach too, and that of the parts wholly inside it."""
    disks = part_disks(spark, d)
    inside = disks.where(F.sqrt(c("cx") * c("cx") + c("cy") * c("cy")) + c("r") <= g.extent / 2)
    return tuple(R.radon_disks(t, g.angles(spark), g).persist() for t in (disks, inside))


def halo_fit(spark, d):
    g = R.Geometry(12, 100, 3.0)
    sino, inside = _part_field(spark, d, g)
    h = H.Halo(spark, g, outer=4.0, nb_sectors=16, nb_coarse_bins=50)
    rest = sino.join(inside.withColumnRenamed("value", "own"), ["angle_id", "bin_id"]).select("angle_id", "bin_id", (c("value") - c("own")).alias("value"))
    m = R.mass(sino, g)
    least = m.agg(F.min("mass")).first()[0]
    h.fit(rest, m.select("angle_id", F.greatest(c("mass") - F.lit(least), F.lit(0.0)).alias("mass")))
    return h._weighted().join(h.cells, "cell_id").select("cell_id", "ring", "sector", "weight")


def alternate_run(spark, d):
    g = R.Geometry(12, 100, 3.0)
    sino, inside = _part_field(spark, d, g)
    h = H.Halo(spark, g, outer=4.0, nb_sectors=12, nb_coarse_bins=50)

    def solve(s):
        total = R.mass(s, g).agg(F.min("mass")).first()[0]
        own = R.mass(inside, g).agg(F.avg("mass")).first()[0]
        return inside.withColumn("value", c("value") * (total / own))

    _, history = H.alternate(h, sino, solve)
    return spark.createDataFrame([(x["pass"], float(x["halo_mass"]), x["active"]) for x in history], "pass int, halo_mass double, active int")


def interior_mass_scan(spark, d):
    g = R.Geometry(12, 100, 3.0)
    sino, inside = _part_field(spark, d, g)
    h = H.Halo(spark, g, outer=4.0, nb_sectors=12, nb_coarse_bins=50)
    own = R.mass(inside, g).agg(F.avg("mass")).first()[0]
    out = H.scan_interior_mass(h, sino, inside, [0.9 * own, own, 1.2 * own])
    return spark.createDataFrame([tuple(float(v) for v in x.values()) for x in out], "interior_mass double, halo_mass double, dispersion double, nb_active double")


# ---- mesh -------------------------------------------------------------------------


def part_squares(spark, d):
    """A square per part, its side from the size."""
    p = part_disks(spark, d).select(c("disk_id").alias("cell_id"), c("cx").alias("x"), c("cy").alias("y"), c("r"))
    return p.select("cell_id", F.lit(0).alias("level"), "x", "y", (0.06 + (c("r") - 0.1) * 0.06).alias("h"))


def mesh_tiling(spark, d):
    """The tiles, with the parts whose centers they hold."""
    tiles = Q.tiling(spark, **MESH)
    sizes = [(k, MESH["cell"] * 2**k) for k in range(MESH["max_level"] + 1)]
    at = part_disks(spark, d).select("cx", "cy", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(h).alias("h")) for k, h in sizes))).alias("l"))
    held = at.groupBy(c("l.level").alias("level"), F.floor(c("cx") / c("l.h")).alias("ix"), F.floor(c("cy") / c("l.h")).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return tiles.join(held, ["level", "ix", "iy"], "left").select("level", "ix", "iy", "x", "y", "h", "interior", F.coalesce("n", F.lit(0)).alias("n"))


def mesh_trapezoid(spark, d):
    """Profiles of squares of all the parts' sizes."""
    levels = read(spark, d, "part").select(c("p_size").cast("int").alias("level"), (c("p_size") / 50.0).alias("h")).distinct()
    return _r(Q.trapezoid(MESH_G.angles(spark), levels, MESH_G), 7, "k").where("k != 0")


def mesh_scatter(spark, d):
    """Every part's share of its two nearest bins at each angle."""
    return _r(Q.scatter(part_squares(spark, d), MESH_G.angles(spark), MESH_G).drop("level"), 7, "w").where("w != 0")


def mesh_edges(spark, d):
    """Near squares among the nearest nine of each part's."""
    return _r(Q.edges(part_squares(spark, d)), 9, "dist", "face")


def alpha_scan(spark, d):
    g = R.Geometry(12, 96, 3.0)
    sino, _ = _part_field(spark, d, g)
    m = Q.GradedMesh(spark, g, outer=4.0, cell=0.25, max_level=3, nb_coarse=48)
    m.solve(sino)
    out = Q.scan_exterior_scale(m, sino, [0.8, 0.9, 1.0], lambda s: s, {"mass": lambda s: R.mass(s, m.fine).agg(F.avg("mass")).first()[0]})
    return spark.createDataFrame([(x["scale"], x["clipped"], x["mass"]) for x in out], "scale double, clipped double, mass double")


# ---- models and first steps -----------------------------------------------------------


def _part_model(spark, d, name, radius=None):
    """A table model of all parts' sinogram, and all embeddings' points."""
    return S.make_model(name, R.radon_disks(part_disks(spark, d), G.angles(spark), G), G, radius), S.with_trial(vec_points(spark, d))


def tent_cost_grad(spark, d):
    """Tents at all embeddings' first two coordinates against the sinogram of one disk."""
    sino = R.radon_disks(phantoms.disks(spark, [(0.05, -0.02, 0.5, 1.0)]), POINT_G.angles(spark), POINT_G)
    got = S.Tents(sino, POINT_G, 0.05).evaluate(S.with_trial(vec_points(spark, d)))
    return got.gradient.select("dirac_id", F.round(1e3 * c("gx"), 6).alias("gx_milli"), F.round(1e3 * c("gy"), 6).alias("gy_milli"))


def dirac_model_cost(spark, d):
    m, points = _part_model(spark, d, "diracs")
    return _r(m.evaluate(points).costs.select("cost"), 7, "cost")


def disk_model_cost(spark, d):
    m, points = _part_model(spark, d, "disks", 0.3)
    return _r(m.evaluate(points).costs.select("cost", F.lit(m.floor()).alias("floor")), 6, "cost")


def disk_model_gradient(spark, d):
    """All parts' sinogram as points, disks at all embeddings as the density: the derivative by the disks' centers."""
    m, points = _part_model(spark, d, "disks", 0.3)
    return _r(m.evaluate(points).gradient.drop("trial"), 6, "gx", "gy")


def gd_first_step(spark, d):
    m, points = _part_model(spark, d, "diracs")
    return _r(D.gradient_descent(m, points.drop("trial"), steps=1, rate=0.4).points.select("dirac_id", "x", "y"), 7, "x", "y")


def adam_first_step(spark, d):
    m, points = _part_model(spark, d, "diracs")
    return _r(D.adam(m, points.drop("trial"), steps=1, rate=0.1, eps=1e-3).points.select("dirac_id", "x", "y"), 7, "x", "y")


# ---- runs and live frames -------------------------------------------------------------


def _history(spark, d):
    return read(spark, d, "events").groupBy(c("event_type").alias("run"), (c("event_id") % 500).cast("int").alias("step")).agg(F.max("value").alias("loss"))


def loss_table(spark, d):
    return runs.loss_table(_history(spark, d).withColumn("loss", F.round("loss", 3)), ["click", "error", "purchase"])


def runs_mismatch(spark, d):
    e = read(spark, d, "events").select(c("event_type").alias("run"), (c("user_id") % 3).alias("nb_angles"), F.lit(2).alias("factor"), F.length("event_type").alias("nb_bins"))
    return runs.mismatches(e, ["nb_angles", "factor", "nb_bins"])


def _as_frames(events):
    return events.select(c("event_type").alias("sim"), (c("user_id") % 3).alias("context"), (c("user_id") % 200).alias("coordinates"), c("event_id").alias("arrival"), "value")


def _frames(spark, d):
    return _as_frames(read(spark, d, "events"))


def live_state(spark, d):
    """All events as a stream through keyed state; the rows are the state's snapshot."""
    path = f"{d}/events.parquet"
    store = Store(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    known = spark.conf.get(provider, None)
    live.use_rocksdb(spark)
    try:
        # As a pattern, the path may be one file or a folder of them.
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/event[s].parquet")
        live.state_stream(_as_frames(stream), f"{store.path}/log", f"{store.path}/checkpoint").awaitTermination()
    finally:
        spark.conf.unset(provider) if known is None else spark.conf.set(provider, known)
    return live.snapshot(spark, f"{store.path}/checkpoint").select("sim", "context", "coordinates", "arrival", "value", "place")


def live_latest(spark, d):
    return live.latest(_frames(spark, d))


def live_updates(spark, d):
    return live.updates(_frames(spark, d), 5_000)


QUERIES = {f.__name__: f for f in (halo_cells, halo_operator, halo_gram, halo_smoothness, halo_fit, alternate_run, interior_mass_scan, mesh_tiling, mesh_trapezoid, mesh_scatter, mesh_edges, alpha_scan, tent_cost_grad, dirac_model_cost, disk_model_cost, disk_model_gradient, gd_first_step, adam_first_step, loss_table, runs_mismatch, live_latest, live_state, live_updates)}


_HALO_CELLS = """rings(ring, a) AS (SELECT 0, CAST(2 AS DOUBLE) UNION ALL SELECT ring + 1, a * 1.6 FROM rings WHERE a * 1.6 < 4.999999999),
wide AS (SELECT ring, a, least(a * 1.6, 5.0) AS b, greatest(1, CAST(round_even(8 * power(4.0 / (a + least(a * 1.6, 5.0)), 2), 0) AS INTEGER)) AS n FROM rings),
cells AS (SELECT CAST(row_number() OVER (ORDER BY ring, r.range) - 1 AS INTEGER) AS cell_id, a, b, 2 * pi() * r.range / n AS phi0, 2 * pi() * (r.range + 1) / n AS phi1, ring, CAST(r.range AS INTEGER) AS sector FROM wide JOIN range(64) r ON r.range < n)"""
_HALO_HELD = f"""{_HALO_CELLS}, {DISKS}, site AS (SELECT cx * 1.8 AS x, cy * 1.8 AS y FROM disks),
polar AS (SELECT sqrt(x * x + y * y) AS r, atan2(y, x) / (2 * pi()) AS u FROM site), bands AS (SELECT ring, min(a) AS lo, max(b) AS hi, count(*) AS m FROM cells GROUP BY 1),
held AS (SELECT cell_id, count(*) AS n FROM polar JOIN bands ON r >= lo AND r < hi JOIN cells ON cells.ring = bands.ring AND sector = least(floor((CASE WHEN u < 0 THEN u + 1 ELSE u END) * m), m - 1) GROUP BY 1)"""
_THETA = "theta(angle_id, theta) AS (VALUES " + ", ".join(f"({k}, {k * math.pi / HALO_G.nb_angles!r}::DOUBLE)" for k in range(HALO_G.nb_angles)) + ")"
_g = HALO_G
_HALO_OP = f"""WITH RECURSIVE {_HALO_HELD}, {_THETA},
nn AS (SELECT *, CAST(least(greatest(ceil(4.0 * b * (phi1 - phi0) / {_g.dw!r}), 8), 32768) AS INTEGER) AS n FROM cells),
nodes AS (SELECT cell_id, a, b, (phi1 - phi0) / n AS dphi, phi0 + (r.range + 0.5) * (phi1 - phi0) / n AS phi FROM nn, range(4096) r WHERE r.range < n),
k0 AS (SELECT *, cos(theta - phi) AS cs FROM nodes, theta),
k1 AS (SELECT cell_id, angle_id, a, b, dphi, CASE WHEN cs < 0 THEN -1.0 ELSE 1.0 END AS sg, greatest(abs(cs), 1e-3 * {_g.dw!r} / greatest(b - a, 1e-12)) AS ca FROM k0),
k2 AS (SELECT cell_id, angle_id, sg * dphi / (2 * ca * ca) AS beta, least(sg * a * ca, sg * b * ca) AS lo, greatest(sg * a * ca, sg * b * ca) AS hi FROM k1),
ed AS (SELECT r.range AS e, {_g.s_min!r} + r.range * {_g.dw!r} AS x FROM range({_g.nb_bins + 1}) r),
cum AS (SELECT cell_id, angle_id, e, sum(CASE WHEN x >= hi THEN beta * (hi * hi - lo * lo) WHEN x >= lo THEN beta * (x * x - lo * lo) ELSE 0 END) AS f FROM k2, ed GROUP BY 1, 2, 3),
op AS (SELECT cell_id, angle_id, CAST(e AS INTEGER) AS bin_id, (lead(f) OVER (PARTITION BY cell_id, angle_id ORDER BY e) - f) / {_g.dw!r} AS val FROM cum)"""
_m = MESH_G
_TILES = """WITH fine AS (SELECT x.range - 12 AS ix, y.range - 12 AS iy FROM range(24) x, range(24) y),
rad AS (SELECT *, sqrt((ix + 0.5) * 0.5 * ((ix + 0.5) * 0.5) + (iy + 0.5) * 0.5 * ((iy + 0.5) * 0.5)) AS r FROM fine),
free AS (SELECT ix, iy, least(greatest(floor(log2(greatest(r / 2.0, 1.0))), 0), 2) AS target FROM rad WHERE r < 6.0),
b2 AS (SELECT floor(ix / 4.0) AS bx, floor(iy / 4.0) AS bd FROM free GROUP BY 1, 2 HAVING count(*) = 16 AND min(target) >= 2),
f1 AS (SELECT * FROM free ANTI JOIN b2 ON floor(ix / 4.0) = bx AND floor(iy / 4.0) = bd),
b1 AS (SELECT floor(ix / 2.0) AS bx, floor(iy / 2.0) AS bd FROM f1 GROUP BY 1, 2 HAVING count(*) = 4 AND min(target) >= 1),
f0 AS (SELECT * FROM f1 ANTI JOIN b1 ON floor(ix / 2.0) = bx AND floor(iy / 2.0) = bd),
tile0 AS (SELECT 2 AS level, bx AS ix, bd AS iy, 2.0::DOUBLE AS h FROM b2 UNION ALL SELECT 1, bx, bd, 1.0 FROM b1 UNION ALL SELECT 0, ix, iy, 0.5 FROM f0),
tiles AS (SELECT level, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, (ix + 0.5) * h AS x, (iy + 0.5) * h AS y, h FROM tile0)"""
_below = lambda t: f"(CASE WHEN {t} <= -(u + v) / 2 THEN 0 WHEN {t} < -(u - v) / 2 THEN h * h / u / v * ({t} + (u + v) / 2) * ({t} + (u + v) / 2) / 2 WHEN {t} <= (u - v) / 2 THEN h * h / u * (v / 2 + {t} + (u - v) / 2) WHEN {t} < (u + v) / 2 THEN h * h - h * h / u / v * ((u + v) / 2 - {t}) * ((u + v) / 2 - {t}) / 2 ELSE h * h END)"
def _kernel(levels: str) -> str:
    """CTEs lv and kern of a table (level, h)."""
    return f"""lv AS (SELECT angle_id, level, h, greatest(h * abs(nx), h * abs(ny)) AS u, least(h * abs(nx), h * abs(ny)) AS v FROM angles, {levels}),
kern AS (SELECT angle_id, level, CAST(o.range - 40 AS INTEGER) AS "offset", ({_below(f'(o.range - 40 + 0.5) * {_m.dw!r}')} - {_below(f'(o.range - 40 - 0.5) * {_m.dw!r}')}) / {_m.dw!r} AS k FROM lv, range(81) o)"""


_OPS = f"""{_TILES}, {angles_sql(_m)},
{_kernel("(SELECT DISTINCT level, h FROM tiles)")},
pr AS (SELECT angle_id, level, ix, iy, (x * nx + y * ny - {_m.s_min!r}) / {_m.dw!r} - 0.5 AS q FROM tiles, angles),
sc AS (SELECT angle_id, level, ix, iy, CAST(floor(q) AS INTEGER) AS bin_id, 1 - (q - floor(q)) AS w FROM pr UNION ALL SELECT angle_id, level, ix, iy, CAST(floor(q) AS INTEGER) + 1, q - floor(q) FROM pr),
op AS (SELECT sc.level, ix, iy, sc.angle_id, sc.bin_id + "offset" AS bin_id, sum(w * k) AS val FROM sc JOIN kern ON sc.angle_id = kern.angle_id AND sc.level = kern.level WHERE sc.bin_id + "offset" BETWEEN 0 AND {_m.nb_bins - 1} GROUP BY 1, 2, 3, 4, 5)"""
_PIECES = f"""dn AS (SELECT angle_id, id, pos, w, coalesce(sum(w) OVER (PARTITION BY angle_id ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM d),
tn AS (SELECT angle_id, x0, m, coalesce(sum(m) OVER (PARTITION BY angle_id ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0 FROM t WHERE m > 0),
ov AS (SELECT dn.*, x0, m, c0, greatest(q0, c0) AS a, least(q0 + w, c0 + m) AS b FROM dn JOIN tn ON dn.angle_id = tn.angle_id AND q0 < c0 + m AND c0 < q0 + w),
pieces AS (SELECT *, b - a AS dm, x0 + (a - c0) / m * {G.dw!r} AS l, x0 + (b - c0) / m * {G.dw!r} AS r FROM ov WHERE b - a > 1e-14)"""
_SHARE = "share AS (SELECT angle_id, bin_id, lo AS x0, value / sum(value) OVER (PARTITION BY angle_id) AS m FROM sino JOIN bins USING (bin_id))"
_DIRAC_MODEL = f"""{SINO}, {POINTS}, {_SHARE}, t AS (SELECT * FROM share),
d AS (SELECT angle_id, dirac_id AS id, x * nx + y * ny AS pos, 1.0 / (SELECT count(*) FROM pts) AS w FROM pts, angles), {_PIECES}"""
_COST = "sum(dm * ((l - pos) * (l - pos) + (l - pos) * (r - pos) + (r - pos) * (r - pos)) / 3)"
_GRAD = f"""{_DIRAC_MODEL}, g AS (SELECT angle_id, id, 2 * any_value(w) * (any_value(pos) - sum(dm * (l + r) / 2) / sum(dm)) AS g FROM pieces GROUP BY 1, 2),
s AS (SELECT id AS dirac_id, sum(g * nx) AS gx, sum(g * ny) AS gy FROM g JOIN angles USING (angle_id) GROUP BY 1)"""
_under = lambda t: f"(least(greatest({t}, -0.3), 0.3) * sqrt(greatest(0.09 - least(greatest({t}, -0.3), 0.3) * least(greatest({t}, -0.3), 0.3), 0)) + 0.09 * asin(least(greatest({t}, -0.3), 0.3) / 0.3))"
_DISK_MODEL = f"""{SINO}, {POINTS}, {_SHARE}, spot AS (SELECT angle_id, x * nx + y * ny AS s0 FROM pts, angles),
made AS (SELECT angle_id, bin_id, lo AS x0, sum({_under('(hi - s0)')} - {_under('(lo - s0)')}) AS v FROM spot, bins GROUP BY 1, 2, 3),
t AS (SELECT angle_id, x0, v / sum(v) OVER (PARTITION BY angle_id) AS m FROM made WHERE v > 1e-13),
d AS (SELECT angle_id, bin_id AS id, x0 + {G.dw!r} / 2 AS pos, m AS w FROM share WHERE m > 0), {_PIECES}"""
_chord = lambda t: f"2 * sqrt(greatest(0.09 - ({t}) * ({t}), 0))"
_DISK_GRAD = f"""{_DISK_MODEL},
ends AS (SELECT angle_id, id, any_value(pos) AS pos, max(r) AS e FROM pieces GROUP BY 1, 2),
jumps AS (SELECT *, (e - pos) * (e - pos) - (e - lead(pos) OVER o) * (e - lead(pos) OVER o) AS jump FROM ends WINDOW o AS (PARTITION BY angle_id ORDER BY pos)),
fall AS (SELECT angle_id, id, coalesce(sum(jump) OVER (PARTITION BY angle_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fallen FROM jumps),
cell AS (SELECT p.angle_id, x0, any_value(m) AS m, sum((r - l) * (((l - pos) * (l - pos) + (l - pos) * (r - pos) + (r - pos) * (r - pos)) / 3 + fallen)) AS g FROM pieces p JOIN fall USING (angle_id, id) GROUP BY 1, 2),
whole AS (SELECT angle_id, sum(v) AS mass FROM made WHERE v > 1e-13 GROUP BY 1), middle AS (SELECT angle_id, sum(g * m) / {G.dw!r} AS mean FROM cell GROUP BY 1),
gd AS (SELECT angle_id, x0, (g - {G.dw!r} * mean) / mass AS gd FROM cell JOIN whole USING (angle_id) JOIN middle USING (angle_id)),
sg AS (SELECT dirac_id, nx, ny, gd * ({_chord('x0 - x * nx - y * ny')} - {_chord(f'x0 + {G.dw!r} - x * nx - y * ny')}) / {G.dw!r} AS v FROM pts JOIN gd ON true JOIN angles USING (angle_id))"""
_p = POINT_G
_half = lambda t: f"(least(greatest({t}, -0.5), 0.5) * sqrt(greatest(0.25 - least(greatest({t}, -0.5), 0.5) * least(greatest({t}, -0.5), 0.5), 0)) + 0.25 * asin(least(greatest({t}, -0.5), 0.5) / 0.5))"
_TENT = f"""WITH {POINTS}, {angles_sql(_p)}, n AS (SELECT count(*) * 0.05 AS whole FROM pts),
sino AS (SELECT angle_id, CAST(r.range AS INTEGER) AS bin_id, {_half(f'({_p.s_min!r} + (r.range + 1) * {_p.dw!r} - 0.05 * nx + 0.02 * ny)')} - {_half(f'({_p.s_min!r} + r.range * {_p.dw!r} - 0.05 * nx + 0.02 * ny)')} AS m FROM angles, range({_p.nb_bins}) r),
lv AS (SELECT angle_id, bin_id, whole * sum(m) OVER (PARTITION BY angle_id ORDER BY bin_id) / sum(m) OVER (PARTITION BY angle_id) AS lev FROM sino, n),
knot AS (SELECT angle_id, dirac_id, k.range - 1 AS side, x * nx + y * ny + (k.range - 1) * 0.05 AS z, CASE WHEN k.range = 1 THEN -40.0::DOUBLE ELSE 20.0 END AS jump FROM pts, angles, range(3) k),
k1 AS (SELECT *, sum(jump) OVER o AS slope, lead(z) OVER o - z AS gap FROM knot WINDOW o AS (PARTITION BY angle_id ORDER BY z, dirac_id, side)),
k2 AS (SELECT *, coalesce(sum(slope * gap) OVER o, 0) AS height FROM k1 WINDOW o AS (PARTITION BY angle_id ORDER BY z, dirac_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k3 AS (SELECT *, coalesce(sum(height * gap + slope * gap * gap / 2) OVER o, 0) AS before FROM k2 WINDOW o AS (PARTITION BY angle_id ORDER BY z, dirac_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
at0 AS (SELECT lv.angle_id, bin_id, lev, z, height, slope, gap, before FROM lv ASOF JOIN (SELECT * FROM k3 WHERE gap > 0) k ON lv.angle_id = k.angle_id AND lv.lev >= k.before WHERE bin_id < {_p.nb_bins - 1}),
cut AS (SELECT angle_id, dirac_id, side, z, 0 AS step FROM knot
  UNION ALL SELECT angle_id, NULL, NULL, z + least(gap, coalesce(2 * (lev - before) / nullif(height + sqrt(greatest(height * height + 2 * slope * (lev - before), 0)), 0), 0)), 1 FROM at0),
c1 AS (SELECT *, lead(z) OVER o AS v, {_p.s_min!r} + (sum(step) OVER (PARTITION BY angle_id ORDER BY z, step, dirac_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 0.5) * {_p.dw!r} AS center FROM cut WINDOW o AS (PARTITION BY angle_id ORDER BY z, step, dirac_id, side)),
c2 AS (SELECT *, z - center AS p, v - center AS q FROM c1),
c3 AS (SELECT *, coalesce(sum(q * q - p * p) OVER (PARTITION BY angle_id ORDER BY z, step, dirac_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c2),
c4 AS (SELECT *, coalesce(sum((first - p * p) * (v - z) + (q * q * q - p * p * p) / 3) OVER (PARTITION BY angle_id ORDER BY z, step, dirac_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS second FROM c3),
g AS (SELECT dirac_id, angle_id, sum(CASE WHEN side = 0 THEN -2 ELSE 1 END * second) / 0.05 / any_value(whole) AS g FROM c4, n WHERE dirac_id IS NOT NULL GROUP BY 1, 2)"""
_FRAMES = "f AS (SELECT event_type AS sim, user_id % 3 AS context, user_id % 200 AS coordinates, event_id AS arrival, value FROM events), k AS (SELECT *, row_number() OVER w AS n, min(arrival) OVER (PARTITION BY sim, context, coordinates) AS place FROM f WINDOW w AS (PARTITION BY sim, context, coordinates ORDER BY arrival DESC, value DESC))"
ORACLE = {
    "halo_cells": f"WITH RECURSIVE {_HALO_HELD} SELECT cell_id, round(a, 9) AS a, round(b, 9) AS b, round(phi0, 9) AS phi0, round(phi1, 9) AS phi1, ring, sector, coalesce(n, 0) AS n FROM cells LEFT JOIN held USING (cell_id)",
    "halo_operator": f"{_HALO_OP} SELECT cell_id, angle_id, bin_id, round(val * n, 4) AS val FROM op JOIN held USING (cell_id) WHERE bin_id < {_g.nb_bins} AND round(val * n, 4) != 0",
    "halo_gram": f"{_HALO_OP}, w AS (SELECT cell_id, angle_id, bin_id, val * n / 100 AS val FROM op JOIN held USING (cell_id) WHERE bin_id < {_g.nb_bins}) SELECT p.cell_id AS i, q.cell_id AS j, round(sum(p.val * q.val), 4) AS v FROM w p JOIN w q ON p.angle_id = q.angle_id AND p.bin_id = q.bin_id GROUP BY 1, 2 HAVING round(sum(p.val * q.val), 4) != 0",
    "halo_smoothness": f"WITH RECURSIVE {_HALO_HELD}, ring_next AS (SELECT cell_id, coalesce(lead(cell_id) OVER (PARTITION BY ring ORDER BY sector), min(cell_id) OVER (PARTITION BY ring)) AS nxt FROM cells) SELECT p.cell_id AS row, coalesce(b.n, 0) - coalesce(a.n, 0) AS difference FROM ring_next p LEFT JOIN held a ON a.cell_id = p.cell_id LEFT JOIN held b ON b.cell_id = nxt WHERE p.cell_id != nxt",
    "mesh_tiling": f"{_TILES}, {DISKS} SELECT level, ix, iy, x, y, h, sqrt(x * x + y * y) < 2.0 AS interior, count(cx) AS n FROM tiles LEFT JOIN disks ON floor(cx / h) = ix AND floor(cy / h) = iy GROUP BY 1, 2, 3, 4, 5, 6, 7",
    "mesh_trapezoid": f'WITH {angles_sql(_m)}, {_kernel("(SELECT DISTINCT CAST(p_size AS INTEGER) AS level, p_size / 50.0::DOUBLE AS h FROM part)")} SELECT angle_id, level, "offset", round(k, 7) AS k FROM kern WHERE round(k, 7) != 0',
    "mesh_scatter": f"WITH {angles_sql(_m)}, {DISKS}, pr AS (SELECT angle_id, disk_id AS cell_id, (cx * nx + cy * ny - {_m.s_min!r}) / {_m.dw!r} - 0.5 AS q FROM disks, angles), sc AS (SELECT angle_id, cell_id, CAST(floor(q) AS INTEGER) AS bin_id, 1 - (q - floor(q)) AS w FROM pr UNION ALL SELECT angle_id, cell_id, CAST(floor(q) AS INTEGER) + 1, q - floor(q) FROM pr) SELECT angle_id, cell_id, bin_id, round(w, 7) AS w FROM sc WHERE round(w, 7) != 0",
    "mesh_edges": f"WITH {DISKS}, id AS (SELECT disk_id AS i, cx AS x, cy AS y, 0.06 + (r - 0.1) * 0.06 AS h FROM disks), d AS (SELECT p.i, q.i AS j, p.h AS hi, q.h AS hj, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM id p, id q WHERE abs(p.x - q.x) < 0.2 AND abs(p.y - q.y) < 0.2), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS n FROM d) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, round(least(hi, hj), 9) AS face, round(dist, 9) AS dist FROM k WHERE n <= 9 AND i != j AND dist < 0.75 * (hi + hj)",
    "tent_cost_grad": f"{_TENT} SELECT dirac_id, round(sum(g * nx) * 1e3, 6) AS gx_milli, round(sum(g * ny) * 1e3, 6) AS gy_milli FROM g JOIN angles USING (angle_id) GROUP BY 1",
    "dirac_model_cost": f"{_DIRAC_MODEL} SELECT round({_COST}, 7) AS cost FROM pieces",
    "disk_model_cost": f"{_DISK_MODEL} SELECT round({_COST}, 6) AS cost, {G.nb_angles * G.dw**2 / 12!r}::DOUBLE AS floor FROM pieces",
    "disk_model_gradient": f"{_DISK_GRAD} SELECT dirac_id, round(sum(v * nx), 6) AS gx, round(sum(v * ny), 6) AS gy FROM sg GROUP BY 1",
    "gd_first_step": f"{_GRAD} SELECT dirac_id, round(x - 0.4 * gx * (SELECT count(*) FROM pts) / {G.nb_angles}, 7) AS x, round(y - 0.4 * gy * (SELECT count(*) FROM pts) / {G.nb_angles}, 7) AS y FROM pts JOIN s USING (dirac_id)",
    "adam_first_step": f"{_GRAD} SELECT dirac_id, round(x - 0.1 * gx / (abs(gx) + 1e-3), 7) AS x, round(y - 0.1 * gy / (abs(gy) + 1e-3), 7) AS y FROM pts JOIN s USING (dirac_id)",
    "loss_table": "WITH h AS (SELECT event_type AS run, CAST(event_id % 500 AS INTEGER) AS step, round(max(value), 3) AS loss FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1, 2) SELECT step, coalesce(max(CASE WHEN run = 'click' THEN printf('%.6f', loss) END), '-') AS click, coalesce(max(CASE WHEN run = 'error' THEN printf('%.6f', loss) END), '-') AS error, coalesce(max(CASE WHEN run = 'purchase' THEN printf('%.6f', loss) END), '-') AS purchase FROM h GROUP BY 1",
    "runs_mismatch": "WITH s AS (SELECT 'nb_angles' AS setting, count(DISTINCT user_id % 3) AS nb_values FROM events UNION ALL SELECT 'factor', count(DISTINCT 2) FROM events UNION ALL SELECT 'nb_bins', count(DISTINCT length(event_type)) FROM events) SELECT * FROM s WHERE nb_values > 1",
    "live_latest": f"WITH {_FRAMES} SELECT sim, context, coordinates, arrival, value, place FROM k WHERE n = 1",
    "live_state": f"WITH {_FRAMES} SELECT sim, context, coordinates, arrival, value, place FROM k WHERE n = 1",
    "live_updates": f"WITH {_FRAMES} SELECT sim, context, coordinates, arrival, value, place FROM k WHERE n = 1 AND arrival > 5000",
}
