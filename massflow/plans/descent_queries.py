"""Steps of the table optimizers: points from all embeddings, the sinogram of all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from massflow.operators import descent as D
from massflow.operators import radon as R
from massflow.operators import sliced as S
from massflow.plans.radon_queries import G, POINTS, SINO, _r, part_disks, vec_points

c = F.col
STEPS = 3


def _model(spark, d):
    return S.Diracs(R.radon_disks(part_disks(spark, d), G.angles(spark), G), G)


def lbfgs_points(spark, d):
    """All embeddings' points after three L-BFGS steps, from tables to tables."""
    run = D.lbfgs(_model(spark, d), vec_points(spark, d), steps=STEPS, ftol=0.0)
    return _r(run.points, 6, "x", "y")


def newton_points(spark, d):
    """All embeddings' points after two Newton steps: along the gradient, then on the gradient and the first step."""
    run = D.subspace_newton(_model(spark, d), vec_points(spark, d), steps=2, ftol=0.0)
    return _r(run.points, 6, "x", "y")


def line_search_round(spark, d):
    """One round of nine trial steps along -gradient, with the bracket's vertex."""
    m, points = _model(spark, d), vec_points(spark, d)
    e = m.evaluate(S.with_trial(points))
    state = points.select("dirac_id", "x", "y").join(e.gradient, "dirac_id")
    table, _ = D.trial_table(m, state, -c("gx"), -c("gy"), [0.25 * 2.0**j for j in range(-4, 5)])
    return _r(table.join(F.broadcast(D.bracketed(table).select("vertex")), F.lit(True)).select("trial", "t", "cost", "vertex"), 6, "cost", "vertex")


def _history(spark, run):
    return _r(spark.createDataFrame([(h["step"], float(h["cost"])) for h in run.history], "step int, cost double"), 5, "cost")


def lbfgs_run(spark, d):
    return _history(spark, D.lbfgs(_model(spark, d), vec_points(spark, d), steps=STEPS, ftol=0.0))


def subspace_newton_run(spark, d):
    return _history(spark, D.subspace_newton(_model(spark, d), vec_points(spark, d), steps=2, ftol=0.0))


def gd_steps(spark, d):
    return _history(spark, D.gradient_descent(_model(spark, d), vec_points(spark, d), steps=STEPS, rate=0.4))


def adam_steps(spark, d):
    return _history(spark, D.adam(_model(spark, d), vec_points(spark, d), steps=STEPS, rate=0.1, eps=1e-3))


def line_search_gd_run(spark, d):
    return _history(spark, D.conjugate(_model(spark, d), vec_points(spark, d), steps=1, method="gd"))


def line_search_run(spark, d):
    """Two bracketed searches along Polak-Ribiere directions."""
    return _history(spark, D.conjugate(_model(spark, d), vec_points(spark, d), steps=2))


def disk_run(spark, d):
    """Disks at all embeddings towards the parts' sinogram."""
    m = S.Disks(R.radon_disks(part_disks(spark, d), G.angles(spark), G), G, 0.3)
    return _history(spark, D.lbfgs(m, vec_points(spark, d), steps=2, ftol=0.0))


def _scales(spark, d, factor, **how):
    points = vec_points(spark, d)
    run = D.multiscale(R.radon_disks(part_disks(spark, d), G.angles(spark), G), G, points, factor * points.count(), factor, **how)
    return _r(spark.createDataFrame([(h["scale"], h["stage"], h["n"], h["step"], float(h["cost"])) for h in run.history], "scale int, stage string, n long, step int, cost double"), 5, "cost")


def multiscale_run(spark, d):
    """All embeddings' points, then two for each."""
    return _scales(spark, d, 2, steps=1)


def interleaved_run(spark, d):
    """All embeddings' points, then four for each: at either scale 20 steps on diracs and 10 on tents, the reference's own numbers."""
    return _scales(spark, d, 4, steps=20, tents=True, tent_steps=10)


def grid_search_run(spark, d):
    """Costs on a 5 x 5 grid along -gradient and towards the center."""
    m, points = _model(spark, d), vec_points(spark, d)
    state = points.select("dirac_id", "x", "y").join(m.evaluate(S.with_trial(points)).gradient, "dirac_id")
    return _r(D.grid_round(m, state, [(-c("gx"), -c("gy")), (-c("x"), -c("y"))], [(0.0, 8.0), (-1.0, 1.0)]), 5, "cost")


def optimizer_comparison(spark, d):
    m, points = _model(spark, d), vec_points(spark, d)
    runs = {"gd": D.gradient_descent(m, points, steps=2, rate=0.4), "adam": D.adam(m, points, steps=2, eps=1e-3), "lbfgs": D.lbfgs(m, points, steps=2, ftol=0.0)}
    rows = [(name, h["step"], float(h["cost"])) for name, run in runs.items() for h in run.history]
    return _r(spark.createDataFrame(rows, "run string, step int, cost double"), 5, "cost")


QUERIES = {f.__name__: f for f in (lbfgs_points, newton_points, line_search_round, lbfgs_run, subspace_newton_run, gd_steps, adam_steps, line_search_gd_run, line_search_run, disk_run, multiscale_run, interleaved_run, grid_search_run, optimizer_comparison)}

# ---- the same in SQL -------------------------------------------------------------------

_BASE = f"""{SINO}, {POINTS}, nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pts),
share AS (SELECT angle_id, lo AS x0, value / sum(value) OVER (PARTITION BY angle_id) AS m FROM sino JOIN bins USING (bin_id)),
tn AS (SELECT angle_id, x0, m, coalesce(sum(m) OVER (PARTITION BY angle_id ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0 FROM share WHERE m > 0),
at_zero AS (SELECT 0 AS trial, dirac_id, x, y FROM pts)"""


def _evaluated(k: str, points: str, nn: str = "nn") -> str:
    """v{k}(trial, cost) and g{k}(trial, dirac_id, gx, gy) of a table (trial, dirac_id, x, y) of as many points as nn says."""
    a, b = "greatest(q0, c0)", "least(q0 + w, c0 + m)"
    return f"""d{k} AS (SELECT trial, angle_id, nx, ny, dirac_id, x * nx + y * ny AS pos, (row_number() OVER (PARTITION BY trial, angle_id ORDER BY x * nx + y * ny, dirac_id) - 1) / n AS q0, 1 / n AS w FROM {points}, angles, {nn}),
o{k} AS (SELECT d.*, {b} - {a} AS dm, x0 + ({a} - c0) / m * {G.dw!r} AS l, x0 + ({b} - c0) / m * {G.dw!r} AS r FROM d{k} d JOIN tn ON d.angle_id = tn.angle_id AND q0 < c0 + m AND c0 < q0 + w WHERE {b} - {a} > 1e-14),
v{k} AS (SELECT trial, sum(dm * ((l - pos) * (l - pos) + (l - pos) * (r - pos) + (r - pos) * (r - pos)) / 3) AS cost FROM o{k} GROUP BY 1),
h{k} AS (SELECT trial, angle_id, dirac_id, any_value(nx) AS nx, any_value(ny) AS ny, 2 * any_value(w) * (any_value(pos) - sum(dm * (l + r) / 2) / sum(dm)) AS g FROM o{k} GROUP BY 1, 2, 3),
g{k} AS (SELECT trial, dirac_id, sum(g * nx) AS gx, sum(g * ny) AS gy FROM h{k} GROUP BY 1, 2)"""


def _searched(k: int, kept: str, nn: str = "nn") -> str:
    """From dir{k}(.., dx, dy) to w{k+1}: the first of four halvings that lowers the cost enough; kept: older columns."""
    return f"""ts{k}(trial, t) AS (VALUES (0, 1.0::DOUBLE), (1, 0.5), (2, 0.25), (3, 0.125)),
tr{k} AS (SELECT trial, dirac_id, x + t * dx AS x, y + t * dy AS y FROM dir{k}, ts{k}), {_evaluated(f't{k}', f'tr{k}', nn)},
ac{k} AS (SELECT arg_min({{'trial': trial, 't': t, 'cost': vt{k}.cost}}, trial) AS a FROM vt{k} JOIN ts{k} USING (trial), c{k} WHERE vt{k}.cost <= c{k}.cost + 1e-4 * t * (SELECT sum(gx * dx + gy * dy) FROM dir{k})),
c{k + 1} AS (SELECT a.cost AS cost FROM ac{k}),
w{k + 1} AS (SELECT dirac_id, x + a.t * dx AS x, y + a.t * dy AS y, gt{k}.gx AS gx, gt{k}.gy AS gy, {kept}a.t * dx AS s{k}x, a.t * dy AS s{k}y, gt{k}.gx - o.gx AS y{k}x, gt{k}.gy - o.gy AS y{k}y FROM dir{k} o JOIN gt{k} USING (dirac_id), ac{k} WHERE gt{k}.trial = a.trial)"""


def _start() -> str:
    return f"{_BASE}, {_evaluated('s', 'at_zero')}, c0 AS (SELECT cost FROM vs), w0 AS (SELECT dirac_id, x, y, gx, gy FROM pts JOIN gs USING (dirac_id))"


def _dot(a: str, b: str) -> str:
    return f"sum({a}x * {b}x + {a}y * {b}y)"


def _lbfgs_sql() -> str:
    ctes = [_start()]
    for k in range(STEPS):
        now = f"(SELECT *, gx AS qx, gy AS qy FROM w{k})"
        for j in reversed(range(k)):
            ctes.append(f"a{k}_{j} AS (SELECT {_dot(f's{j}', 'q')} / {_dot(f's{j}', f'y{j}')} AS a FROM {now})")
            ctes.append(f"q{k}_{j} AS (SELECT p.* REPLACE (qx - a * y{j}x AS qx, qy - a * y{j}y AS qy) FROM {now} p, a{k}_{j})")
            now = f"q{k}_{j}"
        if k:
            ctes.append(f"z{k} AS (SELECT p.* REPLACE (qx * f AS qx, qy * f AS qy) FROM {now} p, (SELECT {_dot(f's{k - 1}', f'y{k - 1}')} / {_dot(f'y{k - 1}', f'y{k - 1}')} AS f FROM w{k}))")
            now = f"z{k}"
        for j in range(k):
            ctes.append(f"b{k}_{j} AS (SELECT {_dot(f'y{j}', 'q')} / {_dot(f's{j}', f'y{j}')} AS b FROM {now})")
            ctes.append(f"u{k}_{j} AS (SELECT p.* REPLACE (qx + (a - b) * s{j}x AS qx, qy + (a - b) * s{j}y AS qy) FROM {now} p, a{k}_{j}, b{k}_{j})")
            now = f"u{k}_{j}"
        scale = "1" if k else f"n / {G.nb_angles}"
        ctes.append(f"dir{k} AS (SELECT p.* EXCLUDE (qx, qy), -{scale} * qx AS dx, -{scale} * qy AS dy FROM {now} p, nn)")
        ctes.append(_searched(k, "".join(f"s{j}x, s{j}y, y{j}x, y{j}y, " for j in range(k))))
    return f"{', '.join(ctes)} SELECT dirac_id, round(x, 6) AS x, round(y, 6) AS y FROM w{STEPS}"


def _newton_sql() -> str:
    def h(a: str, b: str) -> str:
        return f"sum(2 / n * (cxx * {a}x * {b}x + cxy * ({a}x * {b}y + {a}y * {b}x) + cyy * {a}y * {b}y))"

    normal = "cc AS (SELECT sum(nx * nx) AS cxx, sum(nx * ny) AS cxy, sum(ny * ny) AS cyy FROM angles)"
    first = f"dir0 AS (SELECT w0.*, -k.b / k.h * gx AS dx, -k.b / k.h * gy AS dy FROM w0, (SELECT {_dot('g', 'g')} AS b, {h('g', 'g')} * (1 + 1e-6) AS h FROM w0, cc, nn) k)"
    scalars = f"""k1 AS (SELECT sqrt({_dot('g', 'g')}) AS lg, sqrt({_dot('s0', 's0')}) AS ls, {h('g', 'g')} AS gg, {h('g', 's0')} AS gs, {h('s0', 's0')} AS ss, {_dot('g', 'g')} AS bg, {_dot('g', 's0')} AS bs FROM w1, cc, nn),
m1 AS (SELECT lg, ls, gg / lg / lg AS a, gs / lg / ls AS b, ss / ls / ls AS d, bg / lg AS p, bs / ls AS q FROM k1),
e1 AS (SELECT lg, ls, a + 1e-6 * (a + d) / 2 AS a, b, d + 1e-6 * (a + d) / 2 AS d, p, q FROM m1),
dir1 AS (SELECT w1.* EXCLUDE (y0x, y0y), f * gx + h * s0x AS dx, f * gy + h * s0y AS dy FROM w1, (SELECT -(d * p - b * q) / (a * d - b * b) / lg AS f, -(a * q - b * p) / (a * d - b * b) / ls AS h FROM e1))"""
    return f"{_start()}, {normal}, {first}, {_searched(0, '')}, {scalars}, {_searched(1, '')} SELECT dirac_id, round(x, 6) AS x, round(y, 6) AS y FROM w2"


def _round_sql() -> str:
    steps = ", ".join(f"({j}, {0.25 * 2.0 ** (j - 4)!r}::DOUBLE)" for j in range(9))
    near = "near AS (SELECT trial, t, cost, t - lag(t) OVER o AS l, lead(t) OVER o - t AS r, (lag(cost) OVER o - cost) / (t - lag(t) OVER o) AS up, (lead(cost) OVER o - cost) / (lead(t) OVER o - t) AS down FROM v_r JOIN ts USING (trial) WINDOW o AS (ORDER BY t))"
    best = "best AS (SELECT coalesce(CASE WHEN up + down > 0 THEN t + least(greatest((up * r - down * l) / (2 * (up + down)), -l), r) END, t) AS vertex FROM near ORDER BY cost, t LIMIT 1)"
    return f"{_start()}, ts(trial, t) AS (VALUES {steps}), tr AS (SELECT trial, dirac_id, x - t * gx AS x, y - t * gy AS y FROM w0, ts), {_evaluated('_r', 'tr')}, {near}, {best} SELECT trial, t, round(cost, 6) AS cost, round(vertex, 6) AS vertex FROM near, best"


def _fixed_steps_sql(n: int, adam: bool) -> list[str]:
    """w0 .. wn and c0 .. c(n - 1): steps of descent or of Adam, and the cost before each."""
    ctes = [_start().replace(", w0 AS (SELECT dirac_id, x, y, gx, gy FROM", ", w0 AS (SELECT dirac_id, x, y, gx, gy, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM")]
    for k in range(n - 1):
        if adam:
            m, v = (lambda a: f"(0.9 * m{a} + 0.1 * g{a})"), (lambda a: f"(0.999 * v{a} + (1 - 0.999) * g{a} * g{a})")
            moved = ", ".join(f"{a} - 0.1 * ({m(a)} / {1 - 0.9 ** (k + 1)!r}) / (sqrt({v(a)} / {1 - 0.999 ** (k + 1)!r}) + 1e-3) AS {a}" for a in "xy")
            moved += "".join(f", {m(a)} AS m{a}, {v(a)} AS v{a}" for a in "xy")
        else:
            moved = f"x - 0.4 * n / {G.nb_angles} * gx AS x, y - 0.4 * n / {G.nb_angles} * gy AS y, mx, my, vx, vy"
        ctes.append(f"n{k} AS (SELECT 0 AS trial, dirac_id, {moved} FROM w{k}, nn), {_evaluated(f'f{k}', f'n{k}')}, c{k + 1} AS (SELECT cost FROM vf{k})")
        ctes.append(f"w{k + 1} AS (SELECT dirac_id, x, y, gx, gy, mx, my, vx, vy FROM n{k} JOIN gf{k} USING (dirac_id))")
    return ctes


def _costs(ctes: str, n: int, run: str = "") -> str:
    named = f"'{run}' AS run, " if run else ""
    return f"{ctes} " + " UNION ALL ".join(f"SELECT {named}{k} AS step, round(cost, 5) AS cost FROM c{k}" for k in range(n))


def _bracketed_ctes(k: int) -> str:
    """From dir{k}(.., dx, dy) and a{k}(a) to c{k + 1}, a{k + 1} and w{k + 1}: a round of nine trials, then the vertex and the best one."""
    return f"""ts{k} AS (SELECT r.range AS trial, a * power(2.0, r.range - 4) AS t FROM a{k}, range(9) r), tr{k} AS (SELECT trial, dirac_id, x + t * dx AS x, y + t * dy AS y FROM dir{k}, ts{k}), {_evaluated(f'r{k}', f'tr{k}')},
near{k} AS (SELECT trial, t, cost, t - lag(t) OVER o AS l, lead(t) OVER o - t AS r, (lag(cost) OVER o - cost) / (t - lag(t) OVER o) AS up, (lead(cost) OVER o - cost) / (lead(t) OVER o - t) AS down FROM vr{k} JOIN ts{k} USING (trial) WINDOW o AS (ORDER BY t)),
best{k} AS (SELECT t, coalesce(CASE WHEN up + down > 0 THEN t + least(greatest((up * r - down * l) / (2 * (up + down)), -l), r) END, t) AS vertex FROM near{k} ORDER BY cost, t LIMIT 1),
te{k} AS (SELECT k.range AS trial, CASE k.range WHEN 0 THEN t ELSE vertex END AS t FROM best{k}, range(2) k), en{k} AS (SELECT trial, dirac_id, x + t * dx AS x, y + t * dy AS y FROM dir{k}, te{k}), {_evaluated(f'e{k}', f'en{k}')},
pick{k} AS (SELECT trial, t, cost FROM ve{k} JOIN te{k} USING (trial) ORDER BY cost, t LIMIT 1), c{k + 1} AS (SELECT cost FROM pick{k}), a{k + 1} AS (SELECT t AS a FROM pick{k}),
w{k + 1} AS (SELECT dirac_id, o.x + t * dx AS x, o.y + t * dy AS y, ge{k}.gx AS gx, ge{k}.gy AS gy, o.gx AS px, o.gy AS py, dx AS ox, dy AS oy FROM dir{k} o JOIN ge{k} USING (dirac_id) JOIN pick{k} ON pick{k}.trial = ge{k}.trial)"""


def _searches_sql() -> str:
    """c0, c1 and c2: costs before and after two searches, along -gradient and along the Polak-Ribiere direction."""
    first = f"a0 AS (SELECT 0.01 * {G.extent!r} / avg(sqrt(gx * gx + gy * gy)) AS a FROM w0), dir0 AS (SELECT *, -gx AS dx, -gy AS dy FROM w0)"
    turn = "turn AS (SELECT greatest(sum(gx * (gx - px) + gy * (gy - py)) / sum(px * px + py * py), 0) AS beta FROM w1), dir1 AS (SELECT dirac_id, x, y, gx, gy, beta * ox - gx AS dx, beta * oy - gy AS dy FROM w1, turn)"
    return f"{_start()}, {first}, {_bracketed_ctes(0)}, {turn}, {_bracketed_ctes(1)}"


def _scales_sql() -> str:
    """All points' costs around one quasi-Newton step, then those of two for each."""
    def back(k: int, nn: str) -> str:
        return f"dir{k} AS (SELECT w{k}.*, -n / {G.nb_angles} * gx AS dx, -n / {G.nb_angles} * gy AS dy FROM w{k}, {nn})"

    def unit(a: int, b: int) -> str:
        return f"0.1 * {G.extent!r} / sqrt(n) * (((child * {a} + {b}) % 2147483647 % 1000003) / 500001.5::DOUBLE - 1)"

    kids = f"n2 AS (SELECT 2 * n AS n FROM nn), kid AS (SELECT dirac_id * 2 + r.range AS child, x, y FROM w1, range(2) r), sp AS (SELECT 0 AS trial, child AS dirac_id, x + {unit(48271, 11)} AS x, y + {unit(69621, 7)} AS y FROM kid, nn)"
    again = f"{_evaluated('k', 'sp', 'n2')}, c5 AS (SELECT cost FROM vk), w5 AS (SELECT dirac_id, x, y, gx, gy FROM sp JOIN gk USING (dirac_id)), {back(5, 'n2')}, {_searched(5, '', 'n2')}"
    rows = " UNION ALL ".join(f"SELECT {scale} AS scale, 'diracs' AS stage, CAST(n AS BIGINT) AS n, {step} AS step, round(cost, 5) AS cost FROM c{c}, {nn}" for scale, step, c, nn in ((0, 0, 0, "nn"), (0, 1, 1, "nn"), (1, 0, 5, "n2"), (1, 1, 6, "n2")))
    return f"{_start()}, {back(0, 'nn')}, {_searched(0, '')}, {kids}, {again} {rows}"


def _grid_sql() -> str:
    grid = "gr AS (SELECT CAST(a.range * 5 + b.range AS INTEGER) AS trial, a.range * 2.0 AS t0, b.range * 0.5 - 1.0 AS t1 FROM range(5) a, range(5) b), tr AS (SELECT trial, dirac_id, x - t0 * gx - t1 * x AS x, y - t0 * gy - t1 * y AS y FROM w0, gr)"
    return f"{_start()}, {grid}, {_evaluated('_r', 'tr')} SELECT trial, CAST(t0 AS DOUBLE) AS t0, CAST(t1 AS DOUBLE) AS t1, round(cost, 5) AS cost FROM v_r JOIN gr USING (trial)"


def _before(sql: str) -> str:
    """The CTEs of a query that ends in a plain SELECT of points."""
    return sql[: sql.rindex(" SELECT dirac_id, round(x")]


_GD, _ADAM = (", ".join(_fixed_steps_sql(STEPS, adam)) for adam in (False, True))
_COMPARED = " UNION ALL ".join(f"SELECT * FROM ({_costs(ctes, n, run)})" for ctes, n, run in ((_GD, 2, "gd"), (_ADAM, 2, "adam"), (_before(_lbfgs_sql()), 3, "lbfgs")))

ORACLE = {
    "lbfgs_points": _lbfgs_sql(), "newton_points": _newton_sql(), "line_search_round": _round_sql(),
    "lbfgs_run": _costs(_before(_lbfgs_sql()), STEPS + 1), "subspace_newton_run": _costs(_before(_newton_sql()), 3),
    "gd_steps": _costs(_GD, STEPS), "adam_steps": _costs(_ADAM, STEPS), "line_search_gd_run": _costs(_searches_sql(), 2), "line_search_run": _costs(_searches_sql(), 3), "multiscale_run": _scales_sql(),
    "grid_search_run": _grid_sql(), "optimizer_comparison": _COMPARED,
}
