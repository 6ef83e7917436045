"""Sinograms, cells, halo, mesh, reconstruction, runs and live frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from massflow.functions import axes as A
from massflow.operators import cells as C
from massflow.operators import halo as H
from massflow.operators import mesh as Q
from massflow.operators import radon as R
from massflow.operators import reconstruct as X
from massflow.plans import radon_queries
from massflow.sources import phantoms, runs
from massflow.streaming import live


def test_disk_gradient_query_covers_every_part(spark, tmp_path):
    parts = [(k, 1 + k % 50) for k in (1, 200, 201, 1999, 20_000)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.disk_id, r.angle_id, r.bin_id): (r.gx, r.gy) for r in radon_queries.disk_projection_gradient(spark, str(tmp_path)).collect()}
    g, want = radon_queries.G, {}
    for k, size in parts:
        cx, cy, r = k * 37 % 401 / 100 - 2, k * 53 % 397 / 100 - 1.98, 0.1 + size / 60
        for a in range(g.nb_angles):
            nx, ny = math.cos(a * math.pi / g.nb_angles), math.sin(a * math.pi / g.nb_angles)
            edge = g.s_min + np.arange(g.nb_bins + 1) * g.dw - cx * nx - cy * ny
            d = -np.diff(2 * np.sqrt(np.maximum(r * r - edge * edge, 0))) / g.dw
            want |= {(k, a, b): (x * nx, x * ny) for b, x in enumerate(d) if abs(x) > 1e-4}
    assert {k for k, _, _ in got} == {k for k, _ in parts}
    assert want.keys() <= got.keys()
    for at, v in got.items():
        assert v == pytest.approx(want.get(at, (0, 0)), abs=2e-4 if at not in want else 6e-6)


def test_geometry_and_errors(spark):
    g = R.Geometry(3, 10, 4.0, 1.0)
    assert g.dw == pytest.approx(0.4) and g.s_min == -1
    assert [r.theta for r in g.angles(spark).orderBy("angle_id").collect()] == pytest.approx([0, math.pi / 3, 2 * math.pi / 3])
    for bad in ((0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0), (1, 1, 1.0, (0, 0, 0))):
        with pytest.raises(ValueError):
            R.Geometry(*bad)
    with pytest.raises(ValueError):
        phantoms.disks(spark, [(0, 0, 0, 1)])
    assert R.Geometry(4, 16, 6.0).empty(spark).agg(F.sum("value")).first()[0] == 0


def test_disk_mass_and_centroid(spark):
    g = R.Geometry(5, 401, 8.0)
    sino = R.radon_disks(phantoms.disks(spark, [(0.4, -0.3, 1.2, 2.0)]), g.angles(spark), g)
    for r in R.mass(sino, g).collect():
        assert r.mass == pytest.approx(2 * math.pi * 1.44, rel=1e-6)
    mid = g.points(sino).groupBy("batch").agg((F.sum(F.col("pos") * F.col("w")) / F.sum("w")).alias("m"))
    for r in mid.collect():
        th = r.batch * math.pi / 5
        assert r.m == pytest.approx(0.4 * math.cos(th) - 0.3 * math.sin(th), abs=1e-3)


def test_debias_levels_masses(spark):
    g = R.Geometry(4, 50, 4.0)
    sino = R.radon_disks(phantoms.ring(spark, 3, 1.5, 0.7), g.angles(spark), g)
    out = R.debias(sino, g)
    m = [r.mass for r in R.mass(out, g).collect()]
    assert max(m) - min(m) < 1e-9
    assert out.agg(F.min("value")).first()[0] == pytest.approx(0, abs=1e-9)


def test_deposit_keeps_mass(spark):
    g = R.Geometry(7, 128, 8.0)
    p = phantoms.random_points(spark, 500, 3.6, 1, normal=True).withColumn("w", F.lit(1.0))
    for r in R.mass(R.linear_deposit(p, g.angles(spark), g, 3.0), g).collect():
        assert r.mass == pytest.approx(3, abs=1e-9)


def test_cells(spark):
    one = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0)], "cell_id int, ox double, oy double, ax double, ay double, bx double, by double")
    assert C.measure(C.hypercube_vertices(one), C.hypercube_cuts(one)).first().area == 2
    assert C.measure(*C.unbounded(spark)).first().area == C.LARGEST


def test_axes(spark):
    t = A.from_nested(spark, [[1, 2, 3], [4, 5, 6]], ["row", "col"])
    assert {r["col"]: r.v for r in A.reduce(t, "sum", ["row"]).collect()} == {0: 5, 1: 7, 2: 9}
    ragged = A.from_nested(spark, [[1, 2], [3]], ["outer", "inner"])
    assert {r["outer"]: r.v for r in A.reduce(ragged, "mean", ["inner"]).collect()} == {0: 1.5, 1: 3}
    assert {r["outer"]: r.v for r in A.reduce(ragged, "prod", ["inner"]).collect()} == {0: 2, 1: 3}
    assert A.full(spark, {"a": 2, "b": 3}, 7.0).count() == 6
    assert A.gauss_solve(np.array([[2.0, 1], [1, 3]]), np.array([3.0, 5])) == pytest.approx([0.8, 1.4])
    assert A.gauss_solve(np.zeros((2, 2)), np.ones(2)) == pytest.approx([0, 0])
    assert A.inverse(np.array([[2.0, 0], [0, 4]])) == pytest.approx(np.diag([0.5, 0.25]))


def test_halo_annulus(spark):
    g = R.Geometry(4, 256, 10.0)
    cells = H.build_cells(spark, 1.0, 2.0, 2.0, 16)
    op = H.operator(cells, g.angles(spark), g)
    total = op.groupBy("angle_id").agg((F.sum("val") * g.dw).alias("mass"))
    for r in total.collect():
        assert r.mass == pytest.approx(math.pi * 3, rel=1e-3)


def test_nnls():
    a = np.array([[2.0, 0.3], [0.3, 1.0]])
    assert H.nnls(a, a @ np.array([1.0, 2.0])) == pytest.approx([1, 2])
    assert H.nnls(a, np.array([1.0, -5.0])) == pytest.approx([0.5, 0])


def test_mesh_tiles_exactly_and_is_adjoint(spark):
    cells = Q.tiling(spark, 2.0, 6.0, 0.5, 2).toPandas()
    fine = sum((h / 0.5) ** 2 for h in cells.h)
    n = sum(math.hypot((i + 0.5) / 2, (j + 0.5) / 2) < 6 for i in range(-12, 12) for j in range(-12, 12))
    assert fine == n
    m = Q.GradedMesh(spark, R.Geometry(6, 48, 4.0), outer=4.0, cell=0.5, max_level=2)
    rng = np.random.default_rng(0)
    w, p = rng.random(m.n), rng.random(m.m)
    assert m.apply(w) @ p == pytest.approx(w @ m.adjoint(p), rel=1e-12)


def test_mesh_splits_masses(spark):
    g = R.Geometry(60, 100, 4.0)
    sino = R.radon_disks(phantoms.disks(spark, [(0.2, -0.1, 0.8, 1.0), (2.6, 0.4, 0.5, 1.0), (-2.4, 1.0, 0.6, 1.0)]), g.angles(spark), g).persist()
    m = Q.GradedMesh(spark, g, outer=4.0, cell=0.25, max_level=2, nb_coarse=50)
    m.solve(sino)
    assert m.interior_mass() == pytest.approx(math.pi * 0.64, rel=0.25)


def test_kernels_against_differences():
    rng = np.random.default_rng(0)
    e, y, p = np.linspace(-2, 2, 17), rng.random(16) + 0.1, rng.uniform(-1, 1, 7)
    disk = X.DiskModel.__new__(X.DiskModel)
    disk.edges, disk.radius, disk.g = e, 0.6, R.Geometry(1, 16, 4.0)
    for f in (lambda q: X.tent_transport(q, 0.5, e, y), lambda q: disk.angle(q, y, True)):
        g = f(p)[1]
        for i in range(7):
            a, b = p.copy(), p.copy()
            a[i] += 1e-5
            b[i] -= 1e-5
            assert g[i] == pytest.approx((f(a)[0] - f(b)[0]) / 2e-5, abs=1e-5)


def test_disk_floor(spark):
    g = R.Geometry(8, 64, 6.0)
    sino = R.radon_disks(phantoms.disks(spark, [(0.3, -0.2, 1.0, 1.0), (-1.2, 0.7, 1.0, 1.0)]), g.angles(spark), g)
    m = X.DiskModel(sino, g, 1.0)
    x = np.array([[0.3, -0.2], [-1.2, 0.7]])
    assert m.cost(x) == pytest.approx(m.floor(), abs=1e-8)
    assert m.cost(x + 0.1) > m.floor() + 1e-3


def test_reconstruction_converges(spark):
    g = R.Geometry(8, 201, 6.0)
    sino = R.radon_disks(phantoms.disks(spark, [(0.3, -0.2, 1.0, 1.0)]), g.angles(spark), g).persist()
    r = X.Reconstruction(sino, g).random_points(100)
    start = r.loss()
    r.diracs(optimizer=X.lbfgs, steps=6)
    assert r.loss() < start / 100
    steps = [h["step"] for h in r.history]
    assert steps == sorted(steps) and len(r.frames) == len(r.history)
    counts = []
    X.Reconstruction(sino, g).random_points(50).multiscale(300, optimizer=X.lbfgs, steps=1, stage_callback=lambda k, q: counts.append(len(q.points)))
    assert counts == [50, 200, 300]


def test_line_search_parts():
    a, y = X.bracket(lambda ts: np.array([(t - 3) ** 2 for t in ts]), 1.0)
    assert y[1] <= y[0] and y[1] <= y[2]
    assert X.vertex(a, y) == pytest.approx(3)
    assert X.vertex(a, y, -6.0) == pytest.approx(3, abs=1e-6)
    assert X.vertex(2.0, np.array([0.0, 1.0, 0.0])) == 1.0


def test_runs(spark, tmp_path):
    h = spark.createDataFrame([(0, 1.0), (1, 0.5)], "step int, loss double")
    for name, n in (("a", 10), ("b", 20), ("a", 10)):
        runs.save_run(h, str(tmp_path / "runs"), name, {"nb_angles": n})
    got = runs.load_runs(spark, str(tmp_path / "runs"))
    assert got.count() == 4
    assert [r.setting for r in runs.mismatches(got, ["meta_nb_angles"]).collect()] == ["meta_nb_angles"]
    table = runs.loss_table(got.unionByName(spark.createDataFrame([(2, 0.1, 10, "a")], "step int, loss double, meta_nb_angles long, run string")), ["a", "b"])
    assert {r["step"]: r["b"] for r in table.collect()}[2] == "-"
    frames = spark.range(30).selectExpr("id % 3 AS frame", "id AS dirac_id", "0.1 * id AS x", "0.2 AS y")
    runs.points_html(frames, 6.0, str(tmp_path / "p.html"), max_points=10)
    assert "<canvas" in (tmp_path / "p.html").read_text()
    assert len(runs.sweep(a="1,2", b=[3, 4, 5])) == 6


def test_live_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("s", "c", "x", 1, 0.1), ("s", "c", "y", 2, 0.2), ("s", "c", "x", 3, 0.3)]
    frames = spark.createDataFrame(rows, "sim string, context string, coordinates string, arrival long, value double")
    frames.limit(2).write.json(str(src / "a"))
    stream = spark.readStream.schema(frames.schema).option("recursiveFileLookup", True).json(str(src))
    out, seen = str(tmp_path / "out"), []
    for part in (None, frames.where("arrival = 3")):
        if part is not None:
            part.write.json(str(src / "b"))
        live.upsert_stream(stream, out, str(tmp_path / "ck"), on_batch=lambda b, n: seen.append(n)).awaitTermination()
    got = {r.coordinates: (r.value, r.place) for r in live.read_version(spark, out, max(seen)).collect()}
    assert got == {"x": (0.3, 1), "y": (0.2, 2)}
    with pytest.raises(ValueError):
        live.register([("a", "canvas"), ("a", "canvas")])


def _mesh(spark, **more):
    g = R.Geometry(20, 64, 4.0)
    sino = R.radon_disks(phantoms.disks(spark, [(0.2, -0.1, 0.8, 1.0), (2.6, 0.4, 0.5, 1.0)]), g.angles(spark), g).persist()
    return Q.GradedMesh(spark, g, outer=4.0, cell=0.5, max_level=2, nb_coarse=32, **more), sino


def test_mesh_solvers_meet_their_conditions(spark):
    m, sino = _mesh(spark)
    p = m.coarse(sino)
    lam = 3e-2 * m.lipschitz() / m.degrees().max()
    b, dense = m.adjoint(p), np.column_stack([m.a.normal(e) + lam * m.laplacian(e) for e in np.eye(m.n)])
    free = np.linalg.solve(dense, b)
    assert m.solve(sino, nb_iter=400) == pytest.approx(np.maximum(free, 0), abs=1e-6 * abs(free).max())
    w = m.solve(sino, smooth=3e-2, nonneg=True, nb_iter=6000)
    slope = dense @ w - b  # zero where w is positive, not negative where it is not
    size = abs(b).max()
    assert w.min() >= 0 and slope.min() > -1e-3 * size and abs(slope[w > 1e-6]).max() < 1e-3 * size
    cold = m.solve(sino, tv=3e-3, nb_iter=40)
    far = np.linalg.norm(m.solve(sino, tv=3e-3, nb_iter=2000) - cold)
    m.weights = m.solve(sino, tv=3e-3, nb_iter=2000)
    assert np.linalg.norm(m.solve(sino, tv=3e-3, nb_iter=1, warm=True) - m.weights) < far


def test_huber_penalty(spark):
    m, _ = _mesh(spark)
    w, delta = np.random.default_rng(1).random(m.n), 0.3
    d = w[m._i] - w[m._j]
    want = np.where(abs(d) > delta, abs(d) - delta / 2, d * d / (2 * delta))
    value, grad = m.tv(w, delta)
    assert value == pytest.approx((m._face * want).sum())
    for i in range(0, m.n, 17):
        a, b = w.copy(), w.copy()
        a[i] += 1e-6
        b[i] -= 1e-6
        assert grad[i] == pytest.approx((m.tv(a, delta)[0] - m.tv(b, delta)[0]) / 2e-6, abs=1e-5)


def test_mesh_beyond_the_driver(spark):
    """The operator in blocks on the executors gives what the arrays on the driver give."""
    (near, sino), (far, _) = _mesh(spark), _mesh(spark, max_entries=1)
    assert isinstance(far.a, Q.BlockOperator)
    rng = np.random.default_rng(0)
    w, p = rng.random(near.n), rng.random(near.m)
    assert far.apply(w) == pytest.approx(near.apply(w)) and far.adjoint(p) == pytest.approx(near.adjoint(p))
    assert far.a.normal(w) == pytest.approx(near.a.normal(w)) and far.a.diagonal() == pytest.approx(near.a.diagonal())
    assert far.solve(sino, nb_iter=5) == pytest.approx(near.solve(sino, nb_iter=5), rel=1e-6, abs=1e-9)


def test_tents_in_mass_space():
    """The pieces' cost against the cost on a very fine grid of the same density."""
    rng = np.random.default_rng(4)
    e, y, p = np.linspace(-2, 2, 9), np.array([0, 1, 0, 3, 2, 0.5, 0, 1.0]), rng.uniform(-1, 1, 6)
    cost, _ = X.tent_transport(p, 0.4, e, y)
    z = np.linspace(-1.5, 1.5, 60_001)
    mid = (z[:-1] + z[1:]) / 2
    f = np.maximum(0.4 - abs(mid[:, None] - p), 0).sum(1)
    centers = (e[:-1] + e[1:]) / 2
    assert X.transport(centers[y > 0], y[y > 0], z, f)[0] == pytest.approx(cost, rel=1e-4)


def test_plane_and_grid_searches_go_down(spark):
    g = R.Geometry(6, 64, 6.0)
    m = X.DiracModel(R.radon_disks(phantoms.disks(spark, [(0.3, -0.2, 1.0, 1.0)]), g.angles(spark), g).persist(), g)
    x = X.random_points(20, g.extent, 1)
    start = m.cost(x)
    for third in (False, True):
        assert m.cost(X.plane_search(m, x, steps=6, third=third)) < 0.5 * start
    assert m.cost(X.grid_descent(m, x, steps=3, n=5)) < 0.5 * start
    at = np.array([[1.0, 0], [0, 1], [1, 1], [2, 1], [-1, 2]])
    h, b = np.array([[3.0, 1], [1, 2]]), np.array([-1.0, 2])
    y = 5 + at @ b + 0.5 * np.einsum("ki,ij,kj->k", at, h, at)
    assert X.fitted_minimum(at, y, 5.0, b) == pytest.approx(-np.linalg.solve(h, b))
    assert X.fitted_minimum(at, 5 + at @ b - (at**2).sum(1), 5.0, b) is None


def test_disk_out_of_the_field_is_drawn_back():
    disk = X.DiskModel.__new__(X.DiskModel)
    disk.edges, disk.radius, disk.g = np.linspace(-2, 2, 17), 0.5, R.Geometry(1, 16, 4.0)
    y, s = np.ones(16), np.array([9.0, 11.0])
    v, grad = disk.angle(s, y, True)
    assert (grad > 0).all() and grad[0] == pytest.approx((disk.angle(s + [1e-5, 0], y, True)[0] - v) / 1e-5, rel=1e-3)


def test_disk_profile_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    s, r, e = rng.uniform(-1, 1, 50), rng.uniform(0.1, 0.5, 50), np.linspace(-2, 2, 33)
    whole = X.disk_profile(s, r, e)
    monkeypatch.setattr(X, "DISK_BLOCK", 7)
    assert X.disk_profile(s, r, e) == pytest.approx(whole)
