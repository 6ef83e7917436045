"""Golden costs, gradients against finite differences, degenerate inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massflow.operators import measures as M
from massflow.operators import reconstruct as X
from massflow.operators import transport as T

POINTS = "batch long, dirac_id long, pos double, w double"
CELLS = "batch long, cell_id int, y double"
# positions, weights, densities, cost
CASES = [
    ([0.5], [1], [1], 1 / 12),
    ([1.0], [1], [1, 1], 1 / 3),
    ([0.0, 1.0], [1, 1], [1, 0, 1], 4 / 3),
    ([0.2, 0.5, 0.9], [1, 1, 2], [1, 3, 1], 0.9820833333),
    ([0.1, 0.3, 0.5, 0.7, 0.9], [1] * 5, [0, 0, 1, 2, 1], 9.2453333333),
    ([0.1, 0.3, 0.5, 0.7, 0.9], [1] * 5, [1, 2, 1, 0, 0], 1.2453333333),
]


def _tables(spark, cases):
    d = spark.createDataFrame([(b, i, float(p), float(w)) for b, (ps, ws, *_) in enumerate(cases) for i, (p, w) in enumerate(zip(ps, ws))], POINTS)
    t = spark.createDataFrame([(b, i, float(y)) for b, case in enumerate(cases) for i, y in enumerate(case[2])], CELLS)
    return d, M.knots_density(t)


@pytest.mark.parametrize("buckets", [1, 4])
def test_golden_costs(spark, buckets):
    d, t = _tables(spark, CASES)
    got = {r.batch: r.cost for r in T.cost(T.pieces(d, t, buckets)).collect()}
    for b, case in enumerate(CASES):
        assert got[b] == pytest.approx(case[3], abs=1e-9)
    for other in (T.cost_by_moments(d, t), T.cost_by_barycenters(T.pieces(d, t, buckets))):
        for r in other.collect():
            assert r.cost == pytest.approx(got[r.batch], abs=1e-9)


def test_barycenter_of_a_uniform_cell(spark):
    d, t = _tables(spark, CASES[:1])
    assert T.barycenters(T.pieces(d, t)).first().barycenter == pytest.approx(0.5, abs=1e-12)


def _cost(p, w, y):
    return X.transport(np.array(p, float), np.array(w, float), np.arange(len(y) + 1.0), np.array(y, float))[0]


def _slope(f, x, i, h=1e-5):
    a, b = list(map(float, x)), list(map(float, x))
    a[i] += h
    b[i] -= h
    return (f(a) - f(b)) / (2 * h)


def test_gradients_against_differences(spark):
    p, w, y = [0.2, 0.5, 0.9], [1, 1, 2], [1, 3, 1]
    d, t = _tables(spark, [(p, w, y)])
    plan = T.pieces(d, t)
    gp = {r.dirac_id: r.grad for r in T.grad_position(plan).collect()}
    gw = {r.dirac_id: r.grad for r in T.grad_weight(plan, d).collect()}
    gy = {r.cell_id: r.grad for r in T.grad_density(d, t).collect()}
    for i in range(3):
        assert gp[i] == pytest.approx(_slope(lambda v: _cost(v, w, y), p, i), abs=1e-6)
        assert gw[i] == pytest.approx(_slope(lambda v: _cost(p, v, y), w, i), abs=1e-6)
        assert gy[i] == pytest.approx(_slope(lambda v: _cost(p, w, v), y, i), abs=1e-6)
    assert X.density_gradient(np.array(p), np.array(w, float), np.arange(4.0), np.array(y, float))[1] == pytest.approx([gy[i] for i in range(3)], abs=1e-9)


def test_buckets_do_not_change_gradients(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(0, i, float(x), float(v)) for i, (x, v) in enumerate(zip(rng.random(200), rng.random(200)))], POINTS)
    t = M.knots_density(spark.createDataFrame([(0, i, float(y)) for i, y in enumerate(rng.random(9))], CELLS))
    one, many = ({r.dirac_id: r.grad for r in T.grad_position(T.pieces(d, t, k)).collect()} for k in (1, 8))
    assert one.keys() == many.keys()
    assert max(abs(one[i] - many[i]) for i in one) < 1e-12


def test_masses(spark):
    one = spark.createDataFrame([(0, i, float(i), w) for i, w in enumerate([2.0, 2.0, 4.0])], POINTS)
    assert M.point_mass(one).first().mass == 8
    assert M.normalize_points(one).agg(F.sum("w")).first()[0] == pytest.approx(1)
    cells = spark.createDataFrame([(0, [0, 0], 1.0), (0, [0, 1], 0.0), (0, [0, 2], 1.0)], "image_id int, cell_idx array<int>, value double")
    knots = spark.createDataFrame([(0, dim, k, float(k)) for dim, n in ((0, 2), (1, 4)) for k in range(n)], "image_id int, dim int, k int, x double")
    assert M.image_mass(cells, knots).first().mass == 2


def test_empty_points(spark):
    d, t = _tables(spark, CASES[:1])
    assert T.cost(T.pieces(d.limit(0), t)).count() == 0


def test_one_batch_in_many_buckets(spark):
    """Potentials, gradients, look-ups and moments are the same however a batch is cut, empty cells and ties included."""
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.random(150), np.full(20, 0.4), [0.0, 1.0]])
    d = spark.createDataFrame([(0, i, float(x), float(v)) for i, (x, v) in enumerate(zip(at, rng.random(len(at)) + 0.1))], POINTS).persist()
    t = M.knots_density(spark.createDataFrame([(0, i, float(y)) for i, y in enumerate([0, 1, 2, 0, 0, 5, 1, 0, 3, 0])], CELLS)).persist()
    levels = spark.range(101).select(F.lit(0).cast("long").alias("batch"), F.col("id").alias("level_id"), (F.col("id") / 100).alias("level"))

    def both(f, key):
        one, many = ({tuple(r[k] for k in key): r for r in f(k).collect()} for k in (1, 16))
        assert one.keys() == many.keys() and one
        for k, r in one.items():
            for c, v in r.asDict().items():
                assert many[k][c] == pytest.approx(v, abs=1e-9), (k, c)

    both(lambda k: T.potentials(T.pieces(d, t, k), d, k), ["dirac_id"])
    both(lambda k: T.grad_weight(T.pieces(d, t, k), d, k), ["dirac_id"])
    both(lambda k: T.grad_density(d, t, k), ["cell_id"])
    both(lambda k: T.lookup(levels, t, k), ["level_id"])
    both(lambda k: T.cost_by_moments(d, t, k), ["batch"])
    both(lambda k: T.cell_cum_mass(t, k), ["cell_id"])


def test_light_points_and_fine_densities_are_spread(spark):
    """Buckets hold equal rows, whatever their mass, and the costs stay."""
    rng = np.random.default_rng(9)
    at = np.concatenate([rng.random(40) * 8, 1 + 1e-3 * rng.random(160)])
    w = np.concatenate([rng.random(40) + 0.1, np.full(160, 1e-7)])
    d = spark.createDataFrame([(0, i, float(x), float(v)) for i, (x, v) in enumerate(zip(at, w))] + [(1, i, 0.1 * i, 1.0) for i in range(9)], POINTS).persist()
    y = [0.0, 1, 2, 0, 5, 1] + [0.01] * 200
    t = M.knots_density(spark.createDataFrame([(b, i, float(v)) for b in (0, 1) for i, v in enumerate(y)], CELLS)).persist()
    s, u = T.sorted_points(d), T.cell_cum_mass(t).where("m > 0")
    cut = T._Buckets(8, s.select("batch", F.col("q0").alias("q")), u.select("batch", F.col("c0").alias("q")))
    size = {}
    for part in (cut.split(s, "q0", "w"), cut.split(u, "c0", "m")):
        for r in part.groupBy("batch", "bucket").count().collect():
            size[r.batch, r.bucket] = size.get((r.batch, r.bucket), 0) + r["count"]
    assert max(n for (b, _), n in size.items() if b == 0) < 100 and len([k for k in size if k[0] == 0]) >= 6
    one, many = ({r.batch: r.cost for r in T.cost(T.pieces(d, t, k)).collect()} for k in (1, 8))
    assert one == pytest.approx(many, rel=1e-10)
    one, many = ({(r.batch, r.cell_id): r.grad for r in T.grad_density(d, t, k).collect()} for k in (1, 8))
    assert one == pytest.approx(many, rel=1e-8, abs=1e-7)


def test_histogram_of_nothing(spark):
    none = spark.createDataFrame([], "v double")
    assert M.histogram(none, "v").count() == 0
    assert M.histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


@pytest.mark.parametrize("buckets", [1, 4])
def test_running_masses_gather_no_rounding(spark, buckets):
    n = 3000
    d = spark.range(n).select(F.lit(0).alias("batch"), F.col("id").alias("dirac_id"), (F.col("id") * 0.5).alias("pos"), F.lit(1.0).alias("w"))
    assert [r.q0 for r in T.sorted_points(d, buckets).orderBy("pos").collect()] == [k / n for k in range(n)]


def test_bucket_cuts_are_made_once(spark):
    d = spark.range(100).select(F.lit(0).alias("batch"), F.col("id").alias("dirac_id"), F.col("id").cast("double").alias("pos"), F.lit(1.0).alias("w"))
    assert "percentile_approx" not in T.sorted_points(d, 4)._jdf.queryExecution().toString()
