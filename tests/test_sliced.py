"""Table models and optimizers against the array ones, in one piece and in many, stopped and gone on with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massflow.functions.stored import Store
from massflow.operators import descent as D
from massflow.operators import radon as R
from massflow.operators import reconstruct as X
from massflow.operators import sliced as S

G = R.Geometry(5, 24, 6.0)
c = F.col


@pytest.fixture(scope="module")
def sino(spark):
    disks = spark.createDataFrame([(0, 0.3, -0.2, 1.0, 1.0), (1, -0.9, 0.8, 0.5, 2.0)], "disk_id int, cx double, cy double, r double, rho double")
    return R.radon_disks(disks, G.angles(spark), G).persist()


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).normal(0, 0.7, (30, 2))


def table(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "dirac_id long, x double, y double")


def arrays(points):
    return np.array([(r.x, r.y) for r in points.orderBy("dirac_id").collect()])


def read(e, n, trial=0):
    g = np.zeros((n, 2))
    for r in e.gradient.where(c("trial") == trial).collect():
        g[r.dirac_id] = r.gx, r.gy
    return {r.trial: r.cost for r in e.costs.collect()}[trial], g


@pytest.mark.parametrize("name,radius", [("diracs", None), ("disks", 0.4), ("tents", 0.4)])
def test_cost_and_gradient_equal_the_array_models(spark, sino, x, name, radius, monkeypatch):
    known = X.make_model(name, sino, G, radius)
    model = S.make_model(name, sino, G, radius)
    two = S.with_trial(table(spark, x)).unionByName(S.with_trial(table(spark, x * 0.5 + 0.1), 1))
    e = model.evaluate(two, 2)
    for trial, at in enumerate((x, x * 0.5 + 0.1)):
        cost, grad = known.value_and_grad(at)
        v, g = read(e, len(x), trial)
        assert v == pytest.approx(cost, rel=1e-9)
        assert g == pytest.approx(grad, abs=1e-9)
    # The same in many buckets and many batches of angles, from a store that already holds some of them.
    monkeypatch.setattr(S, "buckets_of", lambda n: 4)
    store = Store(spark)
    store.put("run-0of3", model.part(S.with_trial(table(spark, x)), model.angles.where("angle_id % 3 = 0"), 1, len(x)))
    v, g = read(model.evaluate(S.with_trial(table(spark, x)), angle_batches=3, store=store, name="run"), len(x))
    cost, grad = known.value_and_grad(x)
    assert v == pytest.approx(cost, rel=1e-9) and g == pytest.approx(grad, abs=1e-9)
    assert all(store.has(f"run-{b}of3") for b in range(3))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,radius", [("diracs", None), ("tents", 0.4)])
def test_many_runs_and_finer_grids_equal_the_array_models(spark, sino, x, name, radius, monkeypatch):
    monkeypatch.setattr(S, "WINDOW_ROWS", 4)
    monkeypatch.setattr(S, "CELLS", 3)
    # Points that share places, one far outside, and clusters narrower than a cell.
    x = np.concatenate([x, np.repeat(x[:2], 6, 0), [[90.0, -200.0]], 0.3 + 1e-7 * x[:9]])
    cost, grad = X.make_model(name, sino, G, radius).value_and_grad(x)
    v, g = read(S.make_model(name, sino, G, radius).evaluate(S.with_trial(table(spark, x).repartition(3))), len(x))
    assert v == pytest.approx(cost, rel=1e-9)
    ties = [k for k in range(len(x)) if (x == x[k]).all(1).sum() > 1]  # which of them comes first is by id in tables only
    rest = np.setdiff1d(np.arange(len(x)), ties)
    assert g[rest] == pytest.approx(grad[rest], abs=1e-7) and g[ties].sum(0) == pytest.approx(grad[ties].sum(0), abs=1e-7)


def test_evaluations_shuffle_no_pieces_and_few_knots(spark, sino):
    points = S.with_trial(spark.range(4000).select(c("id").alias("dirac_id"), (c("id") * 37 % 4001 / 4001.0 - 0.5).alias("x"), (c("id") * 53 % 3989 / 3989.0 - 0.5).alias("y")))
    for name, radius in (("diracs", None), ("tents", 0.05)):
        made = S.make_model(name, sino, G, radius).part(points, G.angles(spark), 1, 4000)
        assert "Window" not in _plan(made) and "Generate" not in _plan(made)


def test_grids_of_many_trials_come_in_batches_of_angles(spark, sino, x, monkeypatch):
    monkeypatch.setattr(S, "MOST_BROADCAST", 3 * S.GRID_NUMBERS)
    model = S.make_model("tents", sino, G, 0.4)
    cost, grad = X.make_model("tents", sino, G, 0.4).value_and_grad(x)
    v, g = read(model.evaluate(S.with_trial(table(spark, x)), name="few"), len(x))
    assert v == pytest.approx(cost, rel=1e-9) and g == pytest.approx(grad, abs=1e-9)
    assert model.store.has("few-0of2") and model.store.has("few-1of2")


def test_narrow_tents_keep_the_gradient_of_the_mean(spark, sino):
    # Moved together, points of any width change the cost alike; running sums of 1 / radius once lost that.
    n = 5000
    points = S.with_trial(spark.range(n).select(c("id").alias("dirac_id"), (c("id") * 37 % 5003 / 5003.0 * 2 - 1).alias("x"), (c("id") * 53 % 4999 / 4999.0 * 2 - 1).alias("y")))
    together = [S.make_model(name, sino, G, radius).evaluate(points).gradient.agg(F.sum("gx"), F.sum("gy")).first() for name, radius in (("diracs", None), ("tents", 0.003))]
    assert tuple(together[1]) == pytest.approx(tuple(together[0]), abs=1e-8)


def test_disks_outside_the_field(spark, sino, x):
    far = x + 40.0
    cost, grad = X.make_model("disks", sino, G, 0.4).value_and_grad(far)
    v, g = read(S.make_model("disks", sino, G, 0.4).evaluate(S.with_trial(table(spark, far))), len(x))
    assert v == pytest.approx(cost, rel=1e-9) and g == pytest.approx(grad, abs=1e-9)


def test_models_by_name(spark, sino):
    with pytest.raises(ValueError):
        S.make_model("cubes", sino, G)
    with pytest.raises(ValueError):
        S.make_model("disks", sino, G)
    assert S.make_model("disks", sino, G, 0.4).floor() == X.make_model("disks", sino, G, 0.4).floor()


def test_lbfgs_equals_the_array_one_and_goes_on(spark, sino, x):
    model = S.make_model("diracs", sino, G)
    losses = []
    known = X.lbfgs(X.make_model("diracs", sino, G), x, steps=4, memory=2, ftol=0.0, on_step=lambda k, p, v: losses.append(v))
    store = Store(spark)
    D.lbfgs(model, table(spark, x), steps=2, memory=2, ftol=0.0, store=store)
    calls = []
    part = model.part
    model.part = lambda *a: calls.append(1) or part(*a)
    run = D.lbfgs(model, table(spark, x), steps=4, memory=2, ftol=0.0, store=Store(spark, store.path))
    assert len(calls) < 2 + sum(1 for h in run.history if h["t"] < 1)  # steps 3 and 4 only
    assert [h["cost"] for h in run.history[1:]] == pytest.approx(losses, rel=1e-7)
    assert arrays(run.points) == pytest.approx(known, abs=1e-6)


def test_newton_adam_and_descent_equal_the_array_ones(spark, sino, x):
    model, known = S.make_model("diracs", sino, G), X.make_model("diracs", sino, G)
    assert arrays(D.gradient_descent(model, table(spark, x), steps=2, rate=0.3).points) == pytest.approx(X.gradient_descent(known, x, steps=2, rate=0.3), abs=1e-9)
    assert arrays(D.adam(model, table(spark, x), steps=3, clip=0.5).points) == pytest.approx(X.adam(known, x, steps=3, clip=0.5), abs=1e-9)
    assert arrays(D.subspace_newton(model, table(spark, x), steps=3).points) == pytest.approx(X.subspace_newton(known, x, steps=3), abs=1e-6)


@pytest.mark.parametrize("method", ["gd", "pr"])
def test_line_searches_descend(spark, sino, x, method):
    run = D.conjugate(S.make_model("diracs", sino, G), table(spark, x), steps=3, method=method)
    costs = [h["cost"] for h in run.history]
    assert costs == sorted(costs, reverse=True) and costs[-1] < costs[0] / 20
    assert X.make_model("diracs", sino, G).cost(arrays(run.points)) == pytest.approx(costs[-1], rel=1e-9)
    with pytest.raises(ValueError):
        D.conjugate(S.make_model("diracs", sino, G), table(spark, x), method="none")


def test_bracket_finds_a_parabolas_vertex(spark):
    def of(f, ts):
        return D.bracketed(spark.createDataFrame([(k, float(t), float(f(t))) for k, t in enumerate(ts)], "trial int, t double, cost double")).first()

    assert of(lambda t: (t - 1.3) ** 2 + 2, [0.25, 0.5, 1, 2, 4]).vertex == pytest.approx(1.3)
    assert of(lambda t: -t, [1, 2, 4]).vertex == 4 and of(lambda t: t, [1, 2, 4]).vertex == 1


def test_store_keeps_whole_tables_only(spark):
    store = Store(spark)
    store.put("a", spark.range(3))
    assert store.has("a") and store.put("a", spark.range(9)).count() == 3
    store.drop("a")
    assert not store.has("a") and store.put("a", spark.range(9)).count() == 9
    assert Store(spark, store.path).get("a").count() == 9


def test_interleaved_run_takes_whole_stages(spark, monkeypatch):
    """Each scale has 20 steps on diracs, then 10 on tents, and four points come of one (F3)."""
    from massflow.plans import descent_queries as Q

    asked, taken = [], []
    whole = D.multiscale
    monkeypatch.setattr(D, "multiscale", lambda sino, g, points, final, factor, **how: (asked.append((final, factor, points.count())), whole(sino, g, points, final, factor, **how))[1])

    def stepped(model, x, steps, **how):
        taken.append((type(model), steps))
        return D.Run(x, [{"step": k, "cost": 1.0, "t": 1.0} for k in range(steps + 1)])

    monkeypatch.setattr(D, "lbfgs", stepped)
    rows = Q.interleaved_run(spark, "/root/testdata/sf0.001").collect()
    (final, factor, n), = asked
    assert factor == 4 and final == 4 * n
    assert taken == [(S.Diracs, 20), (S.Tents, 10)] * 2
    assert [(r["scale"], r["stage"], r["n"]) for r in rows if r["step"] == 0] == [(0, "diracs", n), (0, "tents", n), (1, "diracs", final), (1, "tents", final)]
    assert len(rows) == 2 * (21 + 11)
