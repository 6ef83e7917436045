"""User calls, their derivatives and error channel, and the rest of the axis algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massflow.functions import axes as A
from massflow.functions import calls as K


def _forward(item, errors, x, scale=1.0):
    if (x < 0).any():
        errors.report("negative in %s", item["b"])
    return {"y": scale * x**2, "z": np.cumsum(x)}


def _backward(item, errors, columns, given, scale=1.0):
    x = columns["x"]
    g = np.zeros(len(x))
    if "y" in given:
        g += 2 * scale * x * given["y"]
    if "z" in given:
        g += np.cumsum(given["z"][::-1])[::-1]
    return {"x": g}


CALL = K.Call(_forward, ("b",), {"y": "double", "z": "double"}, _backward, ("x",))


def test_call_per_item_and_over_one_more_axis(spark):
    t = spark.createDataFrame([(0, 1, 3.0), (0, 0, 1.0), (1, 0, 2.0), (1, 1, 5.0)], "b int, k int, x double")
    got = {(r.b, r.row): (r.y, r.z) for r in CALL(t.drop("k")).collect()}
    assert got == {(0, 0): (1, 1), (0, 1): (9, 4), (1, 0): (4, 2), (1, 1): (25, 7)}
    each = CALL.over("k")(t)
    assert each.columns == ["b", "k", "row", "y", "z"] and {(r.b, r.k): r.z for r in each.collect()} == {(0, 1): 3, (0, 0): 1, (1, 0): 2, (1, 1): 5}
    assert CALL(t.drop("k").limit(0)).count() == 0


def test_call_derivative_against_differences(spark):
    x = np.array([0.3, 1.2, 2.0])
    t = spark.createDataFrame([(0, float(v)) for v in x], "b int, x double")
    for out in ("y", "z"):
        g = np.array([r.x for r in CALL.grad(t, out).orderBy("row").collect()])
        f = lambda v: float(_forward({"b": 0}, K.Errors(), np.sort(v))[out].sum())
        assert K.gradient_error(f, lambda v: g, x) < 1e-6
        assert K.gradient_error(f, lambda v: g + 0.1, x) > 1e-3
    with pytest.raises(ValueError):
        K.Call(_forward, ("b",), {"y": "double"}).grad(t, "y")


def test_call_errors(spark):
    t = spark.createDataFrame([(0, 1.0), (1, -1.0)], "b int, x double")
    assert [(r.b, r.error) for r in CALL.errors(t).collect()] == [(1, "negative in 1")]
    with pytest.raises(Exception, match="negative in 1"):
        CALL(t).collect()


def test_fold(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    out = K.fold(lambda t, k: t.withColumn("v", F.col("v") + k), spark.range(3).select(F.lit(0).alias("v")), range(5), every=2)
    assert [r.v for r in out.collect()] == [10, 10, 10]


def test_views_and_assignment(spark):
    x = np.arange(6.0).reshape(2, 3)
    t = A.wrap(spark, x, ["a", "b"])
    assert (A.dense(t) == x).all() and A.length(t, "b") == 3
    assert (A.dense(A.matmul(t, A.transpose(t, "b", "a"))) == x @ x.T).all()
    assert (A.dense(A.repeat(t, "b", 2)) == np.repeat(x, 2, 1)).all()
    assert (A.dense(A.hstack([t, t], "b", [3, 3])) == np.hstack([x, x])).all()
    assert (A.dense(A.offset(t, b=1)) == x[:, 1:]).all() and (A.dense(A.row(t, 1)) == x[1]).all()
    assert A.axes(A.unsqueeze(t, "n", 1)) == ["a", "n", "b"] and (A.dense(A.squeeze(A.unsqueeze(t, "n"), "n")) == x).all()
    with pytest.raises(Exception, match="longer than 1"):
        A.squeeze(t, "a").collect()
    part = A.wrap(spark, np.full((1, 5), 10.0), ["a", "b"])
    assert (A.dense(A.assign(t, part, lambda p, q: p + q)) == [[10, 11, 12], [3, 4, 5]]).all()
    assert A.intersection(t, part).count() == 3
    assert A.scalar(A.pick(A.row(t, 1), "b", 2)) == 5 and [k for k, _ in A.rows_of(t)] == [0, 1]
    with pytest.raises(ValueError):
        A.scalar(t)
    assert [r.v for r in A.linspace(spark, "k", 0.0, 1.0, 5).orderBy("k").collect()] == [0, 0.25, 0.5, 0.75, 1]
    assert A.dense(A.iota(spark, "k", 3)).tolist() == [0, 1, 2] and A.ones(spark, {"k": 4}).count() == 4


def test_outer_products_are_counted(spark, monkeypatch):
    a, b = A.iota(spark, "i", 40), A.iota(spark, "j", 30)
    assert A.mul(a, b).count() == 1200
    monkeypatch.setattr(A, "OUTER_CELLS", 30)
    assert A.mul(a, b).count() == A.mul(b, a).count() == 1200
    monkeypatch.setattr(A, "OUTER_CELLS", 20)
    with pytest.raises(ValueError):
        A.mul(a, b)


def test_experiments_with_typed_sweeps(spark):
    from massflow.sources import experiments as E

    reg = E.Registry()

    @reg.add("adds", a=E.Param(int, 1), b=E.Param(float, 0.5), loud=E.Param(bool, False), how=E.Param(str, "x", ("x", "y")))
    def adds(spark, a, b, loud, how):
        return [{"total": a + b}]

    got = reg.run(spark, "adds", ["--a=1,2", "--how=x,y", "--loud=true"]).collect()
    assert [(r.a, r.how, r.loud, r.total) for r in got] == [(1, "x", True, 1.5), (1, "y", True, 1.5), (2, "x", True, 2.5), (2, "y", True, 2.5)]
    for bad in ("--c=1", "a=1", "--how=z", "--a=x"):
        with pytest.raises(ValueError):
            reg.combinations("adds", [bad])
    with pytest.raises(ValueError):
        reg.add("again")(adds)
    rows = E.REGISTRY.run(spark, "parabola_profile", ["--points=10"]).collect()
    assert len(rows) == 9 and max(abs(r.cost - r.parabola) for r in rows) < 0.05 * max(r.cost for r in rows)
    warm = {r.start: r.misfit for r in E.REGISTRY.run(spark, "warm_start", ["--again=8"]).collect()}
    assert warm["warm"] < warm["cold"]
    stages = [r.stage for r in E.REGISTRY.run(spark, "two_phases", ["--points=8", "--steps=2"]).collect()]
    assert stages[0] == "diracs" and stages[-1] == "disks"


def test_live_server():
    import json
    import urllib.error
    import urllib.request

    from massflow.streaming import server as S

    http, window = S.serve(most=2)
    base = f"http://127.0.0.1:{http.server_port}"
    try:
        def post(frame):
            with urllib.request.urlopen(urllib.request.Request(base + "/frames", json.dumps(frame).encode()), timeout=10) as r:
                return json.load(r)

        key = {"sim": "s", "context": "c", "coordinates": [0]}
        assert post({**key, "v": 1}) == {"arrival": 1} and post({**key, "v": 2}) == {"arrival": 2}
        post({**key, "coordinates": [1], "v": 3})
        with urllib.request.urlopen(base + "/frames", timeout=10) as r:
            assert [f["v"] for f in json.load(r)] == [2, 3]
        with urllib.request.urlopen(urllib.request.Request(base + "/events", headers={"Last-Event-ID": "2"}), timeout=10) as r:
            assert r.readline() == b"id: 3\n" and json.loads(r.readline().removeprefix(b"data: "))["v"] == 3
        post({**key, "coordinates": [2], "v": 4})
        assert [f["v"] for f in window.since(0)] == [3, 4]  # bounded
        for bad in ({"sim": "s"}, [1]):
            with pytest.raises(urllib.error.HTTPError):
                post(bad)
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(base + "/nothing", timeout=10)
    finally:
        S.close(http)
