"""Optimizers and line searches whose points, steps and gradients are tables.

The driver holds scalars only: costs, step lengths and the dot products that a
step needs, which come from one grouped sum.  Every step writes its state and a
one-row log under numbered names, so a run that is started again on the same
store goes on after the last written step.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massflow.functions.stored import Store
from massflow.operators import radon as R
from massflow.operators.sliced import Diracs, Evaluation, SlicedModel, Tents, with_trial

c = F.col
#: Halvings of a step that are tried at most, and how many are judged in one plan.
TRIES = 20
ROUND = 4
ARMIJO = 1e-4


@dataclass
class Run:
    """Points after the last step, and a record of every step: its number, the cost, the step's length."""

    points: DataFrame
    history: list[dict] = field(default_factory=list)

    @property
    def cost(self) -> float:
        return self.history[-1]["cost"]


class _Steps:
    """Numbered states and logs of one run in a store."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        self.logs: list[dict] = []
        while store.has(f"{name}-log-{len(self.logs)}"):
            self.logs.append(json.loads(store.get(f"{name}-log-{len(self.logs)}").first()[0]))

    def state(self) -> DataFrame:
        return self.store.get(f"{self.name}-state-{len(self.logs) - 1}")

    def write(self, state: DataFrame, log: dict) -> DataFrame:
        """The state, then its log: a state without a log is made again."""
        k = len(self.logs)
        self.store.drop(f"{self.name}-state-{k}")
        state = self.store.put(f"{self.name}-state-{k}", state)
        self.finish(log)
        return state

    def finish(self, log: dict) -> None:
        k = len(self.logs)
        self.store.put(f"{self.name}-log-{k}", self.store.spark.createDataFrame([(json.dumps(log),)], "log string"))
        self.logs.append(log)
        if k > 1:
            self.store.drop(f"{self.name}-state-{k - 2}")


def _cost(e: Evaluation) -> float:
    return float(e.costs.first()["cost"])


def _located(points: DataFrame) -> DataFrame:
    return points.select("dirac_id", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))


def gradient_descent(model: SlicedModel, points: DataFrame, steps: int = 100, rate: float = 0.5, store: Store | None = None, name: str = "gd") -> Run:
    """Fixed steps along the gradient of the mean over points."""
    store = store or model.store
    run = _Steps(store, name)
    x = run.state() if run.logs else _located(points)
    n = points.count()
    while len(run.logs) < steps:
        e = model.evaluate(with_trial(x), store=store, name=f"{name}-at-{len(run.logs)}")
        x = run.write(R.descend(x, e.gradient.drop("trial"), rate * n / model.g.nb_angles), {"step": len(run.logs), "cost": _cost(e), "t": rate})
    return Run(x, run.logs)


def adam(model: SlicedModel, points: DataFrame, steps: int = 100, rate: float = 0.1, clip: float | None = None, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, store: Store | None = None, name: str = "adam") -> Run:
    """Adam with the gradient's norm clipped."""
    store = store or model.store
    run = _Steps(store, name)
    x = run.state() if run.logs else _located(points)
    while len(run.logs) < steps:
        k = len(run.logs)
        e = model.evaluate(with_trial(x), store=store, name=f"{name}-at-{k}")
        g = e.gradient.drop("trial")
        size = float(np.sqrt(g.agg(F.sum(c("gx") ** 2 + c("gy") ** 2)).first()[0] or 0.0))
        if clip is not None and size > clip:
            g = g.select("dirac_id", *((c(v) * (clip / size)).alias(v) for v in ("gx", "gy")))
        x = run.write(R.adam_step(x, g, x if k else None, k + 1, rate, beta1, beta2, eps), {"step": k, "cost": _cost(e), "t": rate, "norm": size})
    return Run(x.select("dirac_id", "x", "y"), run.logs)


# ---- trials --------------------------------------------------------------------------


def _moved(state: DataFrame, dx: Column, dy: Column, ts: list[float]) -> DataFrame:
    """The points at each trial's step along a direction."""
    trials = F.explode(F.array(*(F.struct(F.lit(j).alias("trial"), F.lit(float(t)).alias("t")) for j, t in enumerate(ts))))
    at = state.select("dirac_id", "x", "y", dx.alias("dx"), dy.alias("dy"), trials.alias("k"))
    return at.select(c("k.trial").alias("trial"), "dirac_id", (c("x") + c("k.t") * c("dx")).alias("x"), (c("y") + c("k.t") * c("dy")).alias("y"))


def trial_table(model: SlicedModel, state: DataFrame, dx: Column, dy: Column, ts: list[float], store: Store | None = None, name: str | None = None) -> tuple[DataFrame, Evaluation]:
    """(trial, t, cost) of a whole round of steps, judged in one plan, and its evaluation."""
    e = model.evaluate(_moved(state, dx, dy, ts), len(ts), store=store, name=name)
    steps = state.sparkSession.createDataFrame(list(enumerate(float(t) for t in ts)), "trial int, t double")
    return e.costs.join(F.broadcast(steps), "trial").select("trial", "t", "cost"), e


def bracketed(trials: DataFrame) -> DataFrame:
    """(low, at, high, least, vertex) of a round: the cheapest trial, its neighbours in t, and the least point of the parabola through the three.

    Where the cheapest trial is at an end, or the three bend down, the vertex is that trial itself.
    """
    by_t = Window.orderBy("t")  # a row per trial
    near = trials.select("t", "cost", *(f("t").over(by_t).alias(f"t{k}") for k, f in (("0", F.lag), ("1", F.lead))), *(f("cost").over(by_t).alias(f"c{k}") for k, f in (("0", F.lag), ("1", F.lead))))
    best = near.agg(F.min_by(F.struct("*"), F.struct("cost", "t")).alias("b")).select("b.*")
    left, right = c("t") - c("t0"), c("t1") - c("t")
    up, down = (c("c0") - c("cost")) / left, (c("c1") - c("cost")) / right
    # The parabola p with p(0) = cost, p(-left) = c0, p(right) = c1 has its least point at (up right - down left) / (2 (up + down)).
    shift = F.try_divide(up * right - down * left, 2 * (up + down))
    vertex = F.when((up + down) > 0, c("t") + F.least(F.greatest(shift, -left), right))
    return best.select(c("t0").alias("low"), c("t").alias("at"), c("t1").alias("high"), c("cost").alias("least"), F.coalesce(vertex, c("t")).alias("vertex"))


def _armijo(model: SlicedModel, state: DataFrame, d: tuple[Column, Column], cost: float, slope: float, store: Store, name: str, first: float = 1.0) -> tuple[float, float, DataFrame] | None:
    """The largest halving of ``first`` that lowers the cost enough, its cost and its gradient; the first step is judged alone, the rest in rounds."""
    at = 0
    while at < TRIES:
        ts = [first * 0.5**j for j in (range(at, at + 1) if at == 0 else range(at, min(at + ROUND, TRIES)))]
        table, e = trial_table(model, state, *d, ts, store, f"{name}-{at}")
        for r in sorted(table.collect(), key=lambda r: r["trial"]):  # a row per trial
            if r["cost"] <= cost + ARMIJO * r["t"] * slope:
                return r["t"], float(r["cost"]), e.gradient.where(c("trial") == r["trial"]).drop("trial")
        at += len(ts)
    return None


# ---- L-BFGS ----------------------------------------------------------------------------


def _two_loop(gg: float, sg: np.ndarray, yg: np.ndarray, sy: np.ndarray, yy: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """-H g as a sum over g and the pairs (s, y), oldest first, from dot products alone, and its slope.

    sy[i, j] = s_i y_j.  Pairs whose own product is not positive are left out.
    """
    used = [i for i in range(len(sg)) if sy[i, i] > 1e-12]
    cg, cs, cy = 1.0, np.zeros(len(sg)), np.zeros(len(sg))
    kept = {}
    for i in reversed(used):
        kept[i] = (cg * sg[i] + cy @ sy[i]) / sy[i, i]
        cy[i] -= kept[i]
    if used:
        scale = sy[used[-1], used[-1]] / yy[used[-1], used[-1]]
        cg, cy = cg * scale, cy * scale
    for i in used:
        cs[i] += kept[i] - (cg * yg[i] + cy @ yy[i] + cs @ sy[:, i]) / sy[i, i]
    return -cg, -cs, -cy, float(-(cg * gg + cs @ sg + cy @ yg))


def _over_pairs(v: str, cg: float, cs: np.ndarray, cy: np.ndarray) -> Column:
    """cg g + the sum of cs s + cy y over the pairs, in one coordinate."""
    factors = F.array(*(F.struct(F.lit(float(a)).alias("s"), F.lit(float(b)).alias("y")) for a, b in zip(cs, cy)))
    each = F.zip_with("hist", factors, lambda h, k: h[f"s{v}"] * k["s"] + h[f"y{v}"] * k["y"])
    return cg * c(f"g{v}") + F.aggregate(each, F.lit(0.0), lambda a, b: a + b)


def _direction(log: dict, n: int, nb_angles: int) -> tuple[Column, Column, float]:
    """The direction as columns of the state, and its slope."""
    m = len(log["sg"])
    cg, cs, cy, slope = _two_loop(log["gg"], *(np.array(log[k]) for k in ("sg", "yg")), np.array(log["sy"]).reshape(m, m), np.array(log["yy"]).reshape(m, m))
    if m == 0 or not any(cs) or slope >= 0:
        back = -n / nb_angles
        return back * c("gx"), back * c("gy"), back * log["gg"]
    dx, dy = (_over_pairs(v, cg, cs, cy) for v in "xy")
    return dx, dy, slope


_HIST = "array<struct<sx: double, sy: double, yx: double, yy: double>>"


def _dots(state: DataFrame, old: dict | None) -> dict:
    """The log's dot products after a step: sums by pair over one pass, the older pairs' own ones carried on."""
    new = F.element_at("hist", -1)
    h = F.posexplode("hist")
    rows = state.where(F.size("hist") > 0).select("gx", "gy", new.alias("n"), h.alias("j", "h"))
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1]
    g, s, y, ns, ny = (("gx", "gy"), ("h.sx", "h.sy"), ("h.yx", "h.yy"), ("n.sx", "n.sy"), ("n.yx", "n.yy"))
    g, s, y, ns, ny = (tuple(c(v) for v in pair) for pair in (g, s, y, ns, ny))
    sums = rows.groupBy("j").agg(*(F.sum(dot(a, b)).alias(k) for k, a, b in (("sg", s, g), ("yg", y, g), ("sy", s, ny), ("ys", ns, y), ("yy", y, ny)))).orderBy("j").collect()  # a row per pair
    gg = float(state.agg(F.sum(c("gx") ** 2 + c("gy") ** 2)).first()[0])
    m = len(sums)
    sy, yy = np.zeros((m, m)), np.zeros((m, m))
    if m:
        if old and (k := len(old["sg"])):
            lost = k + 1 - m  # pairs that left the memory
            for now, was in ((sy, old["sy"]), (yy, old["yy"])):
                now[: m - 1, : m - 1] = np.array(was).reshape(k, k)[lost:, lost:]
        sy[:, -1], sy[-1, :] = [r["sy"] for r in sums], [r["ys"] for r in sums]
        yy[:, -1] = yy[-1, :] = [r["yy"] for r in sums]
    return {"gg": gg, "sg": [r["sg"] for r in sums], "yg": [r["yg"] for r in sums], "sy": sy.ravel().tolist(), "yy": yy.ravel().tolist()}


def lbfgs(model: SlicedModel, points: DataFrame, steps: int = 50, memory: int = 10, ftol: float = 1e-9, store: Store | None = None, name: str = "lbfgs") -> Run:
    """Limited-memory quasi-Newton: a state holds each point's place, gradient and last steps with their changes of gradient."""
    store = store or model.store
    run = _Steps(store, name)
    n = points.count()
    if not run.logs:
        e = model.evaluate(with_trial(_located(points)), store=store, name=f"{name}-start")
        state = _located(points).join(e.gradient.drop("trial"), "dirac_id").withColumn("hist", F.array().cast(_HIST))
        state = store.put(f"{name}-state-0", state)
        run.finish({"step": 0, "cost": _cost(e), "t": 0.0, **_dots(state, None)})
    state = run.state()
    while len(run.logs) <= steps and not run.logs[-1].get("done"):
        log, k = run.logs[-1], len(run.logs)
        dx, dy, slope = _direction(log, n, model.g.nb_angles)
        got = _armijo(model, state, (dx, dy), log["cost"], slope, store, f"{name}-try-{k}")
        if got is None:
            if not log["sg"]:
                break
            # Without its pairs the state goes on along the gradient.
            state = state.withColumn("hist", F.array().cast(_HIST))
            dx, dy = (-n / model.g.nb_angles * c(v) for v in ("gx", "gy"))
            got = _armijo(model, state, (dx, dy), log["cost"], -n / model.g.nb_angles * log["gg"], store, f"{name}-back-{k}")
            if got is None:
                break
            log = {**log, "sg": [], "yg": [], "sy": [], "yy": []}
        t, cost, gradient = got
        new = gradient.select("dirac_id", c("gx").alias("hx"), c("gy").alias("hy"))
        step = F.struct((t * dx).alias("sx"), (t * dy).alias("sy"), (c("hx") - c("gx")).alias("yx"), (c("hy") - c("gy")).alias("yy"))
        hist = F.slice(F.concat("hist", F.array(step)), -min(memory, len(log["sg"]) + 1), memory)
        after = state.join(new, "dirac_id").select("dirac_id", (c("x") + t * dx).alias("x"), (c("y") + t * dy).alias("y"), c("hx").alias("gx"), c("hy").alias("gy"), hist.alias("hist"))
        store.drop(f"{name}-state-{k}")
        state = store.put(f"{name}-state-{k}", after)
        done = abs(log["cost"] - cost) <= ftol * max(abs(log["cost"]), abs(cost), 1.0)
        run.finish({"step": k, "cost": cost, "t": t, "done": done, **_dots(state, log)})
    return Run(state.select("dirac_id", "x", "y"), run.logs)


# ---- Newton on a subspace -----------------------------------------------------------------


def subspace_newton(model: Diracs, points: DataFrame, steps: int = 30, tikhonov: float = 1e-6, history: int = 4, ftol: float = 1e-10, store: Store | None = None, name: str = "newton") -> Run:
    """Newton on the span of the gradient and the last steps.

    The Hessian on two directions is their product with the angles' summed
    normal products, so all of them come from one pass over the points.
    """
    store = store or model.store
    run = _Steps(store, name)
    n = points.count()
    theta = np.arange(model.g.nb_angles) * np.pi / model.g.nb_angles
    nx, ny = np.cos(theta), np.sin(theta)
    cxx, cxy, cyy = float(nx @ nx), float(nx @ ny), float(ny @ ny)
    pair = "array<struct<x: double, y: double>>"
    if not run.logs:
        e = model.evaluate(with_trial(_located(points)), store=store, name=f"{name}-start")
        state = _located(points).join(e.gradient.drop("trial"), "dirac_id").withColumn("past", F.array().cast(pair))
        store.put(f"{name}-state-0", state)
        run.finish({"step": 0, "cost": _cost(e), "t": 0.0, "past": 0})
    state = run.state()
    while len(run.logs) <= steps and not run.logs[-1].get("done"):
        log, k = run.logs[-1], len(run.logs)
        m = log["past"] + 1
        basis = [(c("gx"), c("gy")), *((c("past")[i]["x"], c("past")[i]["y"]) for i in range(m - 1))]
        sums = [F.sum(2.0 / n * (cxx * a[0] * b[0] + cxy * (a[0] * b[1] + a[1] * b[0]) + cyy * a[1] * b[1])).alias(f"h{i}_{j}") for i, a in enumerate(basis) for j, b in enumerate(basis) if j >= i]
        slopes = [F.sum(c("gx") * a[0] + c("gy") * a[1]).alias(f"b{i}") for i, a in enumerate(basis)]
        sizes = [F.sqrt(F.sum(a[0] * a[0] + a[1] * a[1])).alias(f"l{i}") for i, a in enumerate(basis)]
        row = state.agg(*sums, *slopes, *sizes).first()
        size = np.maximum([row[f"l{i}"] for i in range(m)], 1e-300)
        if row["l0"] == 0:
            break
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) / np.outer(size, size)
        h = h + tikhonov * np.trace(h) / m * np.eye(m)
        b = np.array([row[f"b{i}"] for i in range(m)]) / size
        a = np.linalg.solve(h, -b)
        slope, factors = float(a @ b), a / size
        gg = row["b0"]
        back = -n / model.g.nb_angles
        if slope >= 0:
            factors, slope = np.array([back, *[0.0] * (m - 1)]), back * gg
        columns = lambda f: tuple(sum((float(v) * e[p] for v, e in zip(f[1:], basis[1:])), float(f[0]) * basis[0][p]) for p in (0, 1))
        d = columns(factors)
        got = _armijo(model, state, d, log["cost"], slope, store, f"{name}-try-{k}")
        if got is None:
            d = columns([back, *[0.0] * (m - 1)])
            got = _armijo(model, state, d, log["cost"], back * gg, store, f"{name}-back-{k}")
            if got is None:
                break
        t, cost, gradient = got
        new = gradient.select("dirac_id", c("gx").alias("hx"), c("gy").alias("hy"))
        step = F.struct((t * d[0]).alias("x"), (t * d[1]).alias("y"))
        after = state.join(new, "dirac_id").select("dirac_id", (c("x") + t * d[0]).alias("x"), (c("y") + t * d[1]).alias("y"), c("hx").alias("gx"), c("hy").alias("gy"), F.slice(F.concat(F.array(step), "past"), 1, history).alias("past"))
        store.drop(f"{name}-state-{k}")
        state = store.put(f"{name}-state-{k}", after)
        run.finish({"step": k, "cost": cost, "t": t, "past": min(history, m), "done": abs(log["cost"] - cost) < ftol})
    return Run(state.select("dirac_id", "x", "y"), run.logs)


# ---- scales ------------------------------------------------------------------------------------


def multiscale(sino: DataFrame, g: R.Geometry, points: DataFrame, final: int, factor: int = 4, steps: int = 20, tents: bool = False, tent_steps: int = 10, noise: float = 0.1, store: Store | None = None) -> Run:
    """Converge, split every point, keep min(n * factor, final) of them, until there are ``final``.

    With ``tents`` each scale ends with ``tent_steps`` on tents whose width follows the
    number of points.  A run's stages are named tables of the store: points of
    every scale are ``scale-k``, states and logs those of its optimizer, and a
    run that was stopped goes on with the first step that is not there.
    """
    store = store or Store(sino.sparkSession)
    x, history, k = _located(points), [], 0
    while True:
        n = x.count()
        stages = [("diracs", Diracs(sino, g, store), steps)]
        if tents:
            radius = 0.5 * g.extent / max(n, 1) ** 0.5
            stages.append(("tents", Tents(sino, g, radius, store), tent_steps))
        for stage, model, most in stages:
            run = lbfgs(model, x, most, ftol=0.0, store=store, name=f"{stage}-{k}")
            x = run.points
            history += [{"scale": k, "stage": stage, "n": n, "step": h["step"], "cost": h["cost"], "t": h["t"]} for h in run.history]
        if n >= final:
            return Run(x, history)
        apart = F.lit(noise * g.extent / max(n, 1) ** 0.5)
        kids = R.split_points(x, factor, apart)
        x = store.put(f"scale-{k + 1}", kids if n * factor <= final else R.subsample(kids, final))
        k += 1


def grid_round(model: SlicedModel, state: DataFrame, directions: list[tuple[Column, Column]], ranges: list[tuple[float, float]], per_axis: int = 5, store: Store | None = None) -> DataFrame:
    """(trial, t0, t1, .., cost): every combination of ``per_axis`` steps along two or three directions, judged in one plan."""
    axes = [np.linspace(a, b, per_axis) for a, b in ranges]
    ts = [tuple(float(axis[i]) for axis, i in zip(axes, at)) for at in np.ndindex(*(per_axis,) * len(axes))]
    names = [f"t{k}" for k in range(len(axes))]
    steps = state.sparkSession.createDataFrame([(j, *t) for j, t in enumerate(ts)], "trial int, " + ", ".join(f"{k} double" for k in names))
    at = state.select("dirac_id", "x", "y", *(v.alias(f"_{axis}{k}") for k, d in enumerate(directions) for axis, v in zip("xy", d))).join(F.broadcast(steps), F.lit(True))
    moved = at.select("trial", "dirac_id", *(sum((c(t) * c(f"_{axis}{k}") for k, t in enumerate(names)), c(axis)).alias(axis) for axis in "xy"))
    return model.evaluate(moved, len(ts), store=store).costs.join(F.broadcast(steps), "trial").select("trial", *names, "cost")


# ---- line searches ---------------------------------------------------------------------------


def conjugate(model: SlicedModel, points: DataFrame, steps: int = 30, method: str = "pr", ftol: float = 0.0, reach: int = 4, store: Store | None = None, name: str = "conjugate") -> Run:
    """Line searches along -gradient ("gd") or Polak-Ribiere directions ("pr").

    A round judges the last step's length times 2**-reach to 2**reach in one
    plan; the step goes to the bracket's vertex, or to the best trial where that
    is cheaper.
    """
    if method not in ("gd", "pr"):
        raise ValueError(f"no such method: {method}")
    store = store or model.store
    run = _Steps(store, name)
    zero = F.lit(0.0)
    if not run.logs:
        e = model.evaluate(with_trial(_located(points)), store=store, name=f"{name}-start")
        state = _located(points).join(e.gradient.drop("trial"), "dirac_id").select("*", zero.alias("dx"), zero.alias("dy"), zero.alias("px"), zero.alias("py"))
        state = store.put(f"{name}-state-0", state)
        mean = state.agg(F.avg(F.sqrt(c("gx") ** 2 + c("gy") ** 2))).first()[0]
        run.finish({"step": 0, "cost": _cost(e), "t": 0.01 * model.g.extent / max(float(mean), 1e-300)})
    state = run.state()
    while len(run.logs) <= steps and not run.logs[-1].get("done"):
        log, k = run.logs[-1], len(run.logs)
        beta = 0.0
        if method == "pr" and k > 1:
            r = state.agg(F.sum(c("gx") * (c("gx") - c("px")) + c("gy") * (c("gy") - c("py"))).alias("up"), F.sum(c("px") ** 2 + c("py") ** 2).alias("down")).first()
            beta = max(0.0, r["up"] / r["down"]) if r["down"] else 0.0
        dx, dy = beta * c("dx") - c("gx"), beta * c("dy") - c("gy")
        ts = [log["t"] * 2.0**j for j in range(-reach, reach + 1)]
        table, _ = trial_table(model, state, dx, dy, ts, store, f"{name}-round-{k}")
        best = bracketed(table).first()
        last, e = trial_table(model, state, dx, dy, sorted({best["vertex"], best["at"]}), store, f"{name}-end-{k}")
        r = min(last.collect(), key=lambda r: (r["cost"], r["t"]))  # two rows
        if not r["cost"] < log["cost"]:
            break
        new = e.gradient.where(c("trial") == r["trial"]).select("dirac_id", c("gx").alias("hx"), c("gy").alias("hy"))
        after = state.join(new, "dirac_id").select("dirac_id", (c("x") + r["t"] * dx).alias("x"), (c("y") + r["t"] * dy).alias("y"), c("hx").alias("gx"), c("hy").alias("gy"), dx.alias("dx"), dy.alias("dy"), c("gx").alias("px"), c("gy").alias("py"))
        store.drop(f"{name}-state-{k}")
        state = store.put(f"{name}-state-{k}", after)
        run.finish({"step": k, "cost": float(r["cost"]), "t": float(r["t"]), "done": abs(log["cost"] - r["cost"]) <= ftol * abs(log["cost"])})
    return Run(state.select("dirac_id", "x", "y"), run.logs)
