"""Point and disk reconstruction from sinograms: models, optimizers, line searches.

The sinogram stays a table; one cost or gradient is one Spark job in which each
angle's transport problem is a group.  Trial points travel to the executors as a
broadcast of 2n doubles, so neither projections nor trials are shuffled, and a
line search evaluates all its trial steps in one job.  Optimizers are driver
loops over NumPy vectors, as those are small beside the sinogram.
"""

from __future__ import annotations

import itertools
import math
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.operators.radon import Geometry

# ---- per-angle kernels ---------------------------------------------------------


def _pieces(pos: np.ndarray, w: np.ndarray, edges: np.ndarray, y: np.ndarray):
    """Sorted order, positions, and per piece: its point, cell, ends and mass."""
    order = np.argsort(pos, kind="stable")
    p = pos[order]
    wn = w[order] / w.sum()
    m = y * np.diff(edges)
    on = np.flatnonzero(m > 0)
    m = m[on] / m.sum()
    q = np.concatenate([[0.0], np.cumsum(wn)])
    cum = np.concatenate([[0.0], np.cumsum(m)])
    q[-1] = cum[-1] = 1.0
    cuts = np.sort(np.concatenate([q, cum]), kind="stable")  # two sorted runs; equal ends make empty pieces
    lo, hi = cuts[:-1], cuts[1:]
    k = np.minimum(np.searchsorted(q, lo, "right") - 1, len(p) - 1)
    cell = np.minimum(np.searchsorted(cum, lo, "right") - 1, len(on) - 1)
    x0, width = edges[on[cell]], np.diff(edges)[on[cell]]
    left, right = x0 + (lo - cum[cell]) / m[cell] * width, x0 + (hi - cum[cell]) / m[cell] * width
    return order, p, q, k, on[cell], left, right, hi - lo


def transport(pos: np.ndarray, w: np.ndarray, edges: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Cost and barycenters of weighted points (any order) against a density on consecutive cells.

    Both sides are normalized; every overlap of intervals in mass space is a piece.
    """
    order, p, _, k, _, left, right, dm = _pieces(pos, w, edges, y)
    a, b = left - p[k], right - p[k]
    cost = float((dm * (a * a + a * b + b * b) / 3).sum())
    m0 = np.bincount(k, dm, len(p))
    bary = np.empty(len(p))
    bary[order] = np.where(m0 > 0, np.bincount(k, dm * (left + right) / 2, len(p)) / np.where(m0 > 0, m0, 1), p)
    return cost, bary


def density_gradient(pos: np.ndarray, w: np.ndarray, edges: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Cost and its derivative by the raw density values, cells without mass included."""
    _, p, q, k, cell, left, right, dm = _pieces(pos, w, edges, y)
    ends = np.full(len(p), -np.inf)
    np.maximum.at(ends, k, right)
    jump = np.append((ends[:-1] - p[:-1]) ** 2 - (ends[:-1] - p[1:]) ** 2, (ends[-1] - p[-1]) ** 2)
    phi = np.cumsum(jump[::-1])[::-1]
    a, b = left - p[k], right - p[k]
    g = np.bincount(cell, (right - left) * ((a * a + a * b + b * b) / 3 - phi[k]), len(y))
    m = y * np.diff(edges)
    none = np.flatnonzero(m <= 0)
    level = np.concatenate([[0.0], np.cumsum(m)])[none] / m.sum()
    j = np.clip(np.searchsorted(q, level, "right") - 1, 0, len(p) - 1)
    c, d = edges[none] - p[j], edges[none + 1] - p[j]
    g[none] = (d - c) * ((c * c + c * d + d * d) / 3 - phi[j])
    cost = float((dm * (a * a + a * b + b * b) / 3).sum())
    return cost, (g - np.diff(edges) * (g * y).sum() / m.sum()) / m.sum()


def tent_density(s0: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(knots, height, slope, mass before) of a sum of tents of half-width r: linear between sorted knots."""
    knots = np.concatenate([s0 - r, s0, s0 + r])
    order = np.argsort(knots, kind="stable")
    knots = knots[order]
    slope = np.cumsum(np.repeat([1 / r, -2 / r, 1 / r], len(s0))[order])
    gap = np.diff(knots)
    height = np.concatenate([[0.0], np.cumsum(slope[:-1] * gap)])
    before = np.concatenate([[0.0], np.cumsum(height[:-1] * gap + slope[:-1] * gap * gap / 2)])
    return knots, height, slope, before


def tent_transport(s0: np.ndarray, r: float, edges: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Cost and its gradient by s0: bin centers with masses y to a sum of tents of half-width r.

    In mass space: the bins' levels are looked up among the masses at the
    density's knots, and knots and levels together cut the line into pieces of
    one bin and one linear height each.  Cost and gradient are running sums of
    the pieces' polynomials.
    """
    knots, height, slope, before = tent_density(s0, r)
    whole = before[-1]
    m = y * np.diff(edges)
    level = np.cumsum(m)[:-1] / m.sum() * whole
    # Where the density has given each level: the root of a quadratic inside its segment.
    k = np.clip(np.searchsorted(before, level, "right") - 1, 0, len(knots) - 2)
    rest = np.maximum(level - before[k], 0.0)
    lift = height[k] + np.sqrt(np.maximum(height[k] ** 2 + 2 * slope[k] * rest, 0.0))
    spot = np.clip(knots[k] + np.divide(2 * rest, lift, out=np.zeros_like(rest), where=lift > 0), knots[k], knots[k + 1])
    u = np.concatenate([knots, spot])
    order = np.argsort(u, kind="stable")
    u = u[order]
    seg = np.clip(np.cumsum(order < len(knots)) - 1, 0, len(knots) - 2)
    bins = np.cumsum(order >= len(knots))
    u, v, seg, bins = u[:-1], u[1:], seg[:-1], bins[:-1]
    center = ((edges[:-1] + edges[1:]) / 2)[bins]
    p, q = u - center, v - center
    # Height as a + b z about the bin's center.
    b = slope[seg]
    a = height[seg] - b * (knots[seg] - center)
    cost = float((a * (q**3 - p**3) / 3 + b * (q**4 - p**4) / 4).sum()) / whole
    # The potential's derivative is 2 (z - center); each tent takes the second difference of its second antiderivative.
    first = np.concatenate([[0.0], np.cumsum(q * q - p * p)])
    second = np.concatenate([[0.0], np.cumsum((first[:-1] - p * p) * (v - u) + (q**3 - p**3) / 3)])
    at = np.searchsorted(np.append(u, v[-1]), np.stack([s0 - r, s0, s0 + r]), "left")
    low, mid, high = second[np.minimum(at, len(second) - 1)]
    return cost, (low - 2 * mid + high) / (r * whole)


#: Disks of one block of disk_profile and of the gradient's chords: bounds their disks x bins arrays.
DISK_BLOCK = 2_048


def disk_profile(s0: np.ndarray, r: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of the disks' chords, integrated per bin and divided by its width; in blocks of disks."""
    total = np.zeros(len(edges))
    for k in range(0, len(s0), DISK_BLOCK):
        own = r[k : k + DISK_BLOCK, None]
        t = np.clip(edges[None, :] - s0[k : k + DISK_BLOCK, None], -own, own)
        total += (t * np.sqrt(np.maximum(own**2 - t**2, 0)) + own**2 * np.arcsin(np.clip(t / own, -1, 1))).sum(0)
    return np.diff(total) / np.diff(edges)


# ---- models -----------------------------------------------------------------------


#: Bytes of trial points that are broadcast at once; more trials go one by one.
MOST_TRIAL_BYTES = 256 << 20


class Model(ABC):
    """cost over trials of points; value_and_grad; floor, the least loss it can reach."""

    def __init__(self, sino: DataFrame, g: Geometry):
        self.g, self.spark = g, sino.sparkSession
        # One row per angle: its profile as an array, dealt over tasks once.
        rows = sino.groupBy("angle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin_id", "value"))), lambda s: s["value"]).alias("y"))
        parts = max(1, min(g.nb_angles, self.spark.sparkContext.defaultParallelism))
        self.rows = rows.repartition(parts, "angle_id").persist()
        self.edges = g.s_min + g.dw * np.arange(g.nb_bins + 1)
        self.evaluations = 0

    @abstractmethod
    def angle(self, s: np.ndarray, y: np.ndarray, grad: bool) -> tuple[float, np.ndarray]:
        """Cost of one angle at projections s, and its derivative by s."""

    def floor(self) -> float:
        return 0.0

    def radii(self, points: np.ndarray) -> np.ndarray:
        """The radius with which each point is drawn; 0 for points without extent."""
        return np.full(len(points), getattr(self, "radius", 0.0))

    def wrap(self, points: np.ndarray) -> DataFrame:
        """Positions as a table (dirac_id, x, y, r)."""
        columns = [np.arange(len(points)), points[:, 0], points[:, 1], self.radii(points)]
        return self.spark.createDataFrame(pa.table([pa.array(col) for col in columns], ["dirac_id", "x", "y", "r"]))

    def _job(self, trials: list[np.ndarray], with_grad: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Costs of all trials, and the gradients of the first ``with_grad`` of them."""
        if sum(p.nbytes for p in trials) > MOST_TRIAL_BYTES:
            parts = [self._job([p], int(k < with_grad)) for k, p in enumerate(trials)] if len(trials) > 1 else None
            if parts is None:
                raise ValueError("the points are too many to be sent to every task; operators.sliced has models without a broadcast of points")
            return np.concatenate([c for c, _ in parts]), [g for _, gs in parts for g in gs]
        shared = self.spark.sparkContext.broadcast(trials)  # 2n doubles a trial, bounded above
        n_angles, model_angle = self.g.nb_angles, self.angle
        self.evaluations += len(trials)

        def run(batches):
            pts = shared.value
            cost, total = np.zeros(len(pts)), [np.zeros_like(p) for p in pts[:with_grad]]
            for b in batches:
                for k, y in zip(b.column("angle_id").to_pylist(), b.column("y")):
                    th, profile = k * math.pi / n_angles, y.values.to_numpy()
                    normal = np.array([math.cos(th), math.sin(th)])
                    for j, p in enumerate(pts):
                        v, d = model_angle(p @ normal, profile, j < with_grad)
                        cost[j] += v
                        if j < with_grad:
                            total[j] += d[:, None] * normal
            yield pa.RecordBatch.from_arrays([pa.array([cost.tobytes()], pa.binary()), pa.array([b"".join(t.tobytes() for t in total)], pa.binary())], ["cost", "grad"])

        got = self.rows.mapInArrow(run, "cost binary, grad binary").collect()  # a row per task
        shared.destroy()
        cost = np.sum([np.frombuffer(r["cost"]) for r in got], axis=0)
        grads = np.sum([np.frombuffer(r["grad"]) for r in got], axis=0).reshape(with_grad, *trials[0].shape) if with_grad else []
        return cost, list(grads)

    def costs(self, trials: list[np.ndarray]) -> np.ndarray:
        """Costs of several point sets of one size, in one job."""
        return self._job(trials, 0)[0]

    def cost(self, points: np.ndarray) -> float:
        return float(self.costs([points])[0])

    def value_and_grad(self, points: np.ndarray) -> tuple[float, np.ndarray]:
        v, g = self._job([points], 1)
        return float(v[0]), g[0]

    def costs_and_first_grad(self, trials: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Costs of all trials and the gradient at the first, in one job: what a line search mostly needs next."""
        v, g = self._job(trials, 1)
        return v, g[0]


class DiracModel(Model):
    """Points of equal weight carried to each angle's density."""

    def angle(self, s, y, grad):
        w = np.full(len(s), 1 / len(s))
        cost, bary = transport(s, w, self.edges, y)
        return cost, 2 * w * (s - bary)

    def __getstate__(self):
        return {"edges": self.edges}

    def subspace(self, points: np.ndarray, directions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hessian and slope of the cost on the span of directions."""
        _, g = self.value_and_grad(points)
        th = np.arange(self.g.nb_angles) * math.pi / self.g.nb_angles
        normal = np.stack([np.cos(th), np.sin(th)])
        e = [d @ normal for d in directions]
        h = np.array([[2 / len(points) * float((a * b).sum()) for b in e] for a in e])
        return h, np.array([float((g * d).sum()) for d in directions])


class DiskModel(Model):
    """Disks of one radius: their gridded projection is the density, the sinogram's bins the points."""

    def __init__(self, sino: DataFrame, g: Geometry, radius: float):
        super().__init__(sino, g)
        self.radius = radius

    def floor(self) -> float:
        return self.g.nb_angles * self.g.dw**2 / 12

    def angle(self, s, y, grad):
        r = np.full(len(s), self.radius)
        density = disk_profile(s, r, self.edges)
        centers = (self.edges[:-1] + self.edges[1:]) / 2
        on = y > 0
        if density.sum() <= 0:
            # No disk is in the field: beyond any cost inside it, and less the nearer they are.
            off = s.mean() - (centers * y).sum() / y.sum()
            return float(off**2 + self.g.extent**2), np.full(len(s), 2 * off / len(s))
        if not grad:
            return transport(centers[on], y[on], self.edges, density)[0], np.zeros(0)
        cost, by_density = density_gradient(centers[on], y[on], self.edges, density)
        # Differences of chords against the density's gradient, as chords against its differences.
        step = -np.diff(np.concatenate([[0.0], by_density / np.diff(self.edges), [0.0]]))
        out = [2 * np.sqrt(np.maximum(self.radius**2 - (self.edges[None, :] - s[k : k + DISK_BLOCK, None]) ** 2, 0)) @ step for k in range(0, len(s), DISK_BLOCK)]
        return cost, -np.concatenate(out)

    def __getstate__(self):
        return {"edges": self.edges, "radius": self.radius, "g": self.g}


class TentModel(Model):
    """Continuous tents of half-width radius in place of disks."""

    def __init__(self, sino: DataFrame, g: Geometry, radius: float):
        super().__init__(sino, g)
        self.radius = radius

    def angle(self, s, y, grad):
        return tent_transport(s, self.radius, self.edges, y)

    def __getstate__(self):
        return {"edges": self.edges, "radius": self.radius}


#: Models by name; ``make_model`` leaves out what one does not take.
MODELS: dict[str, type[Model]] = {"diracs": DiracModel, "disks": DiskModel, "tents": TentModel}


def make_model(name: str, sino: DataFrame, g: Geometry, radius: float | None = None) -> Model:
    if name not in MODELS:
        raise ValueError(f"no such model: {name}; there are {', '.join(MODELS)}")
    if name == "diracs":
        return DiracModel(sino, g)
    if radius is None:
        raise ValueError(f"{name} need a radius")
    return MODELS[name](sino, g, radius)


# ---- optimizers ---------------------------------------------------------------------

Step = Callable[[int, np.ndarray, float], None]


def gradient_descent(model: Model, x: np.ndarray, steps: int = 100, rate: float = 0.5, on_step: Step | None = None) -> np.ndarray:
    """Fixed steps along the gradient of the mean over points."""
    for k in range(steps):
        v, g = model.value_and_grad(x)
        x = x - rate * len(x) * g / model.g.nb_angles
        on_step and on_step(k, x, v)
    return x


def armijo(model: Model, x: np.ndarray, v: float, g: np.ndarray, d: np.ndarray, step: float, c1: float = 1e-4, tries: int = 20) -> tuple[float, float, bool, np.ndarray | None]:
    """The largest halving of ``step`` that lowers the cost enough; several are tried in one job.

    Also the gradient there, where the job has it: at the first trial of a job.
    """
    slope = float((g * d).sum())
    for at in range(0, tries, 4):
        ts = [step * 0.5 ** (at + j) for j in range(min(4, tries - at))]
        costs, grad = model.costs_and_first_grad([x + t * d for t in ts])
        for j, (t, c) in enumerate(zip(ts, costs)):
            if c <= v + c1 * t * slope:
                return t, float(c), True, grad if j == 0 else None
    return step * 0.5**tries, v, False, None


def line_search_descent(model: Model, x: np.ndarray, steps: int = 50, rate: float | None = None, on_step: Step | None = None) -> np.ndarray:
    t = rate or 1.0
    g = None
    for k in range(steps):
        if g is None:
            v, g = model.value_and_grad(x)
        d = -len(x) * g / model.g.nb_angles
        t, v, _, g = armijo(model, x, v, g, d, 2 * t)
        x = x + t * d
        on_step and on_step(k, x, v)
    return x


def adam(model: Model, x: np.ndarray, steps: int = 100, rate: float = 0.1, clip: float | None = None, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, on_step: Step | None = None) -> np.ndarray:
    m, s = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        v, g = model.value_and_grad(x)
        size = float(np.linalg.norm(g))
        if clip is not None and size > clip:
            g = g * (clip / size)
        m, s = b1 * m + (1 - b1) * g, b2 * s + (1 - b2) * g * g
        x = x - rate * (m / (1 - b1**k)) / (np.sqrt(s / (1 - b2**k)) + eps)
        on_step and on_step(k - 1, x, v)
    return x


def two_loop(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """-H g from the stored (step, change of gradient) pairs."""
    q, kept = g.copy(), []
    for s, y in reversed(pairs):
        a = float((s * q).sum()) / float((s * y).sum())
        kept.append(a)
        q = q - a * y
    if pairs:
        s, y = pairs[-1]
        q = q * (float((s * y).sum()) / float((y * y).sum()))
    for (s, y), a in zip(pairs, reversed(kept)):
        q = q + s * (a - float((y * q).sum()) / float((s * y).sum()))
    return -q


def lbfgs(model: Model, x: np.ndarray, steps: int = 50, min_iter: int = 0, ftol: float = 1e-9, disp_tol: float | None = None, memory: int = 10, on_step: Step | None = None) -> np.ndarray:
    """min_iter steps without a stopping test, then until ftol or disp_tol is met."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    v, g = model.value_and_grad(x)
    for k in range(steps):
        d = two_loop(g, pairs) if pairs else -len(x) * g / model.g.nb_angles
        if float((d * g).sum()) >= 0:
            pairs, d = [], -len(x) * g / model.g.nb_angles
        t, nv, ok, ng = armijo(model, x, v, g, d, 1.0)
        if not ok:
            if not pairs:
                break
            pairs = []
            continue
        new = x + t * d
        if ng is None:
            nv, ng = model.value_and_grad(new)
        s, y = new - x, ng - g
        if float((s * y).sum()) > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = k >= min_iter and (abs(v - nv) <= ftol * max(abs(v), abs(nv), 1.0) or disp_tol is not None and float(np.abs(s).max()) < disp_tol)
        x, v, g = new, nv, ng
        on_step and on_step(k, x, v)
        if done:
            break
    return x


def subspace_newton(model: DiracModel, x: np.ndarray, steps: int = 30, tikhonov: float = 1e-6, history: int = 4, ftol: float = 1e-10, on_step: Step | None = None) -> np.ndarray:
    """Newton on the span of the gradient and the last real steps."""
    past: list[np.ndarray] = []
    last = math.inf
    for k in range(steps):
        v, g = model.value_and_grad(x)
        size = float(np.linalg.norm(g))
        if size == 0 or abs(last - v) < ftol:
            break
        basis = [g / size, *(p / max(np.linalg.norm(p), 1e-300) for p in past[::-1])]
        h, b = model.subspace(x, basis)
        h = h + tikhonov * np.trace(h) / len(h) * np.eye(len(h))
        d = sum(a * e for a, e in zip(np.linalg.solve(h, -b), basis))
        if float((d * g).sum()) >= 0:
            d = -len(x) * g / model.g.nb_angles
        t, _, ok, _ = armijo(model, x, v, g, d, 1.0)
        if not ok:
            d = -len(x) * g / model.g.nb_angles
            t, _, _, _ = armijo(model, x, v, g, d, 1.0)
        x = x + t * d
        past = [*past, t * d][-history:]
        last = v
        on_step and on_step(k, x, v)
    return x


# ---- line searches ----------------------------------------------------------------------


def bracket(f: Callable[[list[float]], np.ndarray], a: float, tries: int = 30) -> tuple[float, np.ndarray]:
    """a with f(a/2) the least of f(0), f(a/2), f(a): doubled or halved until it is."""
    y = f([0.0, a / 2, a])
    for _ in range(tries):
        if y[1] <= y[0] and y[1] <= y[2]:
            break
        a = 2 * a if y[2] < y[1] else a / 2
        y = f([0.0, a / 2, a])
    return a, y


def vertex(a: float, y: np.ndarray, slope: float | None = None) -> float:
    """The least point on [0, a] of the parabola (or the cubic with slope at 0) through f(0), f(a/2), f(a)."""
    if slope is not None:
        # f(0), f'(0), f(a/2), f(a) fix p(t) = y0 + slope t + q t^2 + k t^3
        h = a / 2
        m = np.array([[h * h, h**3], [a * a, a**3]])
        q, k = np.linalg.solve(m, np.array([y[1] - y[0] - slope * h, y[2] - y[0] - slope * a]))
        disc = q * q - 3 * k * slope
        if abs(k) > 1e-300 and disc >= 0:
            t = (-q + math.sqrt(disc)) / (3 * k)
            if 0 <= t <= a:
                return t
    den = y[0] - 2 * y[1] + y[2]
    if den <= 0:
        return a / 2
    return float(min(max(a / 4 * (3 * y[0] - 4 * y[1] + y[2]) / den, 0.0), a))


def conjugate(model: Model, x: np.ndarray, steps: int = 30, method: str = "pr", ftol: float = 0.0, plateau: float = 0.0, on_step: Step | None = None) -> np.ndarray:
    """Bracketed line searches along -gradient ("gd") or Polak-Ribiere directions ("pr")."""
    a = d = g0 = last = None
    for k in range(steps):
        v, g = model.value_and_grad(x)
        a = a or 0.01 * model.g.extent / max(float(np.linalg.norm(g, axis=1).mean()), 1e-300)
        beta = max(0.0, float((g * (g - g0)).sum()) / float((g0 * g0).sum())) if method == "pr" and g0 is not None else 0.0
        d = -g + beta * d if d is not None else -g
        if float((d * g).sum()) >= 0:
            d = -g
        a, y = bracket(lambda ts: model.costs([x + t * d for t in ts]), a)
        t = vertex(a, y, float((g * d).sum()))
        x, a, g0 = x + t * d, 2 * t or a, g
        on_step and on_step(k, x, v)
        if last is not None and last - v <= max(ftol, plateau * abs(last)):
            break
        last = v
    return x


def grid_search(model: Model, x: np.ndarray, dirs: list[np.ndarray], boxes: list[tuple[float, float]], n: int = 15, grow: int = 4) -> tuple[list[float], float]:
    """Least cost over steps along 2 or 3 directions, one job per grid.

    The next grid is centered on the best place so far, twice as wide where
    that lies on the rim and as wide as before elsewhere, until it is inside
    or ``grow`` grids are used; a step along the first direction stays positive.
    The place is then polished.
    """
    lo, hi = (np.array(b, float) for b in zip(*boxes))
    least, found = math.inf, (lo + hi) / 2
    for _ in range(grow + 1):
        places = np.array(list(itertools.product(*(np.linspace(a, b, n) for a, b in zip(lo, hi)))))
        cost = model.costs([x + np.tensordot(ts, np.stack(dirs), 1) for ts in places])
        if cost.min() < least:
            least, found = float(cost.min()), places[int(cost.argmin())]
        rim = np.minimum(found - lo, hi - found) < (hi - lo) / (2 * n)
        rim[0] &= found[0] > lo[0] + (hi[0] - lo[0]) / (2 * n)  # zero step is a bound, not a rim
        if not rim.any():
            break
        half = (hi - lo) / 2 * np.where(rim, 2.0, 1.0)
        lo, hi = np.where(rim, found - half, lo), np.where(rim, found + half, hi)
        lo[0] = max(lo[0], 0.0)
    return nelder_mead(lambda ts: model.costs([x + np.tensordot(np.asarray(p), np.stack(dirs), 1) for p in ts]), found, list(np.maximum((hi - lo) / (n - 1), 1e-12)), list(zip(lo, hi)))


def nelder_mead(f: Callable[[list[np.ndarray]], np.ndarray], start: np.ndarray, size: list[float], boxes: list[tuple[float, float]], steps: int = 60, xtol: float = 1e-6, ytol: float = 1e-10) -> tuple[list[float], float]:
    """A bounded simplex search; reflection, expansion and both contractions are tried in one job."""
    lo, hi = (np.array(b) for b in zip(*boxes))
    p = [np.array(start, float)] + [np.clip(np.array(start) + s * e, lo, hi) for s, e in zip(size, np.eye(len(start)))]
    y = list(f(p))
    for _ in range(steps):
        o = np.argsort(y, kind="stable")
        p, y = [p[i] for i in o], [float(y[i]) for i in o]
        if max(np.abs(q - p[0]).max() for q in p) <= xtol * max(1.0, float(hi[0])) and abs(y[-1] - y[0]) <= ytol:
            break
        mid = np.mean(p[:-1], axis=0)
        new = [np.clip(mid + k * (mid - p[-1]), lo, hi) for k in (1.0, 2.0, 0.5, -0.5)]
        v = f(new)
        pick = 1 if v[0] < y[0] and v[1] < v[0] else 0 if v[0] < y[-2] else 2 if v[0] < y[-1] and v[2] <= v[0] else 3 if v[3] < y[-1] else None
        if pick is None:
            p = [p[0]] + [p[0] + (q - p[0]) / 2 for q in p[1:]]
            y = [y[0], *f(p[1:])]
        else:
            p[-1], y[-1] = new[pick], v[pick]
    k = int(np.argmin(y))
    return list(p[k]), float(y[k])


def fitted_minimum(at: np.ndarray, y: np.ndarray, v: float, slope: np.ndarray) -> np.ndarray | None:
    """The least point of the quadratic with value v and slope at 0 that fits probes best; None unless it is convex.

    at: probes x directions.  Any number of probes from the quadratic's number
    of free coefficients on.
    """
    k = at.shape[1]
    i, j = np.triu_indices(k)
    terms = at[:, i] * at[:, j] / np.where(i == j, 2.0, 1.0)
    coef = np.linalg.lstsq(terms, y - v - at @ slope, rcond=None)[0]
    h = np.zeros((k, k))
    h[i, j] = h[j, i] = coef
    return -np.linalg.solve(h, slope) if np.linalg.eigvalsh(h)[0] > 1e-12 * abs(h).max() else None


def plane_search(model: Model, x: np.ndarray, steps: int = 20, probes: int = 8, third: bool = False, seed: int = 0, on_step: Step | None = None) -> np.ndarray:
    """Steps in the plane of the descent direction and the last step (the first time a seeded one), or in 3-D with a seeded axis.

    Probes on an ellipse, in one job, give a quadratic by least squares; its
    least point, kept within twice the probes, competes with the probes.
    """
    rng, last, reach = np.random.default_rng(seed), None, None
    for k in range(steps):
        v, g = model.value_and_grad(x)
        size = max(float(np.linalg.norm(g)), 1e-300)
        random = lambda: (d := rng.standard_normal(g.shape)) / np.linalg.norm(d)
        dirs = [-g / size, last if last is not None else random(), *([random()] if third else [])]
        reach = reach or 0.01 * model.g.extent * math.sqrt(len(x))
        at = rng.standard_normal((probes, len(dirs)))
        at = reach * at / np.linalg.norm(at, axis=1)[:, None]
        at[0] = [reach, *([0.0] * (len(dirs) - 1))]
        y = model.costs([x + np.tensordot(t, np.stack(dirs), 1) for t in at])
        best = fitted_minimum(at, y, v, np.array([float((g * d).sum()) for d in dirs]))
        if best is not None:
            best = np.clip(best, -2 * reach, 2 * reach)
            at, y = np.vstack([at, best]), np.append(y, model.cost(x + np.tensordot(best, np.stack(dirs), 1)))
        pick = int(np.argmin(y))
        on_step and on_step(k, x, v)
        if y[pick] >= v:
            reach /= 4
            continue
        move = np.tensordot(at[pick], np.stack(dirs), 1)
        x, length = x + move, float(np.linalg.norm(move))
        last, reach = move / length, max(length, reach / 2)
    return x


def grid_descent(model: Model, x: np.ndarray, steps: int = 10, third: bool = False, n: int = 9, seed: int = 0, on_step: Step | None = None) -> np.ndarray:
    """A grid search as a run: along the descent direction, the last step and, in 3-D, a seeded axis."""
    rng, last, reach = np.random.default_rng(seed), None, None
    for k in range(steps):
        v, g = model.value_and_grad(x)
        size = max(float(np.linalg.norm(g)), 1e-300)
        random = lambda: (d := rng.standard_normal(g.shape)) / np.linalg.norm(d)
        dirs = [-g / size, last if last is not None else random(), *([random()] if third else [])]
        reach = reach or 0.02 * model.g.extent * math.sqrt(len(x))
        t, best = grid_search(model, x, dirs, [(0.0, 2 * reach), *([(-reach, reach)] * (len(dirs) - 1))], n)
        on_step and on_step(k, x, v)
        if best >= v:
            break
        move = np.tensordot(np.asarray(t), np.stack(dirs), 1)
        x, length = x + move, float(np.linalg.norm(move))
        last, reach = move / length, max(length, 1e-12)
    return x


# ---- reconstruction -----------------------------------------------------------------------


def random_points(n: int, extent: float, seed: int = 0, normal: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(0, extent / 6, (n, 2)) if normal else rng.uniform(-extent / 2, extent / 2, (n, 2))


def split(x: np.ndarray, factor: int, extent: float, noise: float = 0.1, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    kids = np.repeat(x, factor, axis=0)
    return kids + rng.uniform(-1, 1, kids.shape) * noise * extent / math.sqrt(max(1, len(x)))


@dataclass
class Reconstruction:
    """Points, history (one row a step) and frames; stages chain."""

    sino: DataFrame
    g: Geometry
    points: np.ndarray | None = None
    seed: int = 0
    history: list[dict] = field(default_factory=list)
    frames: list[np.ndarray] = field(default_factory=list)

    def set_points(self, x) -> Reconstruction:
        self.points = np.asarray(x, float).reshape(-1, 2)
        return self

    def set_sinogram(self, sino: DataFrame) -> Reconstruction:
        self.sino = sino
        return self

    def random_points(self, n: int, normal: bool = False) -> Reconstruction:
        return self.set_points(random_points(n, self.g.extent, self.seed, normal))

    def split(self, factor: int, noise: float = 0.1) -> Reconstruction:
        self.seed += 1
        return self.set_points(split(self.points, factor, self.g.extent, noise, self.seed))

    def subsample(self, k: int) -> Reconstruction:
        if k < len(self.points):
            self.seed += 1
            self.points = self.points[np.sort(np.random.default_rng(self.seed).choice(len(self.points), k, replace=False))]
        return self

    def run(self, model: Model, optimizer=lbfgs, stage: str = "", callback: Step | None = None, **how) -> Reconstruction:
        """One stage; step -1 is the start, and a frame that repeats the last one is not kept."""
        began, offset = time.time(), self.history[-1]["step"] + 1 if self.history else 0
        start = model.cost(self.points)
        if not self.frames or not np.array_equal(self.frames[-1], self.points):
            self.frames.append(self.points.copy())
        callback and callback(-1, self.points, start)
        self.history.append({"step": offset, "stage": stage, "loss": start, "n": len(self.points), "seconds": 0.0})

        def on_step(k, x, v):
            self.history.append({"step": offset + 1 + k, "stage": stage, "loss": v, "n": len(x), "seconds": time.time() - began})
            self.frames.append(x.copy())
            callback and callback(k, x, v)

        self.points = optimizer(model, self.points, on_step=on_step, **how)
        return self

    def diracs(self, **how) -> Reconstruction:
        return self.run(DiracModel(self.sino, self.g), stage="diracs", **how)

    def disks(self, radius: float, split_before: int = 1, tents: bool = False, **how) -> Reconstruction:
        if split_before > 1:
            self.split(split_before)
        return self.run((TentModel if tents else DiskModel)(self.sino, self.g, radius), stage="tents" if tents else "disks", **how)

    def multiscale(self, final: int, factor: int = 4, stage_callback=None, tents: bool = False, **how) -> Reconstruction:
        """Converge, split, keep min(n * factor, final) points, until final is reached."""
        k = 0
        while True:
            self.diracs(**how)
            if tents:
                self.disks(0.5 * self.g.extent / math.sqrt(len(self.points)), tents=True, steps=10, ftol=0.0)
            stage_callback and stage_callback(k, self)
            if len(self.points) >= final:
                return self
            self.split(factor).subsample(final)
            k += 1

    def loss(self) -> float:
        return DiracModel(self.sino, self.g).cost(self.points)

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "step int, stage string, loss double, n int, seconds double")


def compare(sino: DataFrame, g: Geometry, start: np.ndarray, optimizers: dict[str, tuple]) -> list[dict]:
    """Each optimizer from one start: (name, step, loss, seconds) rows."""
    rows = []
    for name, (opt, how) in optimizers.items():
        r = Reconstruction(sino, g).set_points(start).run(DiracModel(sino, g), opt, stage=name, **how)
        rows += [{"optimizer": name, **h} for h in r.history]
    return rows
