"""A registry of experiments with typed parameters, and the scans and runs that are registered."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from massflow.operators import mesh as Q
from massflow.operators import radon as R
from massflow.operators import reconstruct as X


@dataclass(frozen=True)
class Param:
    """A typed parameter: its default, and what it may be."""

    kind: type
    default: object
    choices: tuple = ()

    def read(self, text: object) -> object:
        value = str(text).lower() in ("1", "true", "yes") if self.kind is bool and isinstance(text, str) else self.kind(text)
        if self.choices and value not in self.choices:
            raise ValueError(f"{value!r} is none of {self.choices}")
        return value


@dataclass
class Registry:
    """name -> (description, parameters, function(spark, **values) -> list of rows)."""

    known: dict[str, tuple[str, dict[str, Param], Callable]] = field(default_factory=dict)

    def add(self, description: str, **params: Param) -> Callable[[Callable], Callable]:
        def keep(f: Callable) -> Callable:
            if f.__name__ in self.known:
                raise ValueError(f"{f.__name__} is there already")
            self.known[f.__name__] = (description, params, f)
            return f

        return keep

    def combinations(self, name: str, args: list[str]) -> list[dict]:
        """Every combination of ``--key=a,b`` values, in their types, the rest at their defaults."""
        _, params, _ = self.known[name]
        lists = {k: [p.default] for k, p in params.items()}
        for a in args:
            key, eq, values = a.removeprefix("--").partition("=")
            if not a.startswith("--") or not eq or key not in params:
                raise ValueError(f"{name} has no parameter {a!r}")
            lists[key] = [params[key].read(v) for v in values.split(",")]
        return [dict(zip(lists, row)) for row in itertools.product(*lists.values())]

    def run(self, spark: SparkSession, name: str, args: list[str] | None = None) -> DataFrame:
        """A row per result row of every combination, with the combination's values in front."""
        _, params, f = self.known[name]
        rows = [{**values, **row} for values in self.combinations(name, args or []) for row in f(spark, **values)]
        kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
        names = list(dict.fromkeys(k for r in rows for k in r)) or list(params)
        sample = {k: next((r[k] for r in rows if k in r and r[k] is not None), "") for k in names}
        return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"{k} {kinds[type(sample[k])]}" for k in names))


REGISTRY = Registry()


def profile(model: X.Model, x: np.ndarray, direction: np.ndarray, steps: list[float]) -> list[dict]:
    """Costs along a direction, in one job, beside the parabola through three of them: how quadratic the cost is there."""
    cost = model.costs([x + t * direction for t in steps])
    three = [0, len(steps) // 2, len(steps) - 1]
    fit = np.polyfit([steps[i] for i in three], cost[three], 2)
    return [{"step": float(t), "cost": float(v), "parabola": float(np.polyval(fit, t))} for t, v in zip(steps, cost)]


def direction_scan(model: X.Model, x: np.ndarray, directions: dict[str, np.ndarray], steps: list[float]) -> list[dict]:
    """The best step and cost along each named direction, and its cosine with the descent direction."""
    v, g = model.value_and_grad(x)
    out = []
    for name, d in directions.items():
        cost = model.costs([x + t * d for t in steps])
        best = int(np.argmin(cost))
        size = float(np.linalg.norm(d) * np.linalg.norm(g))
        out.append({"direction": name, "start": v, "step": float(steps[best]), "cost": float(cost[best]), "cosine": float(-(d * g).sum()) / size if size else 0.0})
    return out


def _one_disk(spark: SparkSession, nb_angles: int, nb_bins: int) -> tuple[DataFrame, R.Geometry]:
    from massflow.sources.phantoms import disks

    g = R.Geometry(nb_angles, nb_bins, 6.0)
    return R.radon_disks(disks(spark, [(0.3, -0.2, 1.0, 1.0)]), g.angles(spark), g).persist(), g


@REGISTRY.add("points first, then disks from where they are", points=Param(int, 20), steps=Param(int, 4), radius=Param(float, 0.3))
def two_phases(spark: SparkSession, points: int, steps: int, radius: float) -> list[dict]:
    sino, g = _one_disk(spark, 8, 101)
    r = X.Reconstruction(sino, g).random_points(points).diracs(optimizer=X.lbfgs, steps=steps).disks(radius, optimizer=X.lbfgs, steps=steps)
    return [{"stage": h["stage"], "step_no": h["step"], "loss": float(h["loss"])} for h in r.history]


@REGISTRY.add("cost along the descent direction", points=Param(int, 40), seed=Param(int, 1), longest=Param(float, 20.0))
def parabola_profile(spark: SparkSession, points: int, seed: int, longest: float) -> list[dict]:
    sino, g = _one_disk(spark, 8, 101)
    m, x = X.DiracModel(sino, g), X.random_points(points, g.extent, seed)
    return profile(m, x, -m.value_and_grad(x)[1], list(np.linspace(0.0, longest, 9)))


@REGISTRY.add("solve a truncated field again from the last weights", again=Param(int, 10), tv=Param(float, 3e-3))
def warm_start(spark: SparkSession, again: int, tv: float) -> list[dict]:
    from massflow.sources.phantoms import disks

    g = R.Geometry(24, 96, 4.0)
    sino = R.radon_disks(disks(spark, [(0.2, -0.1, 0.6, 1.0), (2.6, 0.4, 0.5, 1.0)]), g.angles(spark), g).persist()
    m = Q.GradedMesh(spark, g, outer=4.0, cell=0.25, max_level=3, nb_coarse=48)
    out = []
    for how in ("cold", "warm"):
        m.solve(sino, tv=tv, nb_iter=again, warm=how == "warm")
        out.append({"start": how, "misfit": float(np.linalg.norm(m.apply(m.weights) - m.coarse(sino))), "mass": m.interior_mass()})
    return out
