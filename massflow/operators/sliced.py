"""Costs and gradients of sliced models as table plans.

points: (trial, dirac_id, x, y); trial numbers point sets that are judged in one
plan, from 0.  A batch is one angle of one trial.  Neither points nor gradients
pass through the driver: projections and slices are made in arrays inside the
tasks, between sorts and grouped sums, and what is sent around is numbers per
angle and bin or cell, whose size is checked.  Angles come in batches; a
batch's sums are written, so a run that was stopped goes on with the next one.
"""

from __future__ import annotations

import itertools
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massflow.functions.prefix import WINDOW_ROWS
from massflow.functions.stored import Store
from massflow.operators import radon as R
from massflow.operators import transport as T
from massflow.operators.radon import Geometry

c = F.col
#: Numbers of all trials' angles and bins that are broadcast at most at once; more make more batches of angles.
MOST_BROADCAST = 4_000_000


def with_trial(points: DataFrame, trial: Column | int = 0) -> DataFrame:
    return points.select((F.lit(trial) if isinstance(trial, int) else trial).cast("int").alias("trial"), "dirac_id", "x", "y")


def buckets_of(rows: int) -> int:
    """Buckets (a power of two) that bound the windows of batches of so many rows."""
    k = 1
    while k * WINDOW_ROWS < rows:
        k *= 2
    return k


#: Cells of a grid on which positions are counted first, and those that each cell with too many is cut into.
CELLS = 1024
#: Sums of a batch's grid, about.
GRID_NUMBERS = 7 * CELLS
#: Runs of one batch, at most: a run is numbered batch * MOST_BUCKETS + its place in the batch.
MOST_BUCKETS = 1 << 32


def _normals(angles: DataFrame) -> list[tuple[int, float, float]]:
    return [(r["angle_id"], r["nx"], r["ny"]) for r in angles.collect()]  # a row per angle


def _placed(points: DataFrame) -> DataFrame:
    return points.select("trial", "dirac_id", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))


def _gaps(b: pa.RecordBatch) -> np.ndarray:
    """Whether each point lacks a coordinate."""
    return b.column("x").is_null().to_numpy(zero_copy_only=False) | b.column("y").is_null().to_numpy(zero_copy_only=False)


def _seen(b: pa.RecordBatch, normals: list, nb_angles: int):
    """(batch, rows, positions) of the points of each trial under each angle; points without a place come first, at -inf."""
    trial, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in ("trial", "x", "y"))
    gaps = _gaps(b)
    for t in np.unique(trial):
        rows = np.flatnonzero(trial == t)
        for k, nx, ny in normals:
            yield int(t) * nb_angles + k, rows, np.where(gaps[rows], -np.inf, x[rows] * nx + y[rows] * ny)


def _tally(points: DataFrame, normals: list, nb_angles: int, knots: tuple, borders: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per batch and cell: knots, sums of jump * z^k for k = 0..3, squares and number of points.

    A knot stands at a point's position plus its shift.  Tasks add up in arrays.
    """
    names = [f"s{k}" for k in range(7)]

    def run(batches):
        total = {}
        for b in batches:
            for batch, _, s in _seen(b, normals, nb_angles):
                edges = borders[batch]
                own = total.setdefault(batch, np.zeros((7, len(edges) + 1)))
                gaps = ~np.isfinite(s)
                for shift, jump in knots:
                    z = s + shift
                    cell = np.searchsorted(edges, z, "right")
                    own[0] += np.bincount(cell, minlength=len(edges) + 1)
                    z = np.where(gaps, 0.0, z)
                    for k in range(4):
                        own[1 + k] += np.bincount(cell, np.where(gaps, 0.0, jump * z**k), len(edges) + 1)
                    if shift == 0:
                        own[5] += np.bincount(cell, z * z, len(edges) + 1)
                        own[6] += np.bincount(cell, ~gaps, len(edges) + 1)
        for batch, own in total.items():
            cell = np.flatnonzero(own[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), batch)), pa.array(cell), *(pa.array(v[cell]) for v in own)], ["batch", "cell", *names])

    rows = points.mapInArrow(run, "batch long, cell long, " + ", ".join(f"{k} double" for k in names))
    got = rows.groupBy("batch", "cell").agg(*(F.sum(k).alias(k) for k in names)).toArrow()  # batches x cells at most
    sums = {batch: np.zeros((len(edges) + 1, 7)) for batch, edges in borders.items()}
    batch, cell = got["batch"].to_numpy(), got["cell"].to_numpy()
    values = np.stack([got[k].to_numpy() for k in names], 1)
    for k in np.unique(batch):
        sums[int(k)][cell[batch == k]] = values[batch == k]
    return sums


def _grid(points: DataFrame, normals: list, g: Geometry, trials: int, knots: tuple, wanted) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Borders and sums of cells, per batch, of which no wanted one holds more than WINDOW_ROWS knots but at a single place.

    Cells are even over the field and widen beyond it; a cell with too many is
    cut into as many again.  Nothing but sums per cell leaves a task.
    """
    size = F.abs("x") + F.abs("y")
    reach = points.where(size < float("inf")).agg(F.max(size)).first()[0] or 0.0
    reach = reach + 2 * max(abs(shift) for shift, _ in knots)
    field = min(reach, abs(g.center) + g.extent)
    out = np.geomspace(field, reach, 65) if reach > field else np.array([field])
    even = np.unique(np.concatenate([-out, np.linspace(-field, field, CELLS + 1), out]))
    borders = {t * g.nb_angles + k: even for t in range(trials) for k, _, _ in normals}
    while True:
        sums = _tally(points, normals, g.nb_angles, knots, borders)
        finer = {}
        for batch, edges in borders.items():
            heavy = [j for j in np.unique(wanted(batch, edges, sums[batch])) if sums[batch][j, 0] > WINDOW_ROWS and 0 < j < len(edges)]
            more = np.concatenate([edges, *(np.linspace(edges[j - 1], edges[j], CELLS + 1)[1:-1] for j in heavy)])
            if len(more := np.unique(more)) > len(edges):
                finer[batch] = more
        if not finer:
            return borders, sums
        borders = borders | finer


def _slices(pos: np.ndarray, q0: np.ndarray, q1: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost of each point's slice [q0, q1] of the mass, the point less the slice's mean, and whether it has mass."""
    x0, x1, m, c0 = cells
    c1 = np.append(c0[1:], 1.0)
    lo = np.maximum(np.searchsorted(c0, q0, "right") - 1, 0)
    n = np.maximum(np.searchsorted(c0, q1, "left") - lo, 1)
    row = np.repeat(np.arange(len(pos)), n)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
    since, until = np.maximum(q0[row], c0[cell]), np.minimum(q1[row], c1[cell])
    dm = np.maximum(until - since, 0.0)
    slope = (x1[cell] - x0[cell]) / m[cell]
    left, right = x0[cell] + (since - c0[cell]) * slope, x0[cell] + (until - c0[cell]) * slope
    a, b = left - pos[row], right - pos[row]
    add = lambda v: np.bincount(row, v, len(pos))
    m0 = add(dm)
    full = m0 > 0
    mean = add(dm * (left + right) / 2) / np.where(full, m0, 1.0)
    return add(dm * (a * a + a * b + b * b) / 3), pos - mean, full


def _mass_cells(edges: np.ndarray, sums: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cell of each mass q: the last whose start has at most q before it."""
    a0, a1, a2 = (np.cumsum(sums[:, k])[:-1] for k in (1, 2, 3))  # of the knots before each border
    mass = np.maximum.accumulate(np.maximum((edges * edges * a0 - 2 * edges * a1 + a2) / 2, 0.0))
    return np.maximum(np.searchsorted(mass, q, "right"), 1)


def _spots(z: np.ndarray, jump: np.ndarray, start: float, end: float | None, before: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where the mass reaches each q inside a cell, and the first moment up to there; before: the sums ahead of the cell, end: none after the last knot."""
    z, at = np.unique(z, return_inverse=True)
    z, jump = np.append(start, z), np.append(0.0, np.bincount(at, jump, len(z)))
    a = before[:, None] + np.cumsum(jump * z ** np.arange(4)[:, None], axis=1)  # with the knot
    ahead = a - jump * z ** np.arange(4)[:, None]
    mass = np.maximum((z * z * ahead[0] - 2 * z * ahead[1] + ahead[2]) / 2, 0.0)
    k = np.maximum(np.searchsorted(np.maximum.accumulate(mass), q, "right") - 1, 0)
    after = np.append(z[1:], z[-1] if end is None else end)
    z, a0, a1, _, a3 = z[k], *a[:, k]
    height, rest = z * a0 - a1, np.maximum(q - mass[k], 0.0)
    lift = height + np.sqrt(np.maximum(height * height + 2 * a0 * rest, 0.0))
    v = np.where(lift > 0, np.minimum(z + 2 * rest / np.where(lift > 0, lift, 1.0), after[k]), z)
    return np.stack([v, v**3 * a0 / 3 - v**2 * a1 / 2 + a3 / 6])


@dataclass(frozen=True)
class Evaluation:
    """costs: (trial, cost); gradient: (trial, dirac_id, gx, gy)."""

    costs: DataFrame
    gradient: DataFrame


class SlicedModel(ABC):
    """A cost of points against a sinogram (angle_id, bin_id, value), summed over the angles."""

    def __init__(self, sino: DataFrame, g: Geometry, store: Store | None = None):
        self.spark, self.g = sino.sparkSession, g
        self.store = store or Store(self.spark)
        self.sino = self.store.put("sinogram", sino.select("angle_id", "bin_id", "value"))
        self.angles = g.angles(self.spark)

    def floor(self) -> float:
        return 0.0

    def batch(self) -> Column:
        return (c("trial") * self.g.nb_angles + c("angle_id")).cast("long")

    def _unbatched(self, df: DataFrame) -> DataFrame:
        """df with trial, angle_id and the normal of its batch."""
        n = self.g.nb_angles
        at = df.withColumn("trial", F.floor(c("batch") / n).cast("int")).withColumn("angle_id", F.pmod("batch", F.lit(n)).cast("int"))
        return at.join(F.broadcast(self.angles.select("angle_id", "nx", "ny")), "angle_id")

    def _targets(self, angles: DataFrame, trials: int) -> DataFrame:
        """The sinogram once a trial."""
        return self.sino.join(F.broadcast(angles.select("angle_id")), "angle_id").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))

    def numbers(self, n: int) -> int:
        """Numbers that are sent around for each angle of a trial of n points, about."""
        return self.g.nb_bins + 1

    @abstractmethod
    def part(self, points: DataFrame, angles: DataFrame, trials: int, n: int) -> DataFrame:
        """(trial, dirac_id, cost, gx, gy) summed over some angles; costs that belong to no point have a null dirac_id."""

    def evaluate(self, points: DataFrame, trials: int = 1, angle_batches: int | None = None, store: Store | None = None, name: str | None = None, n: int | None = None) -> Evaluation:
        """Costs and gradients of all trials, each of n points (counted where not given).

        Sums of each batch of angles are written under ``name`` in ``store``;
        those that are there already are not made again.
        """
        store, name = store or self.store, name or f"evaluation-{id(points)}-{self._calls()}"
        if n is None:
            n = points.groupBy("trial").count().agg(F.max("count")).first()[0] or 0
        most = trials * self.numbers(n) * self.g.nb_angles
        k = min(self.g.nb_angles, angle_batches or -(-most // MOST_BROADCAST))
        parts = []
        for b in range(k):
            if not store.has(f"{name}-{b}of{k}"):
                angles = self.angles.where(c("angle_id") % k == b)
                store.put(f"{name}-{b}of{k}", self.part(points, angles, trials, n))
            parts.append(store.get(f"{name}-{b}of{k}"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        costs = rows.groupBy("trial").agg(F.sum("cost").alias("cost"))
        gradient = rows.where("dirac_id IS NOT NULL").select("trial", "dirac_id", "gx", "gy")
        if k > 1:
            gradient = gradient.groupBy("trial", "dirac_id").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
        return Evaluation(costs, gradient)

    def _calls(self) -> int:
        self.calls = getattr(self, "calls", 0) + 1
        return self.calls


class Diracs(SlicedModel):
    """Points of equal weight carried to each angle's density.

    A point's slice of the mass follows from its rank in its batch.  Positions
    are counted on a grid first where a batch is large, so that ranks come from
    sorts of bounded runs; a position is shuffled once, and its gradient once.
    """

    def numbers(self, n):
        return max(self.g.nb_bins + 1, GRID_NUMBERS if n > WINDOW_ROWS else 0)

    def part(self, points, angles, trials, n):
        if not self.store.has("cumulated"):
            self.store.put("cumulated", T.cell_cum_mass(self.g.density(self.sino), buckets_of(self.g.nb_bins)))
        nb, share = self.g.nb_angles, 1.0 / max(n, 1)
        rows = self.store.get("cumulated").where("m > 0").join(F.broadcast(angles.select(c("angle_id").alias("batch"))), "batch").orderBy("batch", "x0", "cell_id").select("batch", "x0", "x1", "m", "c0").collect()  # angles x bins
        cells = {k: np.array([r[1:] for r in own]).T for k, own in itertools.groupby(rows, lambda r: r["batch"])}
        normals = _normals(angles)
        borders, buckets, first = {}, {}, {}
        if n > WINDOW_ROWS:
            borders, sums = _grid(_placed(points), normals, self.g, trials, ((0.0, 1.0),), lambda batch, edges, sums: np.arange(len(edges) + 1))
            for batch, per in sums.items():
                before = np.cumsum(per[:, 0]) - per[:, 0]
                buckets[batch] = (before // WINDOW_ROWS).astype(np.int64)
                for run, at in zip(*np.unique(buckets[batch], return_index=True)):
                    first[batch * MOST_BUCKETS + int(run)] = int(before[at])
        id_type = points.schema["dirac_id"].dataType.simpleString()

        def place(batches):
            for b in batches:
                ids, null = b.column("dirac_id"), _gaps(b)
                for batch, rows, s in _seen(b, normals, nb):
                    run = np.full(len(s), batch * MOST_BUCKETS)
                    if batch in buckets:
                        run += buckets[batch][np.searchsorted(borders[batch], s, "right")]
                    yield pa.RecordBatch.from_arrays([pa.array(run), ids.take(pa.array(rows)), pa.array(s, mask=null[rows])], ["run", "dirac_id", "pos"])

        def carry(batches):
            last, done = -1, 0
            for b in batches:
                runs, ids, pos = b.column("run").to_numpy(), b.column("dirac_id"), b.column("pos").to_numpy(zero_copy_only=False)
                null = b.column("pos").is_null().to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.diff(runs, prepend=runs[:1] - 1))
                for lo, hi in zip(starts, [*starts[1:], len(runs)]):
                    run = int(runs[lo])
                    done = done if run == last else first.get(run, 0)
                    batch, rank, last = run // MOST_BUCKETS, done + np.arange(hi - lo), run
                    done += hi - lo
                    if batch % nb not in cells:
                        continue
                    cost, grad, full = _slices(pos[lo:hi], rank * share, np.minimum((rank + 1) * share, 1.0), cells[batch % nb])
                    skip = null[lo:hi]
                    on = pa.array(np.flatnonzero(full))
                    grads = pa.array(2 * share * grad, mask=skip).take(on)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), batch)), ids.slice(lo, hi - lo).take(on), grads, pa.nulls(len(on), pa.float64())], ["batch", "dirac_id", "grad", "cost"])
                    yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.nulls(1, ids.type), pa.nulls(1, pa.float64()), pa.array([cost[full & ~skip].sum()])], ["batch", "dirac_id", "grad", "cost"])

        at = _placed(points).mapInArrow(place, f"run long, dirac_id {id_type}, pos double").repartition("run").sortWithinPartitions("run", "pos", "dirac_id")
        # Dealt by the point before its sums: a task of the sort has few of a point's angles, which partial sums would only hold.
        per = self._unbatched(at.mapInArrow(carry, f"batch long, dirac_id {id_type}, grad double, cost double").repartition("dirac_id"))
        return per.groupBy("trial", "dirac_id").agg(F.sum("cost").alias("cost"), F.sum(c("grad") * c("nx")).alias("gx"), F.sum(c("grad") * c("ny")).alias("gy"))


class Disks(SlicedModel):
    """Disks of one radius: their gridded projection is the density, the sinogram's bins are the points."""

    def __init__(self, sino: DataFrame, g: Geometry, radius: float, store: Store | None = None):
        super().__init__(sino, g, store)
        self.radius = radius

    def floor(self) -> float:
        return self.g.nb_angles * self.g.dw**2 / 12

    def part(self, points, angles, trials, n):
        g, r = self.g, F.lit(self.radius)
        at = R.project_points(points, angles).select(self.batch().alias("batch"), "dirac_id", c("s").alias("s0"))
        lo, hi = (R._clip(g.edge(c("bin_id") + k) - c("s0"), r) for k in (0, 1))
        chords = at.withColumn("bin_id", F.explode(R._shadow(c("s0"), r, g)))
        made = self.store.keep(chords.groupBy("batch", "bin_id").agg((F.sum(R.chord_integral(hi, r) - R.chord_integral(lo, r)) / g.dw).alias("value")).where("value > 0"))  # angles x bins
        t = g.density(made.withColumnRenamed("batch", "angle_id"))
        d = g.points(self._targets(angles, trials).where("value > 0").withColumn("angle_id", self.batch()))
        k = buckets_of(g.nb_bins)
        seen = made.select("batch").distinct()
        shown = d.join(F.broadcast(seen), "batch", "left_semi")
        costs = T.cost(T.pieces(shown, t, k))
        # The derivative by a projection: chords at the edges times the steps of the derivative by the density.
        by_density = T.grad_density(shown, t, k)
        rows = by_density.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("cell_id", "grad"))).alias("by"))  # nb_bins at most
        value = lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0.0))
        steps = rows.select("batch", F.transform(F.sequence(F.lit(0), F.lit(g.nb_bins)), lambda e: (value(e) - value(e - 1)) / g.dw).alias("step"))
        edges = R._shadow(c("s0"), r, g)
        chord = lambda u: 2 * F.sqrt(F.greatest(F.lit(self.radius**2) - u * u, F.lit(0.0)))
        edges = F.concat(edges, F.array(F.element_at(edges, -1) + 1))
        slope = F.when(F.size(R._shadow(c("s0"), r, g)) == 0, 0.0).otherwise(F.aggregate(edges, F.lit(0.0), lambda a, e: a + chord(g.edge(e) - c("s0")) * F.element_at("step", e + 1)))
        moved = self._unbatched(at.join(F.broadcast(steps), "batch").select("batch", "dirac_id", slope.alias("grad")))
        sums = [F.sum(c("grad") * c("nx")).alias("gx"), F.sum(c("grad") * c("ny")).alias("gy")]
        own = moved.groupBy("trial", "dirac_id").agg(*sums).select("trial", "dirac_id", F.lit(0.0).alias("cost"), "gx", "gy")
        out = own.unionByName(self._cost_rows(costs))
        # A batch with no disk in its field costs more than any inside it, and less the nearer the disks are.
        if made.select("batch").distinct().count() == trials * angles.count():
            return out
        center = d.groupBy("batch").agg((F.sum(c("pos") * c("w")) / F.sum("w")).alias("center"))
        lost = at.join(F.broadcast(seen), "batch", "left_anti")
        off = lost.groupBy("batch").agg(F.avg("s0").alias("mean"), F.count(F.lit(1)).alias("n")).join(center, "batch").select("batch", "n", (c("mean") - c("center")).alias("off"))
        pulled = self._unbatched(lost.join(F.broadcast(off), "batch").select("batch", "dirac_id", (2 * c("off") / c("n")).alias("grad")))
        far = off.select("batch", (c("off") ** 2 + g.extent**2).alias("cost"))
        own = own.unionByName(pulled.groupBy("trial", "dirac_id").agg(*sums).select("trial", "dirac_id", F.lit(0.0).alias("cost"), "gx", "gy"))
        own = own.groupBy("trial", "dirac_id").agg(F.sum("cost").alias("cost"), F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
        return own.unionByName(self._cost_rows(costs)).unionByName(self._cost_rows(far))

    def _cost_rows(self, costs: DataFrame) -> DataFrame:
        zero = F.lit(0.0)
        return costs.select(F.floor(c("batch") / self.g.nb_angles).cast("int").alias("trial"), F.lit(None).cast("long").alias("dirac_id"), "cost", zero.alias("gx"), zero.alias("gy"))


class Tents(SlicedModel):
    """Continuous tents of half-width radius: a density that is linear between its knots, and the sinogram's bins as points.

    Height, mass and first moment up to a knot are polynomials in it whose
    coefficients are running sums of the knots' jumps of slope.  A bin's level
    is looked up among the masses, and the place inside the knot's segment is
    the root of a quadratic.  These places, one per angle and bin, give the cost
    from moments and each tent's gradient as a second difference.

    Knots are summed on a grid in the tasks; only those in cells that hold a
    level are shuffled and sorted.  Gradients are made point by point.
    """

    def __init__(self, sino: DataFrame, g: Geometry, radius: float, store: Store | None = None):
        super().__init__(sino, g, store)
        self.radius = radius

    def numbers(self, n):
        return max(self.g.nb_bins + 1, GRID_NUMBERS)

    def part(self, points, angles, trials, n):
        g, r, nb = self.g, self.radius, self.g.nb_angles
        whole, normals, points = n * r, _normals(angles), _placed(points)
        rows = self.sino.join(F.broadcast(angles.select("angle_id")), "angle_id").orderBy("angle_id", "bin_id").select("angle_id", "bin_id", "value").collect()  # angles x bins
        bins, level, share = {}, {}, {}
        for k, own in itertools.groupby(rows, lambda r: r["angle_id"]):
            bins[k], w = np.array([r[1:] for r in own]).T
            if not w.sum() > 0:
                raise ValueError(f"angle {k} of the sinogram has no mass")
            level[k], share[k] = np.cumsum(w) / w.sum(), w / w.sum()
        jumps = ((-r, 1 / r), (0.0, -2 / r), (r, 1 / r))

        def holding(batch, edges, sums):
            """The cell of each level: the last one at whose start the mass is at most the level's."""
            return _mass_cells(edges, sums, level[batch % nb] * whole)

        borders, sums = _grid(points, normals, g, trials, jumps, holding)
        wanted, spots = {}, {}
        for batch, per in sums.items():
            edges, before = borders[batch], np.cumsum(per, axis=0) - per
            at, later = holding(batch, edges, per), per[::-1, 0].cumsum()[::-1] - per[:, 0]
            spots[batch] = np.empty((2, len(at)))
            for cell in np.unique(at):
                start, end = edges[max(cell - 1, 0)], edges[cell] if later[cell] else None
                on = np.flatnonzero(at == cell)
                task = (start, end, before[cell, 1:5], level[batch % nb][on] * whole)
                if per[cell, 0]:
                    wanted[batch, int(cell)] = (on, task)
                else:
                    spots[batch][:, on] = _spots(np.zeros(0), np.zeros(0), *task)

        def picked(batches):
            chosen = {batch: np.zeros(len(e) + 1, bool) for batch, e in borders.items()}
            for batch, cell in wanted:
                chosen[batch][cell] = True
            for b in batches:
                for batch, _, s in _seen(b, normals, nb):
                    for shift, jump in jumps:
                        z = (s + shift)[np.isfinite(s)]
                        cell = np.searchsorted(borders[batch], z, "right")
                        on = chosen[batch][cell]
                        z, at, n = np.unique(z[on], return_index=True, return_counts=True)  # points that share a place send one knot
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), batch)), pa.array(cell[on][at]), pa.array(z), pa.array(n * jump)], ["batch", "cell", "z", "jump"])

        def looked_up(table):
            batch, cell = table["batch"][0].as_py(), table["cell"][0].as_py()
            on, task = wanted[batch, cell]
            found = _spots(table["z"].to_numpy(), table["jump"].to_numpy(), *task)
            return pa.table({"batch": np.full(len(on), batch), "at": on, "spot": found[0], "first": found[1]})

        knots = points.mapInArrow(picked, "batch long, cell long, z double, jump double")
        for row in knots.groupBy("batch", "cell").applyInArrow(looked_up, "batch long, at long, spot double, first double").collect():  # angles x bins
            spots[row["batch"]][:, row["at"]] = row["spot"], row["first"]
        costs, lists = [], {}
        for batch, (spot, moment) in spots.items():
            k = batch % nb
            center = g.s_min + (bins[k] + 0.5) * g.dw
            linear = (center * center * share[k] * whole - 2 * center * np.diff(moment, prepend=0.0)).sum()
            costs.append((batch // nb, None, float((linear + r * (sums[batch][:, 5].sum() + sums[batch][:, 6].sum() * r * r / 6)) / whole), 0.0, 0.0))
            lists[batch] = np.sort(spot[bins[k] < g.nb_bins - 1])
        middle, dw = g.s_min + 0.5 * g.dw, g.dw

        def slopes(batches):
            for b in batches:
                total = np.zeros((2, b.num_rows))
                direction = {k: (nx, ny) for k, nx, ny in normals}
                for batch, rows, s in _seen(b, normals, nb):
                    for at in range(0, len(rows), R.AT_ONCE):
                        x = s[at : at + R.AT_ONCE]
                        bend = np.zeros(len(x))
                        for spot in lists[batch]:
                            v = x - spot
                            bend += np.maximum(v - r, 0) ** 2 - 2 * np.maximum(v, 0) ** 2 + np.maximum(v + r, 0) ** 2
                        slope = (2 * r * r * (x - middle) - dw * bend) / (r * whole)
                        total[:, rows[at : at + R.AT_ONCE]] += np.outer(direction[batch % nb], slope)
                yield pa.RecordBatch.from_arrays([b.column("trial"), b.column("dirac_id"), *(pa.array(v, mask=_gaps(b)) for v in total)], ["trial", "dirac_id", "gx", "gy"])

        id_type = points.schema["dirac_id"].dataType.simpleString()
        made = points.mapInArrow(slopes, f"trial int, dirac_id {id_type}, gx double, gy double")
        own = made.groupBy("trial", "dirac_id").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy")).select("trial", "dirac_id", F.lit(0.0).alias("cost"), "gx", "gy")
        return own.unionByName(self.spark.createDataFrame(costs, "trial int, dirac_id long, cost double, gx double, gy double"))


#: Models by name; disks and tents take a radius.
MODELS: dict[str, type[SlicedModel]] = {"diracs": Diracs, "disks": Disks, "tents": Tents}


def make_model(name: str, sino: DataFrame, g: Geometry, radius: float | None = None, store: Store | None = None) -> SlicedModel:
    if name not in MODELS:
        raise ValueError(f"no such model: {name}; there are {', '.join(MODELS)}")
    if name == "diracs":
        return Diracs(sino, g, store)
    if radius is None:
        raise ValueError(f"{name} need a radius")
    return MODELS[name](sino, g, radius, store)
