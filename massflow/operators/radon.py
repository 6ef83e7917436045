"""Radon projection of points and disks, and sinogram algebra.

angles: (angle_id, theta, nx, ny); sinogram: (angle_id, bin_id, value);
disks: (disk_id, cx, cy, r, rho).  Bin edges are arithmetic on bin_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
#: Small tables of at most this many rows are broadcast; larger ones are joined otherwise.
SMALL = 100_000


@dataclass(frozen=True)
class Geometry:
    """Detector: angles k pi / nb_angles, bins of width extent / nb_bins about a center."""

    nb_angles: int
    nb_bins: int
    extent: float
    center: float = 0.0

    def __post_init__(self):
        if self.nb_angles < 1 or self.nb_bins < 1 or not self.extent > 0 or not isinstance(self.center, (int, float)):
            raise ValueError("a sinogram needs angles, bins, a positive extent and a scalar center")

    @property
    def dw(self) -> float:
        return self.extent / self.nb_bins

    @property
    def s_min(self) -> float:
        return self.center - self.extent / 2

    def angles(self, spark: SparkSession) -> DataFrame:
        rows = [(k, k * math.pi / self.nb_angles, math.cos(k * math.pi / self.nb_angles), math.sin(k * math.pi / self.nb_angles)) for k in range(self.nb_angles)]
        return spark.createDataFrame(rows, "angle_id int, theta double, nx double, ny double")

    def edge(self, k: Column) -> Column:
        return self.s_min + k * self.dw

    def bins(self) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(self.nb_bins - 1)))

    def empty(self, spark: SparkSession) -> DataFrame:
        return self.angles(spark).select("angle_id", self.bins().alias("bin_id"), F.lit(0.0).alias("value"))

    def density(self, sino: DataFrame) -> DataFrame:
        """The sinogram as one density per angle."""
        return sino.select(c("angle_id").alias("batch"), c("bin_id").alias("cell_id"), self.edge(c("bin_id")).alias("x0"), self.edge(c("bin_id") + 1).alias("x1"), c("value").alias("y"))

    def points(self, sino: DataFrame) -> DataFrame:
        """The sinogram as weighted diracs at bin centers."""
        return sino.select(c("angle_id").alias("batch"), c("bin_id").alias("dirac_id"), self.edge(c("bin_id") + 0.5).alias("pos"), c("value").alias("w"))


def project_points(points: DataFrame, angles: DataFrame) -> DataFrame:
    """points x angles with s = x nx + y ny.  angles is the small, generated side."""
    return points.join(F.broadcast(angles), F.lit(True)).withColumn("s", c("x") * c("nx") + c("y") * c("ny"))


def _shadow(s0: Column, r: Column, g: Geometry) -> Column:
    """The bins that [s0 - r, s0 + r] meets; an empty list outside the detector."""
    lo = F.greatest(F.floor((s0 - r - g.s_min) / g.dw), F.lit(0)).cast("int")
    hi = F.least(F.ceil((s0 + r - g.s_min) / g.dw) - 1, F.lit(g.nb_bins - 1)).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _clip(x: Column, r: Column) -> Column:
    return F.least(F.greatest(x, -r), r)


def chord_integral(t: Column, r: Column) -> Column:
    """Antiderivative of the chord length 2 sqrt(r^2 - t^2)."""
    return t * F.sqrt(F.greatest(r * r - t * t, F.lit(0.0))) + r * r * F.asin(F.least(F.greatest(t / r, F.lit(-1.0)), F.lit(1.0)))


def tent_integral(v: Column, r: Column) -> Column:
    """Antiderivative of a tent of height 1 and half-width r."""
    return F.when(v <= 0, v + v * v / (2 * r) + r / 2).otherwise(r / 2 + v - v * v / (2 * r))


def _chord_array(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``chord_integral`` on arrays."""
    return t * np.sqrt(np.maximum(r * r - t * t, 0.0)) + r * r * np.arcsin(np.clip(t / r, -1.0, 1.0))


def _tent_array(v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``tent_integral`` on arrays."""
    return np.where(v <= 0, v + v * v / (2 * r) + r / 2, r / 2 + v - v * v / (2 * r))


#: Disks whose shadows are made at once: a few hundred KB an array.
AT_ONCE = 2048


def _project(disks: DataFrame, angles: DataFrame, g: Geometry, integral) -> DataFrame:
    """Sums per angle and bin; each task adds its disks up, so a row of a disk and a bin is never made."""
    normals = [(r["angle_id"], r["nx"], r["ny"]) for r in angles.collect()]  # a row per angle
    nb, dw, s_min = g.nb_bins, g.dw, g.s_min

    def run(batches):
        total = np.zeros((len(normals), nb))
        for b in batches:
            cx, cy, r, rho = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            order = np.argsort(r, kind="stable")  # shadows of about one width together
            for at in range(0, len(order), AT_ONCE):
                part = order[at : at + AT_ONCE]
                x, y, radius, weight = cx[part], cy[part], r[part][:, None], rho[part][:, None]
                for k, (_, nx, ny) in enumerate(normals):
                    s0 = x * nx + y * ny
                    # A bin more on both sides: a tangent's rounding counts as in the sum over all bins.
                    lo = np.clip(np.floor((s0 - radius[:, 0] - s_min) / dw) - 1, 0, nb).astype(np.int64)
                    hi = np.clip(np.ceil((s0 + radius[:, 0] - s_min) / dw) + 1, 0, nb).astype(np.int64)
                    width = int((hi - lo).max(initial=0))
                    if width <= 0:
                        continue
                    edge = lo[:, None] + np.arange(width + 1)
                    under = integral(np.clip(s_min + edge * dw - s0[:, None], -radius, radius), radius)
                    # Beyond a disk's shadow its steps are 0; those beyond the detector are cut.
                    step = weight * np.diff(under, axis=1) / dw
                    total[k] += np.bincount(np.minimum(edge[:, :-1], nb).ravel(), step.ravel(), nb + 1)[:nb]
        at, col = np.nonzero(total)
        ids = np.array([a for a, _, _ in normals], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int32()), pa.array(col.astype(np.int32)), pa.array(total[at, col])], ["angle_id", "bin_id", "value"])

    rows = disks.select(*(c(k).cast("double").alias(k) for k in ("cx", "cy", "r", "rho"))).dropna().where("r > 0")
    made = rows.mapInArrow(run, "angle_id int, bin_id int, value double").groupBy("angle_id", "bin_id").agg(F.sum("value").alias("value"))
    return g.empty(disks.sparkSession).drop("value").join(made, ["angle_id", "bin_id"], "left").select("angle_id", "bin_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def radon_disks(disks: DataFrame, angles: DataFrame, g: Geometry) -> DataFrame:
    """Exact chord lengths integrated per bin; only bins in a disk's shadow are made."""
    return _project(disks, angles, g, _chord_array)


def radon_tents(disks: DataFrame, angles: DataFrame, g: Geometry) -> DataFrame:
    return _project(disks, angles, g, _tent_array)


def add_disks(sino: DataFrame, disks: DataFrame, angles: DataFrame, g: Geometry) -> DataFrame:
    made = radon_disks(disks, angles, g).withColumnRenamed("value", "more")
    return sino.join(made, ["angle_id", "bin_id"]).select("angle_id", "bin_id", (c("value") + c("more")).alias("value"))


def disk_gradient(disks: DataFrame, angles: DataFrame, g: Geometry) -> DataFrame:
    """(disk_id, angle_id, bin_id, gx, gy): derivative of each bin's value by the disk's center."""
    normals = [(r["angle_id"], r["nx"], r["ny"]) for r in angles.collect()]  # a row per angle
    nb, dw, s_min = g.nb_bins, g.dw, g.s_min
    names = ["disk_id", "angle_id", "bin_id", "gx", "gy"]

    def chord(u: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.where(np.abs(u) < r, 2 * np.sqrt(np.maximum(r * r - u * u, 0.0)), 0.0)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                cx, cy, r, rho = (b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
                for k, nx, ny in normals:
                    s0 = cx * nx + cy * ny
                    lo = np.maximum(np.floor((s0 - r - s_min) / dw), 0).astype(np.int64)
                    hi = np.minimum(np.ceil((s0 + r - s_min) / dw) - 1, nb - 1).astype(np.int64)
                    n = np.maximum(hi - lo + 1, 0)
                    row = np.repeat(np.arange(len(n)), n)
                    col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                    at0, radius = s0[row], r[row]
                    d = -rho[row] * (chord(s_min + (col + 1) * dw - at0, radius) - chord(s_min + col * dw - at0, radius)) / dw
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.full(len(row), k, np.int32)), pa.array(col.astype(np.int32)), pa.array(d * nx), pa.array(d * ny)], names)

    rows = disks.select("disk_id", *(c(k).cast("double").alias(k) for k in ("cx", "cy", "r", "rho"))).dropna(subset=["cx", "cy", "r", "rho"])
    kind = rows.schema["disk_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"disk_id {kind}, angle_id int, bin_id int, gx double, gy double")


def mass(sino: DataFrame, g: Geometry) -> DataFrame:
    return sino.groupBy("angle_id").agg((F.sum("value") * g.dw).alias("mass"))


def debias(sino: DataFrame, g: Geometry) -> DataFrame:
    """Per-angle shifts that make all masses equal and the least value 0."""
    per = sino.groupBy("angle_id").agg((F.sum("value") * g.dw).alias("mass"), F.min("value").alias("least"))
    level = per.agg(F.max(c("mass") - c("least") * g.extent)).first()[0]
    shift = per.select("angle_id", ((c("mass") - F.lit(level)) / g.extent).alias("shift"))
    return sino.join(shift, "angle_id").select("angle_id", "bin_id", (c("value") - c("shift")).alias("value"))


def linear_deposit(points: DataFrame, angles: DataFrame, g: Geometry, total: float | None = None) -> DataFrame:
    """Points dealt linearly to the two nearest bin centers; what falls outside is lost.

    points: (x, y, w); weights are scaled to ``total`` mass if given.
    """
    if total is not None:
        n = points.agg(F.sum("w")).first()[0]
        points = points.withColumn("w", c("w") * (total / n))
    at = project_points(points, angles).withColumn("_x", (c("s") - g.s_min) / g.dw - 0.5).withColumn("_i", F.floor("_x").cast("int"))
    up = c("_x") - c("_i")
    parts = at.select("angle_id", F.explode(F.array(F.struct(c("_i").alias("b"), (c("w") * (1 - up)).alias("v")), F.struct((c("_i") + 1).alias("b"), (c("w") * up).alias("v")))).alias("p"))
    made = parts.where((c("p.b") >= 0) & (c("p.b") < g.nb_bins)).groupBy("angle_id", c("p.b").alias("bin_id")).agg((F.sum("p.v") / g.dw).alias("value"))
    return g.empty(points.sparkSession).drop("value").join(made, ["angle_id", "bin_id"], "left").select("angle_id", "bin_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def coarse_group(nb_bins: int, nb_coarse: int) -> int:
    """The least divisor of nb_bins that gives at most nb_coarse groups."""
    least = -(-nb_bins // nb_coarse)
    return next(k for k in range(least, nb_bins + 1) if nb_bins % k == 0)


def regroup(sino: DataFrame, group: int) -> DataFrame:
    return sino.groupBy("angle_id", F.floor(c("bin_id") / group).cast("int").alias("cbin")).agg(F.avg("value").alias("value"))


def repeat(coarse: DataFrame, group: int) -> DataFrame:
    fine = F.explode(F.sequence(c("cbin") * group, (c("cbin") + 1) * group - 1))
    return coarse.select("angle_id", fine.alias("bin_id"), "value")


def void_fraction(points: DataFrame, lo: float, hi: float, nb_cells: int) -> DataFrame:
    """1 - occupied share of an nb_cells x nb_cells grid over [lo, hi)^2."""
    size = (hi - lo) / nb_cells
    ix, iy = (F.floor((c(k) - lo) / size).cast("int") for k in ("x", "y"))
    inside = points.select(ix.alias("ix"), iy.alias("iy")).where((c("ix") >= 0) & (c("ix") < nb_cells) & (c("iy") >= 0) & (c("iy") < nb_cells))
    return inside.distinct().agg((1 - F.count(F.lit(1)) / float(nb_cells * nb_cells)).alias("void"))


def point_gradient(grads: DataFrame) -> DataFrame:
    """Per-angle gradients g at (point, nx, ny) added up over the angles."""
    return grads.groupBy("dirac_id").agg(F.sum(c("grad") * c("nx")).alias("gx"), F.sum(c("grad") * c("ny")).alias("gy"))


def subspace_hessian(points: DataFrame, bary: DataFrame, angles: DataFrame, directions: list[str], weight: Column) -> DataFrame:
    """One row: h_i_j = sum 2 w e_i e_j and b_i = sum 2 w (s - bary) e_i, e_i the direction on the normal.

    points: (dirac_id, x, y, <d>x, <d>y per direction); bary: (angle_id, dirac_id, barycenter).
    """
    at = project_points(points, angles)
    e = {d: c(f"{d}x") * c("nx") + c(f"{d}y") * c("ny") for d in directions}
    at = at.join(bary, ["angle_id", "dirac_id"])
    sums = [F.sum(2 * weight * e[p] * e[q]).alias(f"h_{i}_{j}") for i, p in enumerate(directions) for j, q in enumerate(directions) if j >= i]
    return at.agg(*sums, *(F.sum(2 * weight * (c("s") - c("barycenter")) * e[p]).alias(f"b_{i}") for i, p in enumerate(directions)))


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Largest and mean move between two point tables of the same ids."""
    d = before.select("dirac_id", c("x").alias("x0"), c("y").alias("y0")).join(after, "dirac_id")
    return d.agg(F.max(F.greatest(F.abs(c("x") - c("x0")), F.abs(c("y") - c("y0")))).alias("most"), F.avg(F.sqrt((c("x") - c("x0")) ** 2 + (c("y") - c("y0")) ** 2)).alias("mean"))


def direction_cosine(before: DataFrame, here: DataFrame, after: DataFrame) -> DataFrame:
    """Cosine between two successive steps of all points together; null where one step is none."""
    def at(t: DataFrame, k: int) -> DataFrame:
        return t.select("dirac_id", c("x").alias(f"x{k}"), c("y").alias(f"y{k}"))

    t = at(before, 0).join(at(here, 1), "dirac_id").join(at(after, 2), "dirac_id")
    ax, ay, bx, by = c("x1") - c("x0"), c("y1") - c("y0"), c("x2") - c("x1"), c("y2") - c("y1")
    s = t.agg(F.sum(ax * bx + ay * by).alias("ab"), F.sum(ax * ax + ay * ay).alias("aa"), F.sum(bx * bx + by * by).alias("bb"))
    return s.select(F.try_divide(c("ab"), F.sqrt(c("aa") * c("bb"))).alias("cosine"))


def split_points(points: DataFrame, factor: int, noise: Column, id_col: str = "dirac_id") -> DataFrame:
    """Every point becomes ``factor`` children at its place plus ``noise`` times two hash-like units of the child id."""
    kids = points.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("child", c(id_col) * factor + c("_j"))

    def unit(a: int, b: int) -> Column:
        return ((c("child") * a + b) % 2_147_483_647 % 1_000_003) / 500_001.5 - 1

    return kids.select(c("child").alias(id_col), (c("x") + noise * unit(48_271, 11)).alias("x"), (c("y") + noise * unit(69_621, 7)).alias("y"))


def subsample(points: DataFrame, k: int, id_col: str = "dirac_id") -> DataFrame:
    """k points without replacement: those whose ids come first in a fixed scramble."""
    return points.orderBy((c(id_col) * 48_271 + 11) % 2_147_483_647, id_col).limit(k)


def descend(points: DataFrame, gradient: DataFrame, rate: float) -> DataFrame:
    """points moved by rate against (dirac_id, gx, gy); a point without a gradient stays."""
    moved = points.join(gradient, "dirac_id", "left")
    step = {"x": "gx", "y": "gy"}
    return moved.select(*((c(k) - rate * F.coalesce(step[k], F.lit(0.0))).alias(k) if k in step else c(k) for k in points.columns))


def adam_step(points: DataFrame, gradient: DataFrame, moments: DataFrame | None, step: int, rate: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """(dirac_id, x, y, mx, my, vx, vy): points after Adam's step number ``step`` (from 1), with the moments for the next one."""
    t = points.select("dirac_id", "x", "y").join(gradient, "dirac_id", "left").fillna(0.0, ["gx", "gy"])
    if moments is None:
        t = t.select("*", *(F.lit(0.0).alias(k) for k in ("mx", "my", "vx", "vy")))
    else:
        t = t.join(moments.select("dirac_id", "mx", "my", "vx", "vy"), "dirac_id")
    for k in "xy":
        t = t.withColumn("m" + k, beta1 * c("m" + k) + (1 - beta1) * c("g" + k)).withColumn("v" + k, beta2 * c("v" + k) + (1 - beta2) * c("g" + k) * c("g" + k))
        t = t.withColumn(k, c(k) - rate * (c("m" + k) / (1 - beta1**step)) / (F.sqrt(c("v" + k) / (1 - beta2**step)) + eps))
    return t.select("dirac_id", "x", "y", "mx", "my", "vx", "vy")
