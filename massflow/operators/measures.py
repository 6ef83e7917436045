"""Point measures and piecewise-constant densities as DataFrames.

diracs: (batch, dirac_id, pos, w); density: (batch, cell_id, x0, x1, y).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64


def diracs(df: DataFrame, batch: Column, dirac_id: Column, pos: Column, w: Column | None = None) -> DataFrame:
    """Weighted points; without w every point weighs 1."""
    return df.select(batch.alias("batch"), dirac_id.alias("dirac_id"), pos.cast("double").alias("pos"), (F.lit(1.0) if w is None else w.cast("double")).alias("w"))


def density(df: DataFrame, batch: Column, cell_id: Column, x0: Column, x1: Column, y: Column) -> DataFrame:
    return df.select(batch.alias("batch"), cell_id.alias("cell_id"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), y.cast("double").alias("y"))


def knots_density(df: DataFrame, origin: float = 0.0, frame: float = 1.0) -> DataFrame:
    """(batch, cell_id, y) with default knots 0, 1, 2, ... placed by origin and frame."""
    return density(df, F.col("batch"), F.col("cell_id"), origin + frame * F.col("cell_id"), origin + frame * (F.col("cell_id") + 1), F.col("y"))


def point_mass(d: DataFrame) -> DataFrame:
    return d.groupBy("batch").agg(F.sum("w").alias("mass"))


def density_mass(d: DataFrame) -> DataFrame:
    return d.groupBy("batch").agg(F.sum(F.col("y") * (F.col("x1") - F.col("x0"))).alias("mass"))


def normalize_points(d: DataFrame, target: float = 1.0) -> DataFrame:
    """Weights scaled to ``target`` per batch; the totals are a combined aggregate, not a window."""
    return d.join(point_mass(d), "batch").withColumn("w", F.try_divide(F.col("w") * target, F.col("mass"))).drop("mass")


def normalize_density(d: DataFrame, target: float = 1.0) -> DataFrame:
    return d.join(density_mass(d), "batch").withColumn("y", F.try_divide(F.col("y") * target, F.col("mass"))).drop("mass")


def image_mass(cells: DataFrame, knots: DataFrame, det: float = 1.0) -> DataFrame:
    """Mass of n-D images: sum of value * |det| * product of knot spacings.

    cells: (image_id, cell_idx array<int>, value); knots: (image_id, dim, k, x).
    The adjoint, a column per cell, is ``spacing``.
    """
    sides = cells.select("image_id", "cell_idx", "value", F.posexplode("cell_idx").alias("dim", "k"))
    lo = knots.select("image_id", "dim", "k", F.col("x").alias("xa"))
    hi = knots.select("image_id", "dim", (F.col("k") - 1).alias("k"), F.col("x").alias("xb"))
    per = sides.join(lo, ["image_id", "dim", "k"]).join(hi, ["image_id", "dim", "k"])
    per = per.groupBy("image_id", "cell_idx", "value").agg((F.product(F.col("xb") - F.col("xa")) * abs(det)).alias("spacing"))
    return per.groupBy("image_id").agg(F.sum(F.col("value") * F.col("spacing")).alias("mass"))


def histogram(df: DataFrame, value: str, bins: int = BINS, times: str | None = None) -> DataFrame:
    """(cell_id, x0, x1, y): counts of ``value`` in equal bins between its extremes; empty bins have y = 0.

    ``times``: a column that tells how many rows a row stands for.
    """
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:  # no values: no cells
        return df.sparkSession.createDataFrame([], "cell_id int, x0 double, x1 double, y double")
    lo, hi = float(lo), float(hi)
    dw = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int") if hi > lo else F.lit(0)
    counts = df.where(F.col(value).isNotNull()).groupBy(b.alias("cell_id")).agg((F.count(F.lit(1)) if times is None else F.sum(times)).cast("double").alias("y"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("cell_id"))
    return frame.join(counts, "cell_id", "left").select("cell_id", (lo + F.col("cell_id") * dw).alias("x0"), (lo + (F.col("cell_id") + 1) * dw).alias("x1"), F.coalesce("y", F.lit(0.0)).alias("y"))


def for_batches(cells: DataFrame, points: DataFrame) -> DataFrame:
    """One density shared by every batch of points (cells: a bounded number of bins)."""
    return points.select("batch").distinct().join(F.broadcast(cells), F.lit(True))


@dataclass(frozen=True)
class Measure:
    """A measure of either kind, with what it can be asked for.

    kind "diracs": (batch, dirac_id, pos, w); "density": (batch, cell_id, x0, x1, y).
    Its mass and its normalized form are planned once, when first asked for.
    """

    kind: str
    table: DataFrame

    def __post_init__(self):
        if self.kind not in ("diracs", "density"):
            raise ValueError(f"no such kind: {self.kind}")

    @cached_property
    def mass(self) -> DataFrame:
        return point_mass(self.table) if self.kind == "diracs" else density_mass(self.table)

    @cached_property
    def normalized(self) -> DataFrame:
        return normalize_points(self.table) if self.kind == "diracs" else normalize_density(self.table)

    def batch_slice(self, *batches: object) -> Measure:
        return Measure(self.kind, self.table.where(F.col("batch").isin(*batches)))

    def as_diracs(self) -> DataFrame:
        """Points as they are; cells as their centers with their masses."""
        if self.kind == "diracs":
            return self.table
        t = self.table
        return diracs(t, F.col("batch"), F.col("cell_id"), (F.col("x0") + F.col("x1")) / 2, F.col("y") * (F.col("x1") - F.col("x0")))

    def as_density(self) -> DataFrame | None:
        """Cells as they are; points have no density: None."""
        return self.table if self.kind == "density" else None

    def plan_to(self, target: Measure) -> DataFrame | None:
        """The transport plan to a density; None where this pair has no closed form."""
        from massflow.operators.transport import pieces

        return pieces(self.as_diracs(), target.table) if target.kind == "density" else None
