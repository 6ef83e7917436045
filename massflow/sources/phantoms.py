"""Generated inputs: phantoms, sites, seeded random points, nested literals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

DISK = "disk_id int, cx double, cy double, r double, rho double"


def disks(spark: SparkSession, rows: list[tuple[float, float, float, float]]) -> DataFrame:
    """(cx, cy, r, rho) rows; a radius must be positive."""
    if any(r <= 0 for _, _, r, _ in rows):
        raise ValueError("a disk needs a positive radius")
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], DISK)


def _unit(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that hangs on the keys and the seed only, so it is the same under any partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def hex_sites(spark: SparkSession, lobe: tuple[float, float, float], pitch: float, margin: float = 0.0, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(site_id, x, y): a jittered hexagonal grid inside a disk lobe (cx, cy, r); ids go by rows of the grid.

    Sites are a generated range, so a grid of any size is made by the executors.
    """
    cx, cy, r = lobe
    n = math.ceil(r / pitch) + 1
    m = math.ceil(r / (pitch * math.sqrt(3) / 2)) + 1
    wide = 2 * n + 1
    at = spark.range((2 * m + 1) * wide).select("id", (F.floor(c("id") / wide) - m).alias("j"), (c("id") % wide - n).alias("i"))
    dx, dy = ((2 * _unit(seed + k, "id") - 1) * jitter * pitch for k in (0, 1))
    odd = F.when(c("j") % 2 == 0, 0.0).otherwise(0.5)
    at = at.select(c("id").alias("site_id"), (cx + (c("i") + odd) * pitch + dx).alias("x"), (cy + c("j") * (pitch * math.sqrt(3) / 2) + dy).alias("y"))
    return at.where(F.sqrt((c("x") - cx) ** 2 + (c("y") - cy) ** 2) <= r - margin)


def lung_phantom(spark: SparkSession, extent: float, scale: float = 0.9, nb_holes: int = 40, hole: float = 0.08, seed: int = 0) -> DataFrame:
    """A lobe of density 1 less holes of density -1: ``nb_holes`` of the jittered hexagonal sites, by the order of a hash."""
    r = extent / 2 * scale
    sites = hex_sites(spark, (0.0, 0.0, r), 2.6 * hole, hole, 0.15, seed)
    taken = sites.orderBy(F.xxhash64("site_id", F.lit(seed)), "site_id").limit(nb_holes)
    holes = taken.select((c("site_id") + 1).cast("int").alias("disk_id"), c("x").alias("cx"), c("y").alias("cy"), F.lit(hole).alias("r"), F.lit(-1.0).alias("rho"))
    return disks(spark, [(0.0, 0.0, r, 1.0)]).unionByName(holes)


def ring(spark: SparkSession, n: int, radius: float, r: float) -> DataFrame:
    return disks(spark, [(radius * math.cos(2 * math.pi * k / n), radius * math.sin(2 * math.pi * k / n), r, 1.0) for k in range(n)])


def grid(spark: SparkSession, n: int, pitch: float, r: float) -> DataFrame:
    return disks(spark, [((i - (n - 1) / 2) * pitch, (j - (n - 1) / 2) * pitch, r, 1.0) for i in range(n) for j in range(n)])


def random_points(spark: SparkSession, n: int, extent: float, seed: int = 0, normal: bool = False) -> DataFrame:
    """(dirac_id, x, y): even in the field, or normal with a sixth of it as deviation; made by the executors."""
    u, v = _unit(seed, "id"), _unit(seed + 1, "id")
    if normal:
        size = F.sqrt(-2 * F.log(1 - u)) * (extent / 6)
        x, y = size * F.cos(2 * math.pi * v), size * F.sin(2 * math.pi * v)
    else:
        x, y = (u - 0.5) * extent, (v - 0.5) * extent
    return spark.range(n).select(c("id").alias("dirac_id"), x.alias("x"), y.alias("y"))
