"""Planar convex cells: parallelograms, the unbounded cell, measure and its adjoint.

vertices: (cell_id, vertex_id, x, y) in ring order; cuts: (cell_id, cut_id, dx, dy, offset, tag).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tags of cuts that bound nothing, and of the outer boundary.
INFINITE = -2
BOUNDARY = -1
LARGEST = 1.7976931348623157e308
c = F.col


def hypercube_vertices(cells: DataFrame) -> DataFrame:
    """Four corners per cell of (cell_id, ox, oy, ax, ay, bx, by), around the boundary."""
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("vertex_id"), F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for i, (u, v) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))))))
    at = cells.withColumn("k", corner)
    return at.select("cell_id", "k.vertex_id", (c("ox") + c("k.u") * c("ax") + c("k.v") * c("bx")).alias("x"), (c("oy") + c("k.u") * c("ay") + c("k.v") * c("by")).alias("y"))


def hypercube_cuts(cells: DataFrame, tag: int = BOUNDARY) -> DataFrame:
    """Four half-planes dx x + dy y <= offset: rows of the inverse frame and their opposites.

    Cut i bounds the edge from vertex i to vertex i + 1.
    """
    det = c("ax") * c("by") - c("ay") * c("bx")
    ux, uy, vx, vy = F.try_divide(c("by"), det), F.try_divide(-c("bx"), det), F.try_divide(-c("ay"), det), F.try_divide(c("ax"), det)
    u0, v0 = ux * c("ox") + uy * c("oy"), vx * c("ox") + vy * c("oy")
    sides = [(-vx, -vy, -v0), (ux, uy, u0 + 1), (vx, vy, v0 + 1), (-ux, -uy, -u0)]
    k = F.explode(F.array(*(F.struct(F.lit(i).alias("cut_id"), a.alias("dx"), b.alias("dy"), o.alias("offset")) for i, (a, b, o) in enumerate(sides))))
    return cells.select("cell_id", k.alias("k")).select("cell_id", "k.*", F.lit(tag).alias("tag"))


def unbounded(spark: SparkSession, cell_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """The cell without bounds: an aligned triangle whose cuts are tagged INFINITE."""
    v = spark.createDataFrame([(cell_id, 0, 0.0, 0.0), (cell_id, 1, 1.0, 0.0), (cell_id, 2, 0.0, 1.0)], "cell_id int, vertex_id int, x double, y double")
    k = spark.createDataFrame([(cell_id, 0, 0.0, -1.0, 0.0, INFINITE), (cell_id, 1, 1.0, 1.0, 1.0, INFINITE), (cell_id, 2, -1.0, 0.0, 0.0, INFINITE)], "cell_id int, cut_id int, dx double, dy double, offset double, tag int")
    return v, k


def _ring(v: DataFrame):
    o = Window.partitionBy("cell_id").orderBy("vertex_id")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def around(step: int, col: str):
        side = F.lead(col).over(o) if step > 0 else F.lag(col).over(o)
        return F.coalesce(side, (F.first(col) if step > 0 else F.last(col)).over(whole))

    return around


def measure(v: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Signed area; the largest double where a cut is INFINITE."""
    around = _ring(v)
    term = v.select("cell_id", ((c("x") * around(1, "y") - c("y") * around(1, "x")) / 2).alias("t"))
    area = term.groupBy("cell_id").agg(F.sum("t").alias("area"))
    if cuts is None:
        return area
    open_ = cuts.where(c("tag") == INFINITE).select("cell_id").distinct().withColumn("open", F.lit(True))
    return area.join(open_, "cell_id", "left").select("cell_id", F.when(c("open"), LARGEST).otherwise(c("area")).alias("area"))


def measure_gradient(v: DataFrame) -> DataFrame:
    around = _ring(v)
    return v.select("cell_id", "vertex_id", ((around(1, "y") - around(-1, "y")) / 2).alias("gx"), ((around(-1, "x") - around(1, "x")) / 2).alias("gy"))


def hypercube_adjoint(grads: DataFrame) -> DataFrame:
    """Vertex cotangents carried back to origin and axes, per cell."""
    u = F.when(c("vertex_id").isin(1, 2), 1.0).otherwise(0.0)
    w = F.when(c("vertex_id").isin(2, 3), 1.0).otherwise(0.0)
    return grads.groupBy("cell_id").agg(F.sum("gx").alias("gox"), F.sum("gy").alias("goy"), F.sum(u * c("gx")).alias("gax"), F.sum(u * c("gy")).alias("gay"), F.sum(w * c("gx")).alias("gbx"), F.sum(w * c("gy")).alias("gby"))
