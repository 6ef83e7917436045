"""The graded mesh's operator, edge calculus and solvers over tables of cells.

A projection deposits weighted centers per (angle, level) and then convolves
each such profile with its square's; no row of a cell and a bin beyond a
center's two nearest is made.  The adjoint correlates the sinogram with the same
profiles and looks them up at the centers.  Solvers keep their vectors as
columns of written tables; the driver has scalars only.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massflow.functions.stored import Store
from massflow.operators import mesh as Q
from massflow.operators import radon as R

c = F.col
#: Numbers of the profiles that are broadcast at once; more make more batches of angles.
MOST_BROADCAST = 4_000_000


class MeshTables:
    """cells: (cell_id, level, x, y, h); edges: (i, j, face, dist) where smoothness or variation is asked for."""

    def __init__(self, cells: DataFrame, g: R.Geometry, edges: DataFrame | None = None, store: Store | None = None):
        self.spark, self.g = cells.sparkSession, g
        self.store = store or Store(self.spark)
        self.cells = self.store.put("cells", cells.select("cell_id", "level", "x", "y", "h"))
        self.edges = None if edges is None else self.store.put("edges", edges.select("i", "j", "face", "dist"))
        self.angles = g.angles(self.spark)
        levels = self.cells.select("level", "h").distinct()
        kernel = Q.trapezoid(self.angles, levels, g).groupBy("angle_id", "level").agg(F.array_sort(F.collect_list(F.struct("offset", "k"))).alias("e"))
        self.kernel = self.store.put("kernel", kernel.select("angle_id", "level", c("e.offset").alias("offset"), c("e.k").alias("k")))  # angles x levels

    def _centers(self, cells: DataFrame, angles: DataFrame) -> DataFrame:
        """cells x angles with i, the bin at or before each center, and up, the share of the next one."""
        at = R.project_points(cells, angles).withColumn("_x", (c("s") - self.g.s_min) / self.g.dw - 0.5).withColumn("i", F.floor("_x").cast("int"))
        return at.withColumn("up", c("_x") - c("i")).drop("_x", "s", "theta", "nx", "ny")

    def project(self, weights: DataFrame) -> DataFrame:
        """(angle_id, bin_id, value) of (cell_id, weight); bins that no square meets are 0."""
        nb = self.g.nb_bins
        at = self._centers(self.cells.join(weights.select("cell_id", "weight"), "cell_id"), self.angles)
        two = F.inline(F.array(F.struct(c("i").alias("bin_id"), (c("weight") * (1 - c("up"))).alias("v")), F.struct((c("i") + 1).alias("bin_id"), (c("weight") * c("up")).alias("v"))))
        dealt = at.select("angle_id", "level", two).groupBy("angle_id", "level", "bin_id").agg(F.sum("v").alias("v"))
        lists = dealt.groupBy("angle_id", "level").agg(F.collect_list("bin_id").alias("bins"), F.collect_list("v").alias("vs"))  # the bins that a level meets

        def convolved(batches):
            for b in batches:
                angle, bins, values = [], [], []
                for k, at, vs, offset, kernel in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), b.column(4)):
                    at, offset = at.values.to_numpy(), offset.values.to_numpy()
                    lo = int(at.min())
                    dense = np.zeros(int(at.max()) - lo + 1)
                    dense[at - lo] = vs.values.to_numpy()
                    own = np.zeros(int(offset[-1] - offset[0]) + 1)
                    own[offset - offset[0]] = kernel.values.to_numpy()
                    made, first = np.convolve(dense, own), lo + int(offset[0])
                    keep = slice(max(0, -first), max(0, nb - first))
                    made = made[keep]
                    angle.append(np.full(len(made), k, np.int32))
                    bins.append(np.arange(len(made), dtype=np.int32) + max(first, 0))
                    values.append(made)
                cols = [np.concatenate(x) if x else np.zeros(0) for x in (angle, bins, values)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["angle_id", "bin_id", "value"])

        rows = lists.join(F.broadcast(self.kernel), ["angle_id", "level"]).select("angle_id", "bins", "vs", "offset", "k")
        made = rows.mapInArrow(convolved, "angle_id int, bin_id int, value double").groupBy("angle_id", "bin_id").agg(F.sum("value").alias("value"))
        return self.g.empty(self.spark).drop("value").join(made, ["angle_id", "bin_id"], "left").select("angle_id", "bin_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def backproject(self, sino: DataFrame) -> DataFrame:
        """(cell_id, value): the adjoint of ``project``."""
        nb = self.g.nb_bins
        rows = sino.groupBy("angle_id").agg(F.collect_list("bin_id").alias("bins"), F.collect_list("value").alias("vs")).join(F.broadcast(self.kernel), "angle_id").select("angle_id", "level", "bins", "vs", "offset", "k")

        def correlated(batches):
            for b in batches:
                first, out = [], []
                for at, vs, offset, kernel in zip(b.column(2), b.column(3), b.column(4), b.column(5)):
                    dense = np.zeros(nb)
                    dense[at.values.to_numpy()] = vs.values.to_numpy()
                    offset = offset.values.to_numpy()
                    own = np.zeros(int(offset[-1] - offset[0]) + 1)
                    own[offset - offset[0]] = kernel.values.to_numpy()
                    out.append(np.convolve(dense, own[::-1]))
                    first.append(-int(offset[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(first, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["angle_id", "level", "first", "q"])

        seen = self.store.keep(rows.mapInArrow(correlated, "angle_id int, level int, first int, q array<double>"))
        numbers = seen.agg(F.sum(F.size("q"))).first()[0] or 0
        k = max(1, min(self.g.nb_angles, -(-numbers // MOST_BROADCAST)))
        parts = None
        for b in range(k):
            at = self._centers(self.cells, self.angles.where(c("angle_id") % k == b)).join(F.broadcast(seen.where(c("angle_id") % k == b)), ["angle_id", "level"])
            here = lambda j: F.coalesce(F.get("q", c("i") + j - c("first")), F.lit(0.0))
            part = at.groupBy("cell_id").agg(F.sum((1 - c("up")) * here(0) + c("up") * here(1)).alias("value"))
            parts = part if parts is None else parts.unionByName(part)
        return parts if k == 1 else parts.groupBy("cell_id").agg(F.sum("value").alias("value"))

    def diagonal(self) -> DataFrame:
        """(cell_id, value): squared norms of the operator's columns, as if no detector cut them."""
        flat = self.kernel.select("angle_id", "level", F.aggregate("k", F.lit(0.0), lambda a, v: a + v * v).alias("same"), F.aggregate(F.zip_with("k", F.slice("k", 2, F.size("k")), lambda a, b: a * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v).alias("next"))
        at = self._centers(self.cells, self.angles).join(F.broadcast(flat), ["angle_id", "level"])
        up = c("up")
        return at.groupBy("cell_id").agg(F.sum(((1 - up) ** 2 + up * up) * c("same") + 2 * up * (1 - up) * c("next")).alias("value"))

    # ---- edges -----------------------------------------------------------------------

    def _differences(self, weights: DataFrame) -> DataFrame:
        if self.edges is None:
            raise ValueError("the mesh was made without edges")
        w = weights.select("cell_id", "weight")
        a, b = w.select(c("cell_id").alias("i"), c("weight").alias("wi")), w.select(c("cell_id").alias("j"), c("weight").alias("wj"))
        return self.edges.join(a, "i").join(b, "j").withColumn("d", c("wi") - c("wj"))

    @staticmethod
    def _spread(edges: DataFrame, flow: Column) -> DataFrame:
        """The adjoint of differences along edges: both ends in one exchange."""
        two = F.inline(F.array(F.struct(c("i").alias("cell_id"), flow.alias("v")), F.struct(c("j").alias("cell_id"), (-flow).alias("v"))))
        return edges.select(two).groupBy("cell_id").agg(F.sum("v").alias("value"))

    def laplacian(self, weights: DataFrame) -> DataFrame:
        """(cell_id, value): differences to the neighbours, weighted by face over distance."""
        return self._spread(self._differences(weights), c("face") / c("dist") * c("d"))

    def degrees(self, by: Column | None = None) -> DataFrame:
        """(cell_id, value): the weights (face over distance) of each cell's edges added up."""
        by = c("face") / c("dist") if by is None else by
        return self.edges.select(F.inline(F.array(F.struct(c("i").alias("cell_id"), by.alias("v")), F.struct(c("j").alias("cell_id"), by.alias("v"))))).groupBy("cell_id").agg(F.sum("v").alias("value"))

    def variation(self, weights: DataFrame, delta: float) -> tuple[DataFrame, DataFrame]:
        """((value), (cell_id, value)): total variation under the Huber penalty, quadratic up to delta, and its gradient."""
        e = self._differences(weights)
        near = F.greatest(F.least("d", F.lit(delta)), F.lit(-delta))
        return e.agg((F.sum(c("face") * (near * c("d") - near * near / 2)) / delta).alias("value")), self._spread(e, c("face") * near / delta)

    # ---- solvers -----------------------------------------------------------------------

    def product(self, weights: DataFrame, smooth: float = 0.0) -> DataFrame:
        """(cell_id, value): the normal equations' product with smooth times the laplacian."""
        made = self.backproject(self.project(weights))
        if not smooth:
            return made
        more = self.laplacian(weights).select("cell_id", (smooth * c("value")).alias("value"))
        return made.unionByName(more).groupBy("cell_id").agg(F.sum("value").alias("value"))

    def norm(self, steps: int = 20) -> float:
        """The operator's largest squared singular value, by power iterations from a scrambled start."""
        x = self.cells.select("cell_id", (F.pmod(F.xxhash64("cell_id"), F.lit(2_000_003)) / 1_000_001.5 - 1).alias("weight"))
        size = 1.0
        for _ in range(steps):
            size = x.agg(F.sqrt(F.sum(c("weight") ** 2))).first()[0]
            x = self.store.keep(self.product(x.select("cell_id", (c("weight") / size).alias("weight")))).withColumnRenamed("value", "weight")
        return float(x.agg(F.sqrt(F.sum(c("weight") ** 2))).first()[0])

    def _resumed(self, name: str) -> tuple[int, dict]:
        k, log = 0, {}
        while self.store.has(f"{name}-log-{k}"):
            log = json.loads(self.store.get(f"{name}-log-{k}").first()[0])
            k += 1
        return k, log

    def _logged(self, name: str, k: int, log: dict) -> None:
        self.store.put(f"{name}-log-{k}", self.spark.createDataFrame([(json.dumps(log),)], "log string"))
        if k > 1:
            self.store.drop(f"{name}-{k - 2}")

    def conjugate_gradients(self, sino: DataFrame, smooth: float = 0.0, iterations: int = 60, tol: float = 1e-12, name: str = "cg") -> DataFrame:
        """(cell_id, weight): the normal equations' solution, preconditioned by their diagonal.

        Each direction is made conjugate to the last one by that one's product.
        A step is a written table (x, residual, direction, image) and a log; a
        run on the same store goes on after the last whole step.
        """
        k, log = self._resumed(name)
        if not k:
            inverse = self.diagonal()
            if smooth:
                inverse = inverse.unionByName(self.degrees().select("cell_id", (smooth * c("value")).alias("value"))).groupBy("cell_id").agg(F.sum("value").alias("value"))
            b = self.backproject(sino)
            start = self.cells.select("cell_id").join(inverse, "cell_id").join(b.withColumnRenamed("value", "r"), "cell_id")
            start = start.select("cell_id", (1 / F.greatest("value", F.lit(1e-30))).alias("inverse"), F.lit(0.0).alias("x"), "r", F.lit(0.0).alias("d"), F.lit(0.0).alias("image"))
            state = self.store.put(f"{name}-0", start)
            log = {"size": state.agg(F.sqrt(F.sum(c("r") ** 2))).first()[0], "energy": 0.0, "done": False}
            self._logged(name, 0, log)
            k = 1
        state = self.store.get(f"{name}-{k - 1}")
        while k <= iterations and not log["done"]:
            r = state.agg(F.sqrt(F.sum(c("r") ** 2)).alias("left"), F.sum(c("inverse") * c("r") * c("image")).alias("mixed")).first()
            if r["left"] <= tol * log["size"]:
                break
            beta = r["mixed"] / log["energy"] if log["energy"] else 0.0
            way = state.select("cell_id", "inverse", "x", "r", (c("inverse") * c("r") - beta * c("d")).alias("d"))
            image = self.product(way.select("cell_id", c("d").alias("weight")), smooth).withColumnRenamed("value", "image")
            both = self.store.keep(way.join(image, "cell_id"))
            e = both.agg(F.sum(c("d") * c("image")).alias("energy"), F.sum(c("d") * c("r")).alias("along")).first()
            if e["energy"] <= 0:
                break
            t = e["along"] / e["energy"]
            self.store.drop(f"{name}-{k}")
            state = self.store.put(f"{name}-{k}", both.select("cell_id", "inverse", (c("x") + t * c("d")).alias("x"), (c("r") - t * c("image")).alias("r"), "d", "image"))
            log = {**log, "energy": e["energy"]}
            self._logged(name, k, log)
            k += 1
        return state.select("cell_id", c("x").alias("weight"))

    def projected_descent(self, sino: DataFrame, step: float, smooth: float = 0.0, variation: float = 0.0, delta: float = 1e-2, iterations: int = 300, name: str = "descent") -> DataFrame:
        """(cell_id, weight): nonnegative weights by projected gradients from extrapolated points.

        The k-th extrapolation goes k / (k + 3) of the last move further; where
        the move and the gradient part ways, k starts again.
        """
        at, log = self._resumed(name)
        if not at:
            b = self.backproject(sino).withColumnRenamed("value", "b")
            state = self.store.put(f"{name}-0", self.cells.select("cell_id").join(b, "cell_id").select("cell_id", "b", F.lit(0.0).alias("weight"), F.lit(0.0).alias("move")))
            log = {"k": 0}
            self._logged(name, 0, log)
            at = 1
        state = self.store.get(f"{name}-{at - 1}")
        while at <= iterations:
            f = log["k"] / (log["k"] + 3)
            ahead = state.select("cell_id", "b", c("weight").alias("here"), (c("weight") + f * c("move")).alias("weight"))
            slope = self.product(ahead, smooth)
            if variation:
                slope = slope.unionByName(self.variation(ahead, delta)[1].select("cell_id", (variation * c("value")).alias("value"))).groupBy("cell_id").agg(F.sum("value").alias("value"))
            g = c("value") - c("b")
            there = F.greatest(c("weight") - step * g, F.lit(0.0))
            self.store.drop(f"{name}-{at}")
            new = self.store.put(f"{name}-{at}", ahead.join(slope, "cell_id").select("cell_id", "b", there.alias("weight"), (there - c("here")).alias("move"), g.alias("slope")))
            along = new.agg(F.sum(c("slope") * c("move"))).first()[0]
            log = {"k": 0 if along > 0 else log["k"] + 1}
            self._logged(name, at, log)
            state = new.drop("slope")
            at += 1
        return state.select("cell_id", "weight")
