"""Named-axis algebra on long tables: one key column per axis, one value column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "v"


def axes(t: DataFrame) -> list[str]:
    return [k for k in t.columns if k != VALUE]


#: Cells of a factor that an outer product may spread over the other one.
OUTER_CELLS = 1 << 20


def combine(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    """op over axis-aligned values: an equi-join on shared axes, an outer product without any.

    An outer product has the product of both sides' cells, whatever the plan; its
    smaller side is counted, and broadcast up to OUTER_CELLS.  Two larger factors
    are an error, not a cross join.
    """
    shared = [k for k in axes(a) if k in axes(b)]
    right = b.withColumnRenamed(VALUE, "_w")
    if shared:
        both = a.join(right, shared)
    elif b.limit(OUTER_CELLS + 1).count() <= OUTER_CELLS:
        both = a.join(F.broadcast(right), F.lit(True))
    elif a.limit(OUTER_CELLS + 1).count() <= OUTER_CELLS:
        both = F.broadcast(a).join(right, F.lit(True))
    else:
        raise ValueError(f"an outer product of two tables of more than {OUTER_CELLS} cells")
    keys = [*axes(a), *(k for k in axes(b) if k not in shared)]
    return both.select(*keys, op(F.col(VALUE), F.col("_w")).alias(VALUE))


def add(a, b):
    return combine(a, b, lambda x, y: x + y)


def sub(a, b):
    return combine(a, b, lambda x, y: x - y)


def mul(a, b):
    return combine(a, b, lambda x, y: x * y)


def div(a, b):
    """Quotients; a zero divisor gives null."""
    return combine(a, b, F.try_divide)


def floordiv(a, b):
    return combine(a, b, lambda x, y: F.floor(F.try_divide(x, y)))


def mod(a, b):
    """Remainders with the sign of the divisor."""
    return combine(a, b, lambda x, y: x - y * F.floor(F.try_divide(x, y)))


def power(a, b):
    return combine(a, b, F.pow)


def apply(t: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Elementwise: neg, abs, sqrt, asin, comparisons, where."""
    return t.select(*axes(t), f(F.col(VALUE)).alias(VALUE))


def clip(x: Column, lo=None, hi=None) -> Column:
    x = x if lo is None else F.greatest(x, F.lit(lo))
    return x if hi is None else F.least(x, F.lit(hi))


def where(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


def pick(t: DataFrame, axis: str, k: int) -> DataFrame:
    """One index of an axis; the axis goes."""
    return t.where(F.col(axis) == k).drop(axis)


def between(t: DataFrame, axis: str, start: int, stop: int) -> DataFrame:
    """A slice, renumbered from 0."""
    return t.where((F.col(axis) >= start) & (F.col(axis) < stop)).withColumn(axis, F.col(axis) - start)


def transpose(t: DataFrame, *order: str) -> DataFrame:
    return t.select(*(order or axes(t)[::-1]), VALUE)


_REDUCE = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop, "all": lambda c: F.bool_and(c != 0), "any": lambda c: F.bool_or(c != 0)}


def reduce(t: DataFrame, how: str, over: list[str] | None = None) -> DataFrame:
    """Reduction over the named axes (all without any); missing cells of ragged axes have no part."""
    left = [] if over is None else [k for k in axes(t) if k not in over]
    return t.groupBy(*left).agg(_REDUCE[how](F.col(VALUE)).alias(VALUE))


def argmax(t: DataFrame, axis: str) -> DataFrame:
    """The first index along an axis at which the value is greatest."""
    left = [k for k in axes(t) if k != axis]
    return t.groupBy(*left).agg((-F.max(F.struct(F.col(VALUE), (-F.col(axis)).alias("n"))).getField("n")).alias(VALUE))


def dot(a: DataFrame, b: DataFrame, over: str) -> DataFrame:
    """Contraction over one shared axis; axes shared besides it are aligned."""
    shared = [k for k in axes(a) if k in axes(b)]
    both = a.join(b.withColumnRenamed(VALUE, "_w"), shared)
    free = [k for k in dict.fromkeys([*axes(a), *axes(b)]) if k != over]
    return both.groupBy(*free).agg(F.sum(F.col(VALUE) * F.col("_w")).alias(VALUE))


def full(spark, shape: dict[str, int], value: float) -> DataFrame:
    """A constant over the product of axes, index by div and mod of one range."""
    size = int(np.prod(list(shape.values()))) if shape else 1
    t, step = spark.range(size), size
    cols = []
    for name, n in shape.items():
        step //= n
        cols.append((F.floor(F.col("id") / step) % n).cast("int").alias(name))
    return t.select(*cols, F.lit(float(value)).alias(VALUE))


def ones(spark, shape: dict[str, int]) -> DataFrame:
    return full(spark, shape, 1.0)


def linspace(spark, axis: str, start: float, stop: float, n: int) -> DataFrame:
    """n even steps, both ends included (n = 1: the start)."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").cast("int").alias(axis), (start + F.col("id") * step).alias(VALUE))


def iota(spark, axis: str, n: int) -> DataFrame:
    """The knots 0, 1, 2, ..."""
    return linspace(spark, axis, 0.0, n - 1.0, n)


def wrap(spark, values: np.ndarray, names: list[str]) -> DataFrame:
    """A dense array with named axes, its indices from one range (a driver's array is a bounded table)."""
    x = np.asarray(values, float)
    if x.ndim != len(names):
        raise ValueError(f"{x.ndim} axes, {len(names)} names")
    at = np.indices(x.shape).reshape(x.ndim, -1).astype(np.int32)
    return spark.createDataFrame(pa.table([*at, x.ravel()], [*names, VALUE]))


def repeat(t: DataFrame, axis: str, n: int) -> DataFrame:
    """Every index of an axis n times in a row."""
    return t.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(axis, F.col(axis) * n + F.col("_k")).drop("_k")


def move_axis(t: DataFrame, axis: str, to: int) -> DataFrame:
    order = [k for k in axes(t) if k != axis]
    order.insert(to, axis)
    return transpose(t, *order)


def hstack(parts: list[DataFrame], axis: str, sizes: list[int]) -> DataFrame:
    """Tables side by side along an axis; sizes are their lengths there."""
    out, at = parts[0], sizes[0]
    for p, n in zip(parts[1:], sizes[1:]):
        out, at = concat(out, p, axis, at), at + n
    return out


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positional product: the last axis of a against the first of b, whatever their names.

    The result has a's other axes and b's; one that both have gets a 2 in b's name.
    """
    *left, inner = axes(a)
    first, *right = axes(b)
    names = {k: f"{k}2" if k in left else k for k in right}
    both = a.join(b.select(F.col(first).alias(inner), *(F.col(k).alias(f"_{n}") for k, n in names.items()), F.col(VALUE).alias("_w")), inner)
    return both.groupBy(*left, *(F.col(f"_{n}").alias(n) for n in names.values())).agg(F.sum(F.col(VALUE) * F.col("_w")).alias(VALUE))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The index tuples that both tables have."""
    return a.select(*axes(a)).join(b.select(*axes(a)), axes(a), "left_semi")


def assign(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column] = lambda x, y: y) -> DataFrame:
    """a with op(a, b) in the cells that b has, too (=, +=, -=, *=, /=); cells of b alone are left out."""
    both = a.join(b.withColumnRenamed(VALUE, "_w"), axes(a), "left")
    return both.select(*axes(a), F.when(F.col("_w").isNotNull(), op(F.col(VALUE), F.col("_w"))).otherwise(F.col(VALUE)).alias(VALUE))


def squeeze(t: DataFrame, axis: str) -> DataFrame:
    """t without an axis of length 1."""
    return t.where(F.when(F.col(axis) != 0, F.raise_error(F.lit(f"axis {axis} is longer than 1")).cast("boolean")).otherwise(True)).drop(axis)


def unsqueeze(t: DataFrame, axis: str, to: int = 0) -> DataFrame:
    return move_axis(extend(t, axis), axis, to)


def row(t: DataFrame, k: int) -> DataFrame:
    """One index of the first axis."""
    return pick(t, axes(t)[0], k)


def offset(t: DataFrame, **by: int) -> DataFrame:
    """The view that begins at the given indices."""
    for axis, k in by.items():
        t = t.where(F.col(axis) >= k).withColumn(axis, F.col(axis) - k)
    return t


def length(t: DataFrame, axis: str) -> int:
    """One more than the greatest index of an axis."""
    top = t.agg(F.max(axis)).first()[0]
    return 0 if top is None else top + 1


def scalar(t: DataFrame) -> float:
    """The value of a table of one cell."""
    some = t.select(VALUE).take(2)
    if len(some) != 1:
        raise ValueError("not one cell")
    return float(some[0][0])


def rows_of(t: DataFrame):
    """(index, sub-table) along the first axis; one small lookup of indices, a filter each."""
    first = axes(t)[0]
    for k in range(length(t, first)):
        yield k, pick(t, first, k)


def dense(t: DataFrame, most: int = 1 << 22) -> np.ndarray:
    """The table as an array on the driver, missing cells nan; an error beyond ``most`` cells."""
    if t.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} cells")
    p = t.toPandas()
    at = tuple(p[k].to_numpy() for k in axes(t))
    out = np.full([int(i.max(initial=-1)) + 1 for i in at], np.nan)
    out[at] = p[VALUE].to_numpy()
    return out


def stop_gradient(t: DataFrame) -> DataFrame:
    """The table itself: derivatives are tables of their own here."""
    return t


def from_nested(spark, values: list, names: list[str]) -> DataFrame:
    """Nested lists, ragged ones too, as a long table."""
    rows: list[tuple] = []

    def walk(x, at):
        if isinstance(x, (list, tuple)):
            for i, y in enumerate(x):
                walk(y, (*at, i))
        else:
            rows.append((*at, float(x)))

    walk(values, ())
    return spark.createDataFrame(rows, ", ".join([*(f"{n} int" for n in names), f"{VALUE} double"]))


def extend(t: DataFrame, axis: str, n: int = 1) -> DataFrame:
    """Append a trailing axis of n repeats."""
    return t.select(*axes(t), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(axis), VALUE)


def concat(a: DataFrame, b: DataFrame, axis: str, offset: int) -> DataFrame:
    return a.unionByName(b.withColumn(axis, F.col(axis) + offset))


def padded(t: DataFrame, axis: str, n: int, value: float = 0.0) -> DataFrame:
    """All n indices of an axis, missing cells filled."""
    left = [k for k in axes(t) if k != axis]
    frame = t.select(*left).distinct() if left else t.sparkSession.range(1).select()
    frame = frame.select(*left, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(axis))
    return frame.join(t, axes(t), "left").select(*axes(t), F.coalesce(VALUE, F.lit(value)).alias(VALUE))


# ---- small vectors and matrices (arrays of doubles) ---------------------------


def vdot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(vdot(a, a))


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x, norm(a)))


def vmap(a: Column, f: Callable[[Column], Column]) -> Column:
    """Elementwise: floor, ceil, neg, a scalar's product."""
    return F.transform(a, lambda x: f(x))


def vzip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Elementwise of two vectors: +, -, *, /, least, greatest."""
    return F.zip_with(a, b, f)


def vargmax(a: Column) -> Column:
    """The first index (from 0) of the greatest component."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Direction cosine; null for a zero vector."""
    return F.try_divide(vdot(a, b), norm(a) * norm(b))


def minor(m: Column, n: int, row: int, col: int) -> Column:
    """A row-major n x n array without a row and a column."""
    return F.array(*(F.get(m, F.lit(i * n + j)) for i in range(n) for j in range(n) if i != row and j != col))


def diagonal(m: Column, n: int) -> Column:
    return F.array(*(F.get(m, F.lit(i * n + i)) for i in range(n)))


def replaced_column(m: Column, n: int, col: int, b: Column) -> Column:
    return F.array(*(F.get(b, F.lit(i)) if j == col else F.get(m, F.lit(i * n + j)) for i in range(n) for j in range(n)))


def det(m: Column, n: int) -> Column:
    """Determinant by cofactors of the first row (n is a small constant)."""
    if n <= 3:
        return F.get(m, F.lit(0)) if n == 1 else det2(m) if n == 2 else det3(m)
    return sum((F.get(m, F.lit(j)) * det(minor(m, n, 0, j), n - 1) * (-1) ** j for j in range(n)), F.lit(0.0))


def det2(m: Column) -> Column:
    """Determinant of a row-major 2 x 2 array."""
    return F.get(m, F.lit(0)) * F.get(m, F.lit(3)) - F.get(m, F.lit(1)) * F.get(m, F.lit(2))


def det3(m: Column) -> Column:
    g = [F.get(m, F.lit(i)) for i in range(9)]
    return g[0] * (g[4] * g[8] - g[5] * g[7]) - g[1] * (g[3] * g[8] - g[5] * g[6]) + g[2] * (g[3] * g[7] - g[4] * g[6])


def solve2(m: Column, b: Column) -> Column:
    """Cramer's rule; a singular system gives zeros."""
    d, m0, m1 = det2(m), F.get(b, F.lit(0)), F.get(b, F.lit(1))
    x = m0 * F.get(m, F.lit(3)) - F.get(m, F.lit(1)) * m1
    y = F.get(m, F.lit(0)) * m1 - m0 * F.get(m, F.lit(2))
    return F.array(F.coalesce(F.try_divide(x, d), F.lit(0.0)), F.coalesce(F.try_divide(y, d), F.lit(0.0)))


def gauss_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elimination with partial pivots; an unknown with a zero pivot is 0."""
    a, b = a.astype(float).copy(), b.astype(float).copy()
    n = len(b)
    for k in range(n):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, p]], b[[k, p]] = a[[p, k]], b[[p, k]]
        if a[k, k]:
            f = a[k + 1 :, k] / a[k, k]
            a[k + 1 :] -= f[:, None] * a[k]
            b[k + 1 :] -= f * b[k]
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - a[k, k + 1 :] @ x[k + 1 :]) / a[k, k] if a[k, k] else 0.0
    return x


def inverse(a: np.ndarray) -> np.ndarray:
    return np.column_stack([gauss_solve(a, e) for e in np.eye(len(a))])


def cholesky(a: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(a)
