"""User functions over batch items of a table, with their derivatives and an error channel.

A call takes a long table, groups it by its batch axes and hands each item's
columns to a NumPy body.  One item is one call of the body and has to fit in a
task; items are dealt over tasks by their axes.  Derivatives are the user's own,
as another body that gets the cotangents of the outputs; a finite-difference
check compares the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR = "error"
Body = Callable[..., dict[str, np.ndarray]]


class Errors(list):
    """What a body reports instead of raising: messages, kept beside the results."""

    def report(self, message: str, *values: object) -> None:
        self.append(message % values if values else message)


@dataclass(frozen=True)
class Call:
    """``forward(item, errors, **columns)`` returns output columns of one length each.

    batch: the axes that number the items.  outputs: name and SQL type.
    ``backward(item, errors, columns, cotangents)`` returns the derivative of the
    cotangents' sum by the input columns named in ``wrt``, row by row.
    """

    forward: Body
    batch: tuple[str, ...]
    outputs: dict[str, str]
    backward: Body | None = None
    wrt: tuple[str, ...] = ()
    fixed: dict = field(default_factory=dict)  # arguments that are the same for all items

    def _kinds(self, t: DataFrame, cols: Iterable[str]) -> list[str]:
        return [f"{k} {t.schema[k].dataType.simpleString()}" for k in cols]

    def run(self, t: DataFrame) -> DataFrame:
        """Batch axes, ``row`` and outputs of every item, and ``error`` (null but in rows that hold a report)."""
        names, batch, forward, fixed = list(self.outputs), self.batch, self.forward, self.fixed
        schema = ", ".join([*self._kinds(t, batch), "row int", *(f"{n} {k}" for n, k in self.outputs.items()), f"{ERROR} string"])
        kinds = t.limit(0).select(*batch).toArrow().schema

        def one(g: pa.Table) -> pa.Table:
            item, cols = _item(g, batch)
            errors = Errors()
            got = forward(item, errors, **cols, **fixed)
            return _answer(item, kinds, names, got, errors)

        return t.groupBy(*batch).applyInArrow(one, schema)

    def __call__(self, t: DataFrame) -> DataFrame:
        """The results; a report of any item fails the query that reads them."""
        return checked(self.run(t))

    def errors(self, t: DataFrame) -> DataFrame:
        """(batch axes, error) of every report."""
        return self.run(t).where(F.col(ERROR).isNotNull()).select(*self.batch, ERROR)

    def over(self, axis: str) -> Call:
        """The same call for every index of one more axis (vmap)."""
        return replace(self, batch=(*self.batch, axis))

    def vjp(self, t: DataFrame, cotangents: DataFrame) -> DataFrame:
        """Batch axes, ``row`` (the item's input rows in order of all columns) and the derivative by each column of wrt.

        cotangents: batch axes, row and outputs; outputs that it lacks count as 0
        and are not handed over.  A column whose derivative the body leaves out is 0.
        """
        if self.backward is None:
            raise ValueError("the call has no derivative")
        batch, backward, fixed, wrt = self.batch, self.backward, self.fixed, list(self.wrt)
        given = [n for n in self.outputs if n in cotangents.columns]
        kinds = t.limit(0).select(*batch).toArrow().schema
        schema = ", ".join([*self._kinds(t, batch), "row int", *(f"{n} double" for n in wrt), f"{ERROR} string"])

        def one(g: pa.Table, h: pa.Table) -> pa.Table:
            if not g.num_rows:
                return _answer({}, kinds, wrt, {n: np.zeros(0) for n in wrt}, Errors())
            item, cols = _item(g, batch)
            h = h.sort_by("row")
            errors = Errors()
            got = backward(item, errors, cols, {n: h[n].to_numpy() for n in given}, **fixed)
            return _answer(item, kinds, wrt, {n: got.get(n, np.zeros(g.num_rows)) for n in wrt}, errors)

        return checked(t.groupBy(*batch).cogroup(cotangents.groupBy(*batch)).applyInArrow(one, schema))

    def grad(self, t: DataFrame, output: str) -> DataFrame:
        """The derivative of the sum of one output."""
        ones = self(t).select(*self.batch, "row", F.lit(1.0).alias(output))
        return self.vjp(t, ones)


def checked(t: DataFrame) -> DataFrame:
    """t without its error column; reading a row that holds a report raises it."""
    cols = [k for k in t.columns if k != ERROR]
    return t.where(F.when(F.col(ERROR).isNotNull(), F.raise_error(F.col(ERROR)).cast("boolean")).otherwise(True)).select(*cols)


def _item(g: pa.Table, batch: tuple[str, ...]) -> tuple[dict, dict[str, np.ndarray]]:
    rest = [k for k in g.column_names if k not in batch]
    g = g.sort_by([(k, "ascending") for k in rest if not pa.types.is_nested(g.schema.field(k).type)])
    return {k: g[k][0].as_py() for k in batch}, {k: g[k].to_numpy() for k in rest}


def _answer(item: dict, kinds: pa.Schema, names: list[str], got: dict, errors: Errors) -> pa.Table:
    n = max((len(got[k]) for k in names), default=0)
    size = n + len(errors)
    cols = [pa.array([item.get(f.name)] * size, f.type) for f in kinds]
    cols.append(pa.array([*range(n), *[None] * len(errors)], pa.int32()))
    cols += [pa.array([*np.asarray(got[k]).tolist(), *[None] * (size - len(got[k]))]) if size else pa.array([], pa.float64()) for k in names]
    cols.append(pa.array([*[None] * n, *errors], pa.string()))
    return pa.table(cols, [*kinds.names, "row", *names, ERROR])


def fold(step: Callable[[DataFrame, object], DataFrame], start: DataFrame, items: Iterable[object], every: int = 10) -> DataFrame:
    """step after step on a table; its lineage is cut by a reliable checkpoint every few steps."""
    t = start
    for k, item in enumerate(items, 1):
        t = step(t, item)
        if k % every == 0:
            t = t.checkpoint()
    return t


def gradient_error(f: Callable[[np.ndarray], float], grad: Callable[[np.ndarray], np.ndarray], x: np.ndarray, h: float = 1e-5, probes: int | None = None, seed: int = 0) -> float:
    """The greatest relative gap between grad and central differences of f, over all coordinates or some seeded directions."""
    x, g = np.asarray(x, float), np.asarray(grad(x), float).ravel()
    ways = np.eye(x.size) if probes is None else np.random.default_rng(seed).standard_normal((probes, x.size))
    told = np.array([(f(x + h * w.reshape(x.shape)) - f(x - h * w.reshape(x.shape))) / (2 * h) for w in ways])
    return float(np.abs(told - ways @ g).max() / max(float(np.abs(told).max()), 1e-12))
