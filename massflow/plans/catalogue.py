"""Every query of the engine and its oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from massflow.plans import descent_queries, field_queries, mesh_queries, ot_queries, radon_queries

_PARTS = (ot_queries, radon_queries, field_queries, descent_queries, mesh_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


#: Rounded columns that can come out as -0.0 in the oracle's engine, which Spark never returns.
_SIGNED = {"ot1d_grad_position": ["grad_milli"], "ot1d_grad_weight": ["grad"], "ot1d_grad_density": ["grad"], "fused_cost_grad": ["grad_milli"], "point_gradient_2d": ["gx_milli", "gy_milli"], "project_points": ["s"], "radon_disks": ["value"], "radon_tents": ["value"], "sinogram_debias": ["value"], "axis_broadcast": ["v"], "axis_floordiv_mod": ["m"], "vector_algebra": ["dot", "det", "x0"], "subspace_hessian": ["h_0_1", "b_0", "b_1"]}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
    for name, cols in _SIGNED.items():
        found[name] = f"SELECT * REPLACE ({', '.join(f'{c} + 0.0 AS {c}' for c in cols)}) FROM ({found[name]})"
    return found
