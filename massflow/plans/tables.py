"""Driver tables in the roles of the engine's inputs, for queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.functions.stored import Store
from massflow.operators import measures as M


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark, d):
    return M.diracs(read(spark, d, "events"), F.col("event_type"), F.col("event_id"), F.col("value"))


def event_target(spark, d):
    e = read(spark, d, "events")
    return M.density(M.for_batches(M.histogram(e, "value"), event_points(spark, d)), F.col("batch"), F.col("cell_id"), F.col("x0"), F.col("x1"), F.col("y"))


def lineitem_points(spark, d):
    """Weighted points; equal prices of a batch are one dirac, whose id is the price's rank-free hash."""
    g = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("batch"), F.col("l_extendedprice").alias("pos")).agg(F.sum("l_quantity").alias("w"))
    return M.diracs(g, F.col("batch"), F.round(F.col("pos") * 100).cast("long"), F.col("pos"), F.col("w"))


def lineitem_target(spark, d):
    li = read(spark, d, "lineitem")
    return M.for_batches(M.histogram(li, "l_extendedprice"), lineitem_points(spark, d)).select("batch", "cell_id", "x0", "x1", "y")


def lineitem_problem(spark, d):
    """(lineitem_points, lineitem_target) from one pass over lineitem: what is read again is a row per flag and price."""
    g = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("batch"), F.col("l_extendedprice").alias("pos")).agg(F.sum("l_quantity").alias("w"), F.count(F.lit(1)).alias("n"))
    g = Store(spark).keep(g)
    points = M.diracs(g, F.col("batch"), F.round(F.col("pos") * 100).cast("long"), F.col("pos"), F.col("w"))
    return points, M.for_batches(M.histogram(g, "pos", times="n"), points).select("batch", "cell_id", "x0", "x1", "y")


def order_points(spark, d):
    return M.diracs(read(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_totalprice"))


def order_target(spark, d):
    o = read(spark, d, "orders")
    return M.for_batches(M.histogram(o, "o_totalprice"), order_points(spark, d)).select("batch", "cell_id", "x0", "x1", "y")


# ---- the same in SQL -------------------------------------------------------

POINTS = {
    "events": "SELECT event_type AS batch, event_id AS id, value AS pos, CAST(1 AS DOUBLE) AS w FROM events",
    "lineitem": "SELECT l_returnflag AS batch, CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_extendedprice AS pos, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 3",
    "orders": "SELECT o_orderpriority AS batch, o_orderkey AS id, o_totalprice AS pos, CAST(1 AS DOUBLE) AS w FROM orders",
}
_VALUE = {"events": ("events", "value"), "lineitem": ("lineitem", "l_extendedprice"), "orders": ("orders", "o_totalprice")}


def histogram_sql(table: str, value: str, bins: int = 64) -> str:
    """CTEs hb(lo, dw) and hist(cell_id, x0, x1, y)."""
    return f"""hb AS (SELECT min({value}) AS lo, max({value}) AS hi, (max({value}) - min({value})) / {bins} AS dw FROM {table}),
hn AS (SELECT CAST(least(floor(({value} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS cell_id, CAST(count(*) AS DOUBLE) AS y FROM {table}, hb WHERE {value} IS NOT NULL GROUP BY 1),
hist AS (SELECT CAST(r.range AS INTEGER) AS cell_id, lo + r.range * dw AS x0, lo + (r.range + 1) * dw AS x1, coalesce(hn.y, 0) AS y FROM range({bins}) r CROSS JOIN hb LEFT JOIN hn ON hn.cell_id = r.range)"""


def plan_sql(name: str) -> str:
    """WITH ... the CTEs d, t, dn (q0), tn (m, c0) and pieces of a transport problem."""
    return f"""WITH d AS ({POINTS[name]}), {histogram_sql(*_VALUE[name])},
t AS (SELECT b.batch, h.* FROM (SELECT DISTINCT batch FROM d) b, hist h),
dm AS (SELECT batch, sum(w) AS mass FROM d GROUP BY 1), tm AS (SELECT batch, sum(y * (x1 - x0)) AS mass FROM t GROUP BY 1),
dw AS (SELECT d.batch, id, pos, d.w / mass AS w FROM d JOIN dm USING (batch) WHERE d.w > 0),
dn AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY batch ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM dw),
tw AS (SELECT t.batch, cell_id, x0, x1, y / mass AS y, y / mass * (x1 - x0) AS m FROM t JOIN tm USING (batch)),
tn AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY batch ORDER BY x0, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0 FROM tw),
u AS (SELECT batch, q0 AS q, 0 AS kind, pos AS spot, id, pos, w, NULL AS cell_id, NULL AS x0, NULL AS x1, NULL AS y, NULL AS m, NULL AS c0 FROM dn
  UNION ALL SELECT batch, c0, 1, x0, NULL, NULL, NULL, cell_id, x0, x1, y, m, c0 FROM tn WHERE m > 0),
f AS (SELECT batch, q AS q0, coalesce(lead(q) OVER o, 1.0) AS q1,
  last_value(id IGNORE NULLS) OVER p AS id, last_value(pos IGNORE NULLS) OVER p AS pos, last_value(w IGNORE NULLS) OVER p AS w,
  last_value(cell_id IGNORE NULLS) OVER p AS cell_id, last_value(x0 IGNORE NULLS) OVER p AS x0, last_value(x1 IGNORE NULLS) OVER p AS x1,
  last_value(y IGNORE NULLS) OVER p AS y, last_value(m IGNORE NULLS) OVER p AS m, last_value(c0 IGNORE NULLS) OVER p AS c0
  FROM u WINDOW o AS (PARTITION BY batch ORDER BY q, kind, spot, id, cell_id), p AS (PARTITION BY batch ORDER BY q, kind, spot, id, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pieces AS (SELECT batch, id, cell_id, pos, w, q0, q1, y, x0 + (q0 - c0) * (x1 - x0) / m AS l, x0 + (q1 - c0) * (x1 - x0) / m AS r, q1 - q0 AS dm
  FROM f WHERE q1 > q0 AND pos IS NOT NULL AND x0 IS NOT NULL)"""
