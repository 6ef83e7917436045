"""Running sums whose windows stay bounded, and inclusive helpers.

A window over one key is one task.  ``running_sum`` cuts each key's rows into
quantile buckets first, so a key with most of the rows is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massflow.functions.stored import Store

#: Rows of one key that one window is planned for.
WINDOW_ROWS = 250_000


def buckets_for(df: DataFrame, key: str) -> int:
    """Buckets (a power of two) that bound the windows of the largest key."""
    most = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return 1 << max(0, math.ceil(math.log2(max(1, most / WINDOW_ROWS))))


def _dealt(df: DataFrame, key: str, by: str, buckets: int) -> DataFrame:
    """df with _bucket, the quantile of ``by`` (numeric) in its key; rows that tie share a bucket.

    The cuts are written: approximate quantiles depend on the order in which
    parts are merged, and every reader of the buckets must see the same ones.
    """
    cuts = df.groupBy(key).agg(F.percentile_approx(by, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
    cuts = Store(df.sparkSession).keep(cuts)  # a row per key
    return df.join(cuts, key).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(by)))).drop("_cuts")


def following(df: DataFrame, key: str, order: list[str], values: dict[str, str], buckets: int = 1) -> DataFrame:
    """df with out = value of the next row in order, null for a key's last row.

    A bucket's last row gets the first value of the next bucket that has rows.
    """
    if buckets <= 1:
        w = Window.partitionBy(key).orderBy(*order)
        return df.select("*", *(F.lead(v).over(w).alias(o) for o, v in values.items()))
    dealt = _dealt(df, key, order[0], buckets)
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    heads = dealt.groupBy(key, "_bucket").agg(F.min(F.struct(*order, *(F.col(v).alias(f"_{o}") for o, v in values.items()))).alias("_head"))
    after = Window.partitionBy(key).orderBy("_bucket")  # a row per bucket
    heads = heads.select(key, "_bucket", F.lead("_head").over(after).alias("_head"))
    out = dealt.join(heads, [key, "_bucket"])
    return out.select(*df.columns, *(F.when(F.row_number().over(w) < F.count(F.lit(1)).over(Window.partitionBy(key, "_bucket")), F.lead(v).over(w)).otherwise(F.col(f"_head._{o}")).alias(o) for o, v in values.items()))


def running_sum(df: DataFrame, key: str, order: list[str], values: dict[str, str | Column], buckets: int = 1, exclusive: bool = True) -> DataFrame:
    """df with out = sum of value over the rows before (or up to) each row in order, per key.

    order[0] must be numeric when buckets > 1; rows that tie on it share a bucket.
    """
    end = -1 if exclusive else 0
    if buckets <= 1:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *(F.coalesce(F.sum(v).over(w), F.lit(0.0)).alias(o) for o, v in values.items()))
    dealt = _dealt(df, key, order[0], buckets)
    totals = dealt.groupBy(key, "_bucket").agg(*(F.sum(v).alias(f"_{o}") for o, v in values.items()))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_bucket", *(F.coalesce(F.sum(f"_{o}").over(before), F.lit(0.0)).alias(f"_{o}") for o in values))
    w = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = dealt.join(totals, [key, "_bucket"])
    return out.select(*df.columns, *((F.col(f"_{o}") + F.coalesce(F.sum(v).over(w), F.lit(0.0))).alias(o) for o, v in values.items()))
