"""Live frames: keyed upsert, snapshot then updates.

frames: (sim, context, coordinates, arrival, payload ...).  Publishing again
under the same coordinates replaces the frame and keeps its first place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

KEY = ["sim", "context", "coordinates"]
c = F.col


def latest(frames: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The last arrival of each key with ``place``, its first arrival.

    A combined max over structs: a key published very often never meets in one task.
    """
    rest = [k for k in frames.columns if k not in key]
    order = ["arrival", *(k for k in rest if k != "arrival")]
    g = frames.groupBy(*key).agg(F.max(F.struct(*order)).alias("f"), F.min("arrival").alias("place"))
    return g.select(*key, *(c("f").getField(k).alias(k) for k in order), "place")


def updates(frames: DataFrame, since: int) -> DataFrame:
    """What a subscriber who saw arrivals up to ``since`` still has to get."""
    return latest(frames).where(c("arrival") > since)


def validate(points: DataFrame) -> DataFrame:
    """frames of points (x, y) or disks (x, y, r); others raise when read."""
    ok = c("x").isNotNull() & c("y").isNotNull() & F.when(c("marker") == "points", c("r").isNull()).when(c("marker") == "disks", c("r") > 0).otherwise(False)
    return points.withColumn("x", F.when(ok, c("x")).otherwise(F.raise_error(F.concat(F.lit("bad frame row for "), c("coordinates")))))


def register(kinds: list[tuple[str, str]]) -> dict[str, str]:
    """name -> kind of contexts; a name twice or a kind other than canvas is an error."""
    out: dict[str, str] = {}
    for name, kind in kinds:
        if kind != "canvas":
            raise ValueError(f"no such kind: {kind}")
        if name in out:
            raise ValueError(f"{name} is there already")
        out[name] = kind
    return out


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str] = KEY, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Merge every micro-batch into a table of latest frames, one version folder a batch.

    A batch that is run again after a failure writes the same version again, so
    the table is exact; readers take the greatest finished version.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("place", c("arrival"))
        old = read_version(spark, path, n - 1)
        both = new if old is None else old.unionByName(new)
        rest = [k for k in batch.columns if k not in key]
        order = ["arrival", *(k for k in rest if k != "arrival")]
        g = both.groupBy(*key).agg(F.max(F.struct(*order)).alias("f"), F.min("place").alias("place"))
        g.select(*key, *(c("f").getField(k).alias(k) for k in order), "place").write.mode("overwrite").parquet(f"{path}/version={n}")
        on_batch and on_batch(batch, n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark, path: str, n: int) -> DataFrame | None:
    """The table as of batch n, or None before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS")
    if n < 0 or not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(f"{path}/version={n}")


# ---- keyed state ---------------------------------------------------------------------


class _Kept(StatefulProcessor):
    """Each key's latest frame and first place; what changes it goes on."""

    def __init__(self, key: list[str], rest: StructType):
        self.key, self.rest = key, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", StructType([*self.rest, StructField("place", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.rest.fieldNames()
        old = self.kept.get() if self.kept.exists() else None
        best, place = (tuple(old)[:-1], old[-1]) if old is not None else (None, None)
        at, changed = names.index("arrival"), False
        for batch in rows:  # a key's rows of one micro-batch, in Arrow batches
            batch = batch[names].dropna(subset=["arrival"]).reset_index(drop=True)
            if not len(batch):
                continue
            first = int(batch["arrival"].min())
            top = [batch.at[batch["arrival"].idxmax(), n] for n in names]
            top[at] = int(top[at])
            if place is None or first < place:
                place, changed = first, True
            if best is None or top[at] >= best[at]:
                best, changed = tuple(v.item() if hasattr(v, "item") else v for v in top), True
        if changed and best is not None:
            self.kept.update((*best, place))
            yield pd.DataFrame([(*key, *best, place)], columns=[*self.key, *names, "place"])

    def close(self) -> None:
        pass


def keep_latest(stream: DataFrame, key: list[str] = KEY) -> DataFrame:
    """A stream of changes: (key, arrival, payload, place) of keys whose latest frame or first place is new.

    Frames are kept in keyed state, so a micro-batch costs as much as its own
    rows and keys, however many frames there are.  A key published very often is
    one group of a micro-batch; it is read in Arrow batches, and one frame of it
    is held.  Rows without an arrival change nothing.
    """
    rest = StructType([f for f in stream.schema if f.name not in key])
    if "arrival" not in rest.fieldNames():
        raise ValueError("frames need an arrival")
    out = StructType([*(stream.schema[k] for k in key), *rest, StructField("place", LongType())])
    return stream.groupBy(*key).transformWithStateInPandas(_Kept(key, rest), out, "append", "none")


def state_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str] = KEY) -> StreamingQuery:
    """Changes of ``keep_latest`` appended to a Parquet log, exactly once.

    The session's state store must be the one in RocksDB (``use_rocksdb``).
    """
    return keep_latest(stream, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The latest frame of every key with its place, read from the stream's state: a row per key."""
    return spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint).select("key.*", "value.*")


def since(spark: SparkSession, path: str, arrival: int, key: list[str] = KEY) -> DataFrame:
    """What a subscriber who saw arrivals up to ``arrival`` still has to get, from the log; the filter reaches the files."""
    return latest_change(spark.read.parquet(path).where(c("arrival") > arrival), key)


def latest_change(log: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The last change of each key."""
    rest = [k for k in log.columns if k not in key]
    order = ["arrival", "place", *(k for k in rest if k not in ("arrival", "place"))]
    g = log.groupBy(*key).agg(F.max(F.struct("arrival", (-c("place")).alias("_early"), *order[2:])).alias("f"))
    return g.select(*key, c("f.arrival").alias("arrival"), *(c("f").getField(k).alias(k) for k in order[2:]), (-c("f._early")).alias("place"))
