"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import itertools
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where a session on one machine names none (tests) a temporary one is
    set; on a cluster that is an error, as executors would not share it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        known = tempfile.mkdtemp(prefix="massflow-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a sized table that one task writes, about, and tasks that write one at least.
TASK_BYTES, LEAST_TASKS = 16 << 20, 12
#: The most that Spark takes as a number of partitions.
MOST_TASKS = (1 << 31) - 1


def few(df: DataFrame, size: int) -> DataFrame:
    """df in as few partitions as its bytes need: the session's shuffles may have many more.

    A size may be a bound far over the bytes, such as one by a bucket's open pairs.
    """
    return df.coalesce(min(max(LEAST_TASKS, -(-size // TASK_BYTES)), MOST_TASKS))


def cut(df: DataFrame, *partitions: str, size: int | None = None) -> DataFrame:
    """Lineage cut by a written table in the shared folder, which survives lost executors.

    Where ``partitions`` (columns of few values) are named, a filter on them reads its own files only.
    ``size``: bytes of df, or of what its last stage reads if that is more, about.
    Small tables are then written by few tasks, however many the session's shuffles have.
    """
    spark = df.sparkSession
    if size is not None:
        df = few(df, size)
    path = work_path(spark, "cut")
    if _open:
        _open[-1].paths.append(path)
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Work tables that are cut inside are deleted at its end, but for those cut by ``last``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def last(self, df: DataFrame, size: int | None = None) -> DataFrame:
        """df written, in a table that stays: what is read after the end rests on such tables only."""
        kept = cut(df, size=size)
        self.paths.pop()
        return kept

    def __exit__(self, *failed) -> None:
        _open.remove(self)
        for path in self.paths:
            remove(self.spark, path)


_open: list[Scratch] = []


def with_position(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df with each row's place, from 0, in the files that df is read from, and one more than the last place.

    Files come in order of their part numbers, then paths.  A row's place counts
    what is read or not before it in its file, so places of a filtered frame may
    have gaps, but no two rows have one.  A frame that is not plainly read from
    Parquet files is written to some first.
    """
    spark = df.sparkSession

    def placed(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    try:
        at = placed(df)
    except AnalysisException:
        at = placed(cut(df))
    files = [(r["__file"], r["n"]) for r in at.groupBy("__file").agg((F.max("__row") + 1).alias("n")).collect()]  # one row per file
    files.sort(key=lambda f: (int(found[1]) if (found := re.match(r"part-(\d+)", f[0].rsplit("/", 1)[-1])) else 0, f[0]))
    ahead = [0, *itertools.accumulate(n for _, n in files)]
    first = spark.createDataFrame([(f, a) for (f, _), a in zip(files, ahead)], "__file string, __ahead long")
    return at.join(F.broadcast(first), "__file").withColumn(name, F.col("__ahead") + F.col("__row")).drop("__file", "__row", "__ahead"), ahead[-1]


#: Bytes of one Arrow batch between the JVM and Python: buffers grow by doubling, outside the heap, one set a task.
BATCH_BYTES = 8 << 20


_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of an Arrow batch to BATCH_BYTES; a lower one stays.

    The default bound is 64 MB.  Results do not depend on it.
    """
    known = spark.conf.get(_BOUND, None) or ""
    if not known.removesuffix("b").isdigit() or int(known.removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


@contextmanager
def bounded_batches(spark: SparkSession):
    """Arrow batches are bounded inside; the session's own setting holds again at its end.  For work that ends inside."""
    known = spark.conf.get(_BOUND, None)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.unset(_BOUND) if known is None else spark.conf.set(_BOUND, known)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table once nothing will read it again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Give freed memory back to the system: allocators else keep what a large batch took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
