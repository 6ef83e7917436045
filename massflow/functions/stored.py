"""Written tables: lineage cut in the folder that driver and executors share.

A table in it survives lost executors, and a run that is started again on the
same folder goes on from the tables that are whole.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine that names none gets a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        known = tempfile.mkdtemp(prefix="massflow-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


class Store:
    """Named tables in one folder; a given folder is gone on with, else a new one is made."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def _hadoop(self, *name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *name)))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def has(self, name: str) -> bool:
        """Whether the table is there and whole."""
        files, p = self._hadoop(name, "_SUCCESS")
        return files.exists(p)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df written under the name, unless a whole table is there already."""
        if not self.has(name):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def keep(self, df: DataFrame) -> DataFrame:
        """df written under a name of its own."""
        return self.put(f"work-{uuid.uuid4().hex}", df)

    def drop(self, name: str) -> None:
        files, p = self._hadoop(name)
        files.delete(p, True)
