"""Session helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session (tests, a notebook) that names none gets a temporary folder; on a cluster one must be named, since
    executors can't write where the driver alone reads.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = sc.getCheckpointDir()
    return found


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, a few tasks each: for work that is heavy per row on rows that fill few files."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    Unlike cached blocks or local checkpoints the written table outlives a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one job in a folder of their own, dropped once their successors are written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.held, self.count = spark, f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}", {}, 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """As ``stage``; a table of the same name before is dropped after the new one, which may read it, is written."""
        self.count += 1
        path, before = f"{self.path}/{name}-{self.count}", self.held.get(name)
        df.write.parquet(path)
        self.held[name] = path
        if before:
            self._remove(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.held.pop(name, None):
                self._remove(path)

    def close(self) -> None:
        """Drop all; what is still needed has to be staged elsewhere first."""
        self._remove(self.path)
        self.held.clear()

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
