"""Cut lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only a local session without that setting (tests on one machine) gets a temporary folder; on a cluster its lack is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_dir named, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    Spark deletes the files of checkpoints that nothing refers to any more where the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, at: str, mode: str = "error") -> None:
    """Writes a table; the files of its shuffles go when it is there, not when the driver next collects garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").parquet(at)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Steps:
    """Cuts lineage with written tables, for loops. A reread table has the size of its files; a checkpoint keeps what the
    planner estimated, and the estimates of joins of joins grow with each round until they slow the planner down.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        at = fresh_dir(self.spark, "step")
        df.write.parquet(at)
        self.made.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        """Deletes the tables; nothing may read them any more."""
        for at in self.made:
            drop_dir(self.spark, at)
        self.made = []
