"""Session helpers shared by every operator: scratch tables, code shipping, input tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be of any scheme Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master a temporary one where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="massif-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        sc.setCheckpointDir(base)
    return base


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table cuts the lineage and survives a lost executor, as its files lie outside any executor.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/massif-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # the written table stands for its shuffles, whose files can go at once
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._massif_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._massif_path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that functions in tasks can import it."""
    sc = spark.sparkContext
    # texts can be long: what a Python worker holds at once is bounded by bytes, not by rows
    spark.conf.set(BATCH_BYTES, str(4 << 20))
    if getattr(sc, "_massif_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="massif-ship-")
    sc.addPyFile(shutil.make_archive(os.path.join(tmp, "massif_pkg"), "zip", os.path.dirname(here), os.path.basename(here)))
    sc._massif_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
