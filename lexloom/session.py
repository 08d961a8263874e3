"""Session set-up, lineage cutting and shared folders."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Python workers are kept between tasks: large blocks go back to the system, up to 32 MB of small ones stay for the next piece of text.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and set a checkpoint folder only where the session has none.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors share; the temporary
    folder below serves local sessions alone.
    """
    context = spark.sparkContext
    for name, value in WORKER.items():
        context.environment.setdefault(name, os.environ.get(name, value))
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-checkpoint-"))
    return spark


def folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share."""
    prepare(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


class Tables:
    """Tables written once to the shared folder, as columns, and read as often as wanted, until they are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{folder(spark)}/tables-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables (all of them without a name) and let Spark remove the shuffle files that nothing refers to."""
        for at in [f"{self.at}/{n}" for n in names] or [self.at]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the plans that made them are collected; that need not wait for memory to run short."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder: later stages neither recompute nor lose them."""
    prepare(df.sparkSession)
    return df.checkpoint()
