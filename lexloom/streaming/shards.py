"""Shard-at-a-time processing of arriving files, and polling for work that was not done."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

Transform = Callable[[DataFrame], DataFrame]


def run_available(source: DataFrame, consumers: Mapping[str, Transform], out: str, marks: str) -> None:
    """Run everything that has arrived through all consumers, then stop.

    A batch is read once for all of them (it is kept while it is worked on), and each overwrites its own folder ``<out>/<name>/batch=<n>``, so
    a batch that runs again after a failure leaves no copies. The checkpoint at ``marks`` says what is done.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, transform in consumers.items():
                transform(batch).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            batch.unpersist()

    source.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def available_now(source: DataFrame, transform: Transform, out: str, marks: str) -> None:
    """``run_available`` with one consumer, in ``<out>/batch=<n>``."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def arriving(spark: SparkSession, path: str, schema, files: int = 1, archive: str | None = None, delete: bool = False) -> DataFrame:
    """A stream of Parquet shards, ``files`` a batch; shards that are done are moved to ``archive`` or deleted."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif delete:
        reader = reader.option("cleanSource", "delete")
    return reader.parquet(path)


def poll(found: DataFrame, score: Transform, at: str, keys: list[str]) -> int:
    """Score what was never found before, and return how many rows that is. Results are in ``<at>/done``, each key once.

    What polling finds is appended to an inbox, and a stream over it keeps the keys it has seen as state (deduplication) and writes to a sink that
    lists each batch once. So a poll that is killed anywhere goes on where its checkpoint is: work that is found twice, or a batch that is
    written but not committed, leaves no copy.
    """
    spark = found.sparkSession
    found.write.mode("append").parquet(f"{at}/inbox")
    work = spark.readStream.schema(found.schema).parquet(f"{at}/inbox").dropDuplicates(keys)
    rows = score(work)
    before = scored(spark, at, rows.schema).count()
    rows.writeStream.format("parquet").option("path", f"{at}/done").option("checkpointLocation", f"{at}/marks").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return scored(spark, at, rows.schema).count() - before


def scored(spark: SparkSession, at: str, schema) -> DataFrame:
    """What polling at ``at`` has scored so far."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/done")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{at}/done")
