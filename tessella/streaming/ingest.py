"""Resumable, idempotent ingestion: file streams with checkpoints, and batches that skip what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """New parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends to ``target`` the rows whose key it does not hold yet; a restart goes on where it ended.

    Each micro-batch is joined against the target's keys only. Its rows are deduplicated first, and a
    batch that is replayed after a failure finds its rows there, so nothing is written twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        rows = transform(rows) if transform else rows
        try:
            done = spark.read.parquet(target).select(key)
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        (rows.join(done, key, "left_anti") if done is not None else rows).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still without output."""
    return todo.join(done.select(key), key, "left_anti")


def replay(todo: DataFrame, done: DataFrame, key: str, value: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every key with its earlier value if there is one, else the value made now; only the missing ones are made."""
    old = done.select(key, value)
    return todo.select(key).join(old, key).unionByName(make(resume(todo, done, key)).select(key, value))


def shard_of(row: str, total: int, shards: int):
    """Shard of a row number from 1: ceil(total / shards) consecutive rows each."""
    return F.floor((F.col(row) - 1) / -(-total // shards)).cast("int")
