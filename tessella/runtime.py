"""What a session needs beyond the DataFrame API: this package in Python workers, and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_private: dict[str, str] = {}
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python workers can import it anywhere."""
    own = spark.sparkContext.applicationId
    if own not in _shipped:
        folder = tempfile.mkdtemp(prefix="tessella-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tessella-{own}", "zip", ROOT, "tessella"))
        _shipped.add(own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; on one machine, where it is unset, a private one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.sparkContext.applicationId
    if own not in _private:
        _private[own] = tempfile.mkdtemp(prefix="tessella-shared-")
        atexit.register(shutil.rmtree, _private[own], ignore_errors=True)
    return _private[own]


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Lets a folder go when the application ends; results read it lazily, so it can't go before."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again, so that it is computed once and
    lost executors find it there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of a table's bytes; that of a table just written is its files' size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
