"""What the operators of this part share: reading, cutting lineage, batches of bounded size."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessella.runtime import gone_at_end, shared_dir, ship_code

__all__ = ["by_chars", "cut", "drop", "map_batches", "shared_dir", "ship_code", "ship_file", "shuffles_freed", "table", "texts", "unused", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to the executors; ``SparkFiles.get`` finds it in a worker by the name that this returns."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read again, and its path. ``options`` are the parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    gone_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``written``: later jobs and lost executors find the table there instead of computing it once more. Results
    read it lazily, so it goes when the application ends."""
    return written(df, name, **options)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """While it holds, the shuffle files of a written table go once it is written, not with the driver's garbage."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


ROWS_AT_ONCE = 1_000


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers. Spark bounds a batch's bytes (64 MB unless the session
    says otherwise); ``fn`` gets ``ROWS_AT_ONCE`` rows of it at a time, and cuts what needs less with ``by_chars``."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from fn(b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Returns a worker's free memory to the system: workers outlive their tasks, and what they keep adds up.
    Arrays of a megabyte or more are to go as soon as they are dropped (glibc's option -3)."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 1 << 20)
        libc.malloc_trim(0)


def by_chars(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of ``column`` come to about ``most`` bytes at a time (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)


def texts(column: pa.Array) -> list[str]:
    """Texts of a string column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]
