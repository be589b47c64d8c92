"""Readers for the provided tables and for line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One parquet table; any path that Spark itself can open."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def line_scan(df: DataFrame, text: str = "text", max_trailing: int = 4) -> DataFrame:
    """Lines of each row's text as ``line_no`` (from 0) and ``line``.

    The empty piece after a final newline is not a line; up to ``max_trailing`` empty lines at the
    end are dropped, empty lines further in stay. Null text has no lines. All work is inside the row,
    so nothing is shuffled.
    """
    body = F.regexp_replace(F.col(text), r"\n\z", "")
    lines = F.split(body, "\n", -1)
    return df.withColumn("_lines", lines).withColumn("_lines", _drop_trailing(F.col("_lines"), max_trailing)).select("*", F.posexplode("_lines").alias("line_no", "line")).drop("_lines")


def _drop_trailing(lines: Column, most: int) -> Column:
    """Removes at most ``most`` empty strings from the end of an array."""
    size = F.size(lines)
    tail = F.reverse(F.slice(lines, F.greatest(size - most + 1, F.lit(1)), F.lit(most)))
    kept_from = F.array_position(F.transform(tail, lambda x: x != ""), True)
    empty = F.when(kept_from > 0, kept_from - 1).otherwise(F.size(tail))
    return F.when(size > 0, F.slice(lines, F.lit(1), (size - empty).cast("int"))).otherwise(lines)
