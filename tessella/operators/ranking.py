"""Positions and running sums over a whole table, without one task that orders all of it.

The input is written once. Its rows are dealt to ranges of the order by Spark's range partitioning and written with the
number of their range; each range is ordered in its own task, and starts where the ranges before it end. Only one
count or sum of every range meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import bytes_of, cut

RANGE_BYTES = 32_000_000  # of a range as it is written


def with_ranges(df: DataFrame, order: list[str], ranges: int | None = None, name: str = "range") -> DataFrame:
    """``df`` with the number of the range that a row's place in the order falls into; nulls come first.

    Ranges are as many as the bytes ask for, and at least as many as shuffle partitions. Rows that ``order`` does not
    tell apart share a range. Which range a row falls into is decided once: the result is a written table.
    """
    held = cut(df, "ranked")
    wanted = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-bytes_of(held) // RANGE_BYTES))
    return cut(held.repartitionByRange(wanted, *order).withColumn(name, F.spark_partition_id()), "ranged")


def with_running(df: DataFrame, order: list[str], by: list[str] | None = None, weight: Column | None = None, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with the running sum of ``weight`` (1: the row's number) up to and with each row of its group.

    ``order`` names columns, ascending, that together tell rows apart; ``by`` names those of the group. Rows that
    ``order`` does not tell apart get different numbers in no fixed order. An empty table stays empty.
    """
    key = [*(by or []), "_range"]
    ranged = with_ranges(df.withColumn("_weight", F.lit(1).cast("bigint") if weight is None else weight), [*(by or []), *order], ranges, "_range")
    sums = ranged.groupBy(*key).agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = F.sum("_weight").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    met = ranged.withColumn("_within", within).join(starts, same)
    return met.select(*[F.col(c) for c in df.columns], (F.col("_start") + F.col("_within")).cast("bigint").alias(name))
