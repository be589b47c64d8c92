"""Writers of line files and their readers: whole texts, shards named by range, token ids, aligned pairs and files.

A row's place is a column, so readers need no file order: lines come back sorted by it. Files are
written by Spark's committer, so a lost executor's task leaves nothing half written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, line: str = "line") -> None:
    """Replaces ``path`` by line files of ``line``; null is an empty line, line breaks inside become blanks."""
    rows.select(_flat(line).alias("value")).write.mode("overwrite").text(path)


def write_shards(rows: DataFrame, path: str, size: int, place: str = "place", line: str = "line") -> None:
    """Line files in one folder for each range of ``size`` places, ``shard=n_start_end`` (end exclusive), in order of place."""
    n = F.floor(F.col(place) / size)
    name = F.concat_ws("_", n, n * size, (n + 1) * size)
    dealt = rows.select(name.alias("shard"), F.col(place).alias("p"), _flat(line).alias("value")).repartitionByRange("p")
    dealt.sortWithinPartitions("shard", "p").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)


def write_ids(rows: DataFrame, path: str, ids: str = "ids") -> None:
    """Token ids, separated by tabs, a line for each row; no ids give an empty line."""
    write_lines(rows.select(F.array_join(F.col(ids).cast("array<string>"), "\t").alias("line")), path)


def write_pairs(rows: DataFrame, path: str, left: str, right: str) -> None:
    """Both sides of each pair on one line, separated by a tab; tabs and line breaks inside become blanks."""
    side = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ")
    rows.select(F.concat_ws("\t", side(left), side(right)).alias("value")).write.mode("overwrite").text(path)


def write_aligned(rows: DataFrame, path: str, sides: list[str], size: int, place: str = "place") -> None:
    """A folder of files for each side, in which the same line of the same file belongs together: ``size`` places a file, in order.

    Every side is written by itself, so no line depends on how the other one's was; null is an empty line. Readers take a file
    whole, so ``size`` bounds what they hold.
    """
    n = F.floor(F.col(place) / size)
    for side in sides:
        dealt = rows.select(n.alias("shard"), F.col(place).alias("p"), _flat(side).alias("value")).repartition("shard")
        dealt.sortWithinPartitions("shard", "p").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(f"{path}/{side}")


def read_aligned(spark: SparkSession, path: str, sides: list[str]) -> DataFrame:
    """shard, line_no (from 0 in each file) and the sides of ``write_aligned``, joined by file and line."""
    joined = None
    for side in sides:
        files = spark.read.schema("value string, shard bigint").text(f"{path}/{side}", wholetext=True)
        lines = files.select("shard", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)).alias("line_no", side))
        joined = lines if joined is None else joined.join(lines, ["shard", "line_no"], "full")
    return joined


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Token ids of each line of a file as ``write_ids`` leaves it; an empty line has none."""
    lines = spark.read.schema("value string").text(path)
    return lines.select(F.transform(F.filter(F.split("value", "\t"), lambda x: x != ""), lambda x: x.cast("int")).alias("ids"))


def _flat(column: str):
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\r\n]+", " ")
