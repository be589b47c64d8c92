"""Sub- and superscripts: low runs of text that belong to a taller run close above or below them.

Heights and gaps make a band in y, so runs meet by equal cells of it, not all with all. A run goes to one taller run
only, the nearest; if that one is absorbed itself, so is all that it took. Heights fall along such a chain, so it
has an end, which pointer doubling finds in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import cut

#: A run takes one of less than HEIGHT of its height, if less than GAP of that one's height lies between.
HEIGHT, GAP = 0.8, 0.6
CELL = 32.0  # units of y; heights decide only how many cells a run reaches into


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL).cast("bigint"), F.floor(high / CELL).cast("bigint")))


def absorbing(runs: DataFrame) -> DataFrame:
    """id, taker and gap of each run that another one takes: the nearest, of equally near ones the tallest, then the first id.

    ``runs`` has id, page, col, y (of the upper edge) and h. Runs meet within a page's column.
    """
    tall = runs.select("page", "col", F.col("id").alias("taker"), F.col("y").alias("y_a"), F.col("h").alias("h_a"), _cells(F.col("y"), F.col("y") + F.col("h")).alias("cell"))
    low = runs.select("page", "col", "id", "y", "h", _cells(F.col("y") - GAP * F.col("h"), F.col("y") + (1 + GAP) * F.col("h")).alias("cell"))
    gap = F.when(F.col("y") < F.col("y_a"), F.col("y_a") - (F.col("y") + F.col("h"))).otherwise(F.col("y") - (F.col("y_a") + F.col("h_a")))
    met = low.join(tall, ["page", "col", "cell"]).where((HEIGHT * F.col("h_a") > F.col("h")) & (gap < GAP * F.col("h")))
    nearest = met.groupBy("id").agg(F.min(F.struct(gap.alias("gap"), (-F.col("h_a")).alias("h"), "taker")).alias("m"))
    return nearest.select("id", F.col("m.taker").alias("taker"), F.col("m.gap").alias("gap"))


def absorb(runs: DataFrame) -> DataFrame:
    """``runs`` with ``owner`` (the run at the end of its chain, itself if none takes it) and ``steps`` on the way there."""
    step = absorbing(runs).select("id", F.col("taker").alias("owner"), F.lit(1).cast("bigint").alias("steps"))
    while True:
        step = cut(step, "absorbed")
        ahead = step.select(F.col("id").alias("owner"), F.col("owner").alias("_next"), F.col("steps").alias("_more"))
        met = step.join(ahead, "owner", "left")
        if met.where("_next IS NOT NULL").isEmpty():
            break
        step = met.select("id", F.coalesce("_next", "owner").alias("owner"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"))
    return runs.join(step, "id", "left").withColumn("owner", F.coalesce("owner", "id")).withColumn("steps", F.coalesce("steps", F.lit(0)).cast("bigint"))
