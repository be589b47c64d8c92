"""Which region of its page a point belongs to, by a sweep over stripes instead of a meeting of all points with all regions.

A page is cut into vertical stripes. A stripe's points meet the regions that reach into it; of the regions further left
only those count that no later region of a smaller top outdoes: a staircase of few steps. In a stripe, points and regions
are swept from left to right, with two structures over the heights: one answers which region is the last of those
that began and lie above, the other which is the last of those around the point.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import cut, ship_code

STRIPE = 64.0  # units of x
POINTS_AT_ONCE = 100_000  # of one stripe in one task

INSIDE, LEFT_ABOVE, LEFT, ABOVE, ANY, NONE = 0, 1, 2, 3, 4, -1


class PrefixLast:
    """Regions by top: the last region with a top of at most y, as regions come in (a Fenwick tree of maxima)."""

    def __init__(self, tops: list[float]):
        self.tops = sorted(set(tops))
        self.tree = [NONE] * (len(self.tops) + 1)

    def add(self, top: float, region: int) -> None:
        k = bisect_left(self.tops, top) + 1
        while k < len(self.tree):
            self.tree[k] = max(self.tree[k], region)
            k += k & -k

    def last(self, y: float) -> int:
        k, found = bisect_right(self.tops, y), NONE
        while k:
            found = max(found, self.tree[k])
            k -= k & -k
        return found


class Around:
    """Regions by their interval of y: the last one around y that has not ended yet (a segment tree of heaps).

    ``x`` only grows from question to question, so what has ended is thrown away when it comes to the top.
    """

    def __init__(self, edges: list[float]):
        self.edges = sorted(set(edges))
        self.size = 2 * len(self.edges) + 1  # each edge and each gap between edges
        self.heaps: list[list] = [[] for _ in range(2 * self.size)]

    def add(self, top: float, bottom: float, right: float, region: int) -> None:
        a, b = 2 * bisect_left(self.edges, top) + 1 + self.size, 2 * bisect_left(self.edges, bottom) + 2 + self.size
        while a < b:
            if a & 1:
                heapq.heappush(self.heaps[a], (-region, right))
                a += 1
            if b & 1:
                b -= 1
                heapq.heappush(self.heaps[b], (-region, right))
            a, b = a >> 1, b >> 1

    def last(self, x: float, y: float) -> int:
        k = bisect_right(self.edges, y)
        at = 2 * k - 1 if k and self.edges[k - 1] == y else 2 * k
        at, found = at + self.size, NONE
        while at:
            heap = self.heaps[at]
            while heap and heap[0][1] < x:
                heapq.heappop(heap)
            if heap:
                found = max(found, -heap[0][0])
            at >>= 1
        return found


def sweep(points: list[tuple[float, float]], near: list[tuple], left: list[tuple[float, int]], page: list[tuple[float, int]]) -> list[tuple[int, int]]:
    """(kind, region) of each point. ``near`` are (left, right, top, bottom, region), ``left`` and ``page`` the staircases
    (top, region) of the regions that end before the stripe, or begin before it, and of all of the page."""
    above = PrefixLast([t for _, _, t, _, _ in near] + [t for t, _ in left])
    anywhere = PrefixLast([t for t, _ in page])
    around = Around([e for _, _, t, b, _ in near for e in (t, b)])
    for t, r in left:
        above.add(t, r)
    for t, r in page:
        anywhere.add(t, r)
    began, last_of_page = max((r for _, r in left), default=NONE), max((r for _, r in page), default=NONE)
    out: list[tuple[int, int]] = [(NONE, NONE)] * len(points)
    coming, k = sorted(near), 0
    for i in sorted(range(len(points)), key=points.__getitem__):
        x, y = points[i]
        while k < len(coming) and coming[k][0] <= x:
            _, right, top, bottom, region = coming[k]
            above.add(top, region)
            if top <= bottom:
                around.add(top, bottom, right, region)
            began, k = max(began, region), k + 1
        answers = ((INSIDE, around.last(x, y)), (LEFT_ABOVE, above.last(y)), (LEFT, began), (ABOVE, anywhere.last(y)), (ANY, last_of_page))
        out[i] = next((a for a in answers if a[1] != NONE), (NONE, NONE))
    return out


def _stairs(regions: DataFrame, by: list[str]) -> DataFrame:
    """The regions that are later than all others of at most their top."""
    w = Window.partitionBy(*by).orderBy("top", F.desc("region")).rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("_before", F.max("region").over(w)).where(F.col("_before").isNull() | (F.col("region") > F.col("_before"))).drop("_before")


def _stripe(x: Column) -> Column:
    return F.floor(x / STRIPE).cast("bigint")


def locate(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``points`` (id, page, x, y) with ``kind`` and ``region``: the last region around the point (0), else the last that begins
    to its left and above (1), to its left (2), above (3), else the page's last (4); -1 and -1 on a page without any.

    ``regions`` has page, region (from 0, larger is later), left, right, top, bottom, edges included. Pages are not null.
    """
    ship_code(points.sparkSession)
    points = cut(points.select("id", "page", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("stripe", _stripe(F.col("x"))), "region-points")
    box = [F.col(c).cast("double").alias(c) for c in ("left", "right", "top", "bottom")]
    regions = cut(regions.select("page", F.col("region").cast("bigint").alias("region"), *box), "regions")
    counted = points.groupBy("page", "stripe").agg(F.ceil(F.count("*") / POINTS_AT_ONCE).cast("bigint").alias("slices"))
    stripes = cut(counted, "region-stripes")
    begins = regions.withColumn("begin", _stripe(F.col("left")))
    own = _stairs(begins, ["page", "begin"]).select("page", "begin", "top", "region")
    before = own.join(stripes.select("page", "stripe"), "page").where("begin < stripe")
    before = _stairs(before, ["page", "stripe"]).select("page", "stripe", F.lit("left").alias("role"), "top", "region")
    page = _stairs(own, ["page"]).join(stripes.select("page", "stripe"), "page").select("page", "stripe", F.lit("page").alias("role"), "top", "region")
    reach = F.sequence("begin", F.greatest(F.col("begin"), _stripe(F.col("right"))))
    near = begins.select("page", F.explode(reach).alias("stripe"), F.lit("near").alias("role"), "top", "region", "left", "right", "bottom")
    rows = near.unionByName(before, allowMissingColumns=True).unionByName(page, allowMissingColumns=True)
    rows = rows.join(stripes, ["page", "stripe"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))).drop("slices")
    dealt = points.join(stripes, ["page", "stripe"]).withColumn("slice", F.pmod(F.xxhash64("id", "x", "y"), F.col("slices"))).drop("slices")

    def run(some: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        of = lambda role, *columns: list(met.loc[met["role"] == role, list(columns)].itertuples(index=False, name=None))
        found = sweep(list(zip(some["x"].tolist(), some["y"].tolist())), [(*r[:4], int(r[4])) for r in of("near", "left", "right", "top", "bottom", "region")], of("left", "top", "region"), of("page", "top", "region"))
        return some[["id", "page", "x", "y"]].assign(kind=[k for k, _ in found], region=[r for _, r in found])

    schema = dealt.select("id", "page", "x", "y", F.lit(0).cast("bigint").alias("kind"), F.lit(0).cast("bigint").alias("region")).schema
    return dealt.groupBy("page", "stripe", "slice").cogroup(rows.groupBy("page", "stripe", "slice")).applyInPandas(run, schema)
