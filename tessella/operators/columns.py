"""Where a page's columns are parted: border cells of its histogram, matched with an ideal grid.

Cells, their slopes and the candidates are windows over each page's histogram. Only the choice among a page's few candidates is
plain Python: pairs of a left and a right border first, then weaker evidence in turn, until there are enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.layout import interval_histogram, with_slopes
from tessella.runtime import ship_code

# What makes a border.
FEW, VERY_FEW, SPARSE = 5, 4, 2.0  # cells with fewer glyphs are thin
LEFT_SIGMAS, RIGHT_SIGMAS = 1.0, 1.5  # a steep step is so many deviations over the mean
EDGE_SHARE, NEAR_SHARE = 16, 4  # parts of a column's share: least mass beside a border, distance of borders that are one
THICK, THIN_BETWEEN = 0.7, 0.5  # mass of a column between neighbouring separators
STEEP, VERY_STEEP = 5, 12


class Cell(NamedTuple):
    cell: int
    x: float
    end_x: float
    n: int
    left_n: int
    right_n: int
    left_step: int
    right_step: int

    @property
    def middle(self) -> float:
        return (self.x + self.end_x) / 2


def with_all_cells(rows: DataFrame, key: str, start: str, end: str, size: int) -> DataFrame:
    """The histogram of a page's intervals with its empty cells, from the first cell to the last whole one, and slopes."""
    counted = interval_histogram(rows, key, start, end, size)
    extents = rows.groupBy(key).agg(F.floor(F.min(start) / size).cast("bigint").alias("first"), (F.floor(F.max(end) / size) - 1).cast("bigint").alias("last"))
    every = extents.where("first <= last").select(key, F.explode(F.sequence("first", "last")).alias("cell"))
    cells = every.join(counted, [key, "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return with_slopes(cells, key).withColumn("x", F.col("cell") * float(size)).withColumn("end_x", (F.col("cell") + 1) * float(size))


def candidates(cells: DataFrame, key: str, columns: int) -> DataFrame:
    """``cells`` with ``left``, ``right`` (places among the accepted borders of that side, null: none) and ``ranked_right`` (place among
    the best right borders, accepted or not)."""
    page = Window.partitionBy(key)
    mean, deviation = (lambda c: F.avg(c).over(page)), (lambda c: F.stddev_pop(c).over(page))
    low = F.col("mean_n") - F.col("sd_n")
    c = cells.withColumn("mean_n", mean("n")).withColumn("sd_n", deviation("n")).withColumn("wide", F.max("end_x").over(page) - F.min("x").over(page))
    thin = ((F.col("n") < low) & (F.col("n") < FEW)) | (F.col("n") == 0) | ((low < SPARSE) & (F.col("n") < VERY_FEW))
    steep = {side: F.col(f"{side}_step") >= mean(f"{side}_step") + sigmas * deviation(f"{side}_step") for side, sigmas in (("left", LEFT_SIGMAS), ("right", RIGHT_SIGMAS))}
    mass = {side: F.col(f"{side}_n") >= (F.col("left_n") + F.col("right_n")) / (EDGE_SHARE * (columns + 1)) for side in ("left", "right")}
    c = c.withColumn("good", thin & (steep["left"] | steep["right"]) & mass["left"] & mass["right"])
    for side in ("left", "right"):
        order = page.orderBy(F.desc(thin & steep[side] & mass[side]), F.desc(F.col(f"{side}_step") / (F.col("n") + F.lit(0.1))), "cell")
        c = c.withColumn(f"ranked_{side}", F.row_number().over(order))
        c = c.withColumn(f"ranked_{side}", F.when(F.col(f"ranked_{side}") <= 4 * columns, F.col(f"ranked_{side}")))
        open_ = F.col("good") & F.col(f"ranked_{side}").isNotNull()
        taken = Window.partitionBy(key, open_).orderBy(f"ranked_{side}")
        before = lambda name: F.lag(name).over(taken)
        apart = F.abs(F.col("x") - before("x")) < F.col("wide") / (NEAR_SHARE * (columns + 1))
        c = c.withColumn("_clash", F.coalesce(apart | (F.col("n") - before("n") > F.col("sd_n")), F.lit(False)))
        c = c.withColumn("_ended", F.max("_clash").over(taken)).withColumn(side, F.when(open_ & ~F.col("_ended"), F.col(f"ranked_{side}")))
    return c


def mass_between(cells: list[Cell], columns: int, a: float, b: float) -> float:
    """The glyphs between two places, as a share of what one column should hold."""
    at = lambda x: next((c for c in cells if x <= c.end_x), cells[-1])
    low, high = at(min(a, b)), at(max(a, b))
    return (low.right_n - high.right_n) / ((low.left_n + low.right_n) / (columns + 1))


def choose(cells: list[Cell], lefts: list[Cell], rights: list[Cell], ranked_rights: list[Cell], columns: int) -> list[tuple[float, str]]:
    """(x, evidence) of each separator, from left to right. ``lefts`` and ``rights`` are accepted borders."""
    begin, wide = cells[0].x, cells[-1].end_x - cells[0].x
    share = wide / (columns + 1)
    lefts, rights = sorted(lefts), sorted(rights, reverse=True)

    def overshadowed(side: list[Cell], k: int, name: str) -> bool:
        """A step of less than half of the one before it, with too little between them."""
        if not k:
            return False
        own, before = side[k], side[k - 1]
        small = getattr(own, f"{name}_step") < getattr(before, f"{name}_step") / 2
        return small and getattr(own, f"{name}_n") - getattr(before, f"{name}_n") < (own.left_n + own.right_n) / (NEAR_SHARE * (columns + 1))

    found: dict[float, str] = {}
    used: set[int] = set()
    for i, a in enumerate(lefts):
        for j, b in enumerate(rights):
            if 0 < b.middle - a.middle < share / NEAR_SHARE and not overshadowed(lefts, i, "left") and not overshadowed(rights, j, "right"):
                used |= {a.cell, b.cell}
                found[a.middle if not a.n else b.middle if not b.n else (a.middle + b.middle) / 2] = "pair"
    if len(found) < columns:
        for c in sorted({*lefts} & {*rights}):
            if c.cell not in used:
                found[c.middle] = "both"
                used.add(c.cell)
    for c in [*lefts, *rights]:
        if not c.n and c.cell not in used:
            found[c.middle] = "empty"
            used.add(c.cell)
    off = lambda x: min(abs(x - begin - share * k) for k in range(1, columns + 1))
    ranked, kept = sorted(found, key=lambda x: (off(x), x)), []
    for k, x in enumerate(ranked):
        if len(kept) == columns:
            break
        inner = 0 < k < len(ranked) - 1 and abs(x - ranked[k - 1]) < share / NEAR_SHARE
        # one of two separators with hardly anything between them, and a column to the next
        if not (inner and mass_between(cells, columns, x, ranked[k - 1]) < THIN_BETWEEN and mass_between(cells, columns, x, ranked[k + 1]) > THICK):
            kept.append((x, found[x]))
    steep = lambda c, most: (c.n < VERY_FEW and c.right_step > STEEP) or (c.right_step > most and c.right_step > 2 * c.n)
    inside = lambda c: c.left_n > (c.left_n + c.right_n) / (4 * (columns + 1))
    #: (wanted, cells, which of them, the place, name), in turn
    weaker = [
        (columns, rights, lambda c: not c.n, "x", "right"),
        (columns, lefts, lambda c: not c.n, "end_x", "left"),
        (columns, rights, lambda c: c.n < VERY_FEW, "x", "thin right"),
        (columns, lefts, lambda c: c.n < VERY_FEW, "end_x", "thin left"),
        (1, rights, lambda c: steep(c, -1), "x", "steep"),
        (1, ranked_rights, lambda c: steep(c, VERY_STEEP) and inside(c), "x", "any"),
    ]
    for wanted, side, good, place, name in weaker:
        if len(kept) < wanted:
            more = [c for c in side if c.cell not in used and good(c)][:columns]
            used |= {c.cell for c in more}
            kept += [(getattr(c, place), name) for c in more]
    return sorted(kept)


_FIELDS = ["cell", "x", "end_x", "n", "left_n", "right_n", "left_step", "right_step"]
_OUT = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("evidence", T.StringType()), T.StructField("mass", T.DoubleType())]))


def separators(rows: DataFrame, key: str, start: str, end: str, size: int, columns: int) -> DataFrame:
    """key, place (from 1), x, evidence and mass of each page's separators; mass is what lies between a separator and the next
    (null for the last), as a share of one column's. ``columns`` is the number of separators that are expected."""
    ship_code(rows.sparkSession)
    ranked = candidates(with_all_cells(rows, key, start, end, size), key, columns)
    cell = F.struct(*_FIELDS, "left", "right", "ranked_right")
    pages = ranked.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # as many as a page has cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("x", pa.float64()), ("evidence", pa.string()), ("mass", pa.float64())]))
        for batch in batches:
            out = []
            for found in batch.column("cells").to_pylist():
                of = [Cell(*(r[f] for f in _FIELDS)) for r in found]
                by = lambda name: [c for _, c in sorted((r[name], c) for r, c in zip(found, of) if r[name] is not None)]  # noqa: B023, E731
                chosen = choose(of, by("left"), by("right"), by("ranked_right"), columns)
                nexts = [x for x, _ in chosen[1:]] + [None]
                out.append([{"x": x, "evidence": e, "mass": None if b is None else mass_between(of, columns, x, b)} for (x, e), b in zip(chosen, nexts)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, kind)], [key, "found"])

    found = pages.mapInArrow(run, T.StructType([pages.schema[key], T.StructField("found", _OUT)]))
    return found.select(key, F.posexplode("found").alias("at", "s")).select(key, (F.col("at") + 1).cast("bigint").alias("place"), "s.x", "s.evidence", F.round("s.mass", 9).alias("mass"))
