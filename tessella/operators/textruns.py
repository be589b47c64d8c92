"""Lines, runs and lexicon parts of a page's pieces of text: a total order first, then runs of one look.

Pieces are ordered by lines, then from left to right. A line is all that stands little lower than its first piece, so the
order is total whatever the heights are. Entries are windows over that order; runs are found by one pass of Arrow batches over
it, in which only the open run is kept; a page's lines are a fold over its different heights that keeps one number for each line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as words
from tessella.runtime import ship_code

#: Share of both heights by which a piece may stand lower than its line's first.
LINE_SHARE = 0.25
#: Pieces that never break a run, whatever they look like.
SMALL = ("º", "°", "ᵒ", ":", ",", ".", ";", "!", "-", "*", "&")
#: A gap in units of the font size, from which a run ends.
GAP = 2.0
#: Size, tolerance, fonts and colour of a dictionary's entries and the mark of another meaning.
SIZE, TOLERANCE, HEAD_FONT, MEANING_FONT, HEAD_COLOUR, ALTERNATIVE = 12.96, 0.01, "VOWLNL", "YARFYB", 0, "•"


def with_lines(pieces: DataFrame, key: list[str]) -> DataFrame:
    """``pieces`` (key, y, h) with ``line``, from 0 in each page: a line begins at the first y that is lower than the line's first by
    more than a quarter of both heights. The tallest piece of a y stands for it. Null y or h counts as 0.

    Only the heights and the lines' first ones are gathered by page; pieces are dealt by page once, as ``text_runs`` needs them too.
    """
    y, h = F.coalesce(F.col("y").cast("double"), F.lit(0.0)), F.coalesce(F.col("h").cast("double"), F.lit(0.0))
    levels = pieces.groupBy(*key, y.alias("_y")).agg(F.max(h).alias("_h"))
    pages = levels.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_y", "_h"))).alias("levels"))
    none = F.lit(None).cast("struct<at:struct<_y:double,_h:double>,starts:array<double>>")

    def step(s: Column, v: Column) -> Column:
        begins = s.isNull() | (v["_y"] > s["at"]["_y"] + LINE_SHARE * (s["at"]["_h"] + v["_h"]))
        opened = F.struct(v.alias("at"), F.concat(F.coalesce(s["starts"], F.array().cast("array<double>")), F.array(v["_y"])).alias("starts"))
        return F.when(begins, opened).otherwise(s)

    starts = pages.select(*key, F.explode(F.aggregate("levels", none, step, lambda s: s["starts"])).alias("_y"), F.lit(1).alias("_start"))
    every = pieces.withColumn("_y", y).withColumn("_start", F.lit(0)).unionByName(starts, allowMissingColumns=True)
    upto = Window.partitionBy(*key).orderBy("_y", F.desc("_start")).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("line", F.sum("_start").over(upto) - 1).where("_start = 0").drop("_y", "_start")


def text_runs(pieces: DataFrame, key: list[str], order: list[str], care_about_font: bool = True, least_y: float = 0.0) -> DataFrame:
    """key, run, text, font_size, font, colour, x, y, h and n of each run of pieces that look alike.

    ``pieces`` has text, x, y, h, font_size, font and colour. A piece that differs in size, colour or font from the last solid
    piece before it, or stands lower by over two font sizes, begins a run. Blank pieces and small additions never do and are no
    solid pieces; without ``care_about_font``, nor do pieces of the same y. A run looks like its last solid piece; y and h are its
    smallest. Runs without a solid piece and those that reach up to ``least_y`` go. Null text is blank.
    """
    return _found(pieces, key, [F.col(c) for c in order], care_about_font, least_y, lambda batches: batches)


def runs_in_lines(pieces: DataFrame, key: list[str], care_about_font: bool = True, least_y: float = 0.0) -> DataFrame:
    """``text_runs`` of pieces in the lines of ``with_lines``, from left to right in each; pieces are ordered once, by height, and pass once.

    A line's pieces are held until the next line begins.
    """
    y, h = F.coalesce(F.col("y").cast("double"), F.lit(0.0)), F.coalesce(F.col("h").cast("double"), F.lit(0.0))
    return _found(pieces, key, [y, h.desc()], care_about_font, least_y, lambda batches: in_lines(batches, key))


def _found(pieces: DataFrame, key: list[str], order: list[Column], care_about_font: bool, least_y: float, sorted_: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The runs of pieces that are ordered by ``order`` in each page and then by ``sorted_`` as they pass."""
    ship_code(pieces.sparkSession)
    said = F.coalesce(F.col("text"), F.lit(""))
    solid = ~F.rlike(said, F.lit(rf"\A\s*[{''.join(SMALL).replace('-', chr(92) + '-').replace('&', chr(92) + '&')}]?\s*\z"))
    # the window deals the pieces by page and orders them; with the place it has nothing else to do
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows = pieces.select(*key, said.alias("text"), "font_size", "font", "colour", "x", "y", "h", solid.alias("solid"), place.alias("place"))
    of = {f.name: f.dataType for f in rows.schema}
    made = [*((k, of[k]) for k in key), ("run", T.LongType()), *((c, of[c]) for c in ("text", "font_size", "font", "colour", "x", "y", "h")), ("n", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return runs_of_batches(sorted_(batches), key, care_about_font, least_y)

    found = rows.mapInArrow(run, T.StructType([T.StructField(name, kind) for name, kind in made]))
    return found.withColumn("text", words.squeeze(F.col("text")))


def in_lines(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces that come by page, y and falling h, in the order of their lines and, in each, of x; nulls of x come first."""
    before, line_y, line_h, open_ = None, 0.0, 0.0, []

    def ordered(rows: list[pa.RecordBatch], line: np.ndarray) -> pa.RecordBatch:
        whole = pa.concat_batches(rows)
        x = pc.cast(whole.column("x"), pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        return whole.take(pa.array(np.lexsort((x, line))))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if before is None else pa.concat_batches([before, batch])
        number = lambda c: pc.cast(rows.column(c), pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        y, h = number("y"), number("h")
        page = np.logical_or.reduce([np.diff(_codes(rows.column(k)), prepend=-1) != 0 for k in key])
        level = page | (np.diff(y, prepend=np.inf) != 0)
        skip = int(before is not None)  # the row before the batch is there to compare with
        at = np.flatnonzero(level[skip:]) + skip
        starts = []
        for i, new, y_i, h_i in zip(at.tolist(), page[at].tolist(), y[at].tolist(), h[at].tolist()):
            if new or y_i > line_y + LINE_SHARE * (line_h + h_i):
                line_y, line_h = y_i, h_i
                starts.append(i - skip)
        before = batch.slice(batch.num_rows - 1)
        if not starts:
            open_.append(batch)
            continue
        closed = np.zeros(starts[-1], np.int64)
        closed[starts[:-1]] = 1
        held = sum(b.num_rows for b in open_)
        if held + starts[-1]:
            yield ordered([*open_, batch.slice(0, starts[-1])], np.concatenate([np.zeros(held, np.int64), np.cumsum(closed)]))
        open_ = [batch.slice(starts[-1])]
    if open_:
        yield ordered(open_, np.zeros(sum(b.num_rows for b in open_), np.int64))


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are; null equals null."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def runs_of_batches(batches: Iterator[pa.RecordBatch], key: list[str], care_about_font: bool, least_y: float) -> Iterator[pa.RecordBatch]:
    """The runs of pages' pieces in order, whole pages one after the other; of a batch's last run one row goes on to the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.drop_columns(["place"]).append_column("min_y", batch.column("y")).append_column("min_h", batch.column("h"))
        batch = batch.append_column("n", pa.array(np.ones(batch.num_rows, np.int64))).append_column("run", pa.array(np.zeros(batch.num_rows, np.int64)))
        found = _runs_of(batch if held is None else pa.concat_batches([held, batch]), key, care_about_font)
        held = found.slice(found.num_rows - 1)
        if found.num_rows > 1:
            yield _shown(found.slice(0, found.num_rows - 1), key, least_y)
    if held is not None:
        yield _shown(held, key, least_y)


def _runs_of(rows: pa.RecordBatch, key: list[str], care_about_font: bool) -> pa.RecordBatch:
    """One row for each run, as its last solid piece looks, with its whole text, smallest y and h and number of pieces. The first row may
    stand for the beginning of a run, then with that run's number."""
    count = rows.num_rows
    at = np.arange(count)
    differs = lambda c: np.diff(_codes(rows.column(c)), prepend=-1) != 0
    page = np.logical_or.reduce([differs(k) for k in key])
    page[0] = True
    solid = rows.column("solid").to_numpy(zero_copy_only=False)
    last = np.maximum.accumulate(np.where(solid, at, -1))
    before = np.concatenate([[-1], last[:-1]])
    first = np.maximum.accumulate(np.where(page, at, 0))
    known = before >= first
    at_p = np.where(known, before, 0)
    codes = [_codes(rows.column(c)) for c in ("font_size", "colour", "font")]
    other = np.logical_or.reduce([c != c[at_p] for c in codes])
    number = lambda c: pc.cast(rows.column(c), pa.float64()).to_numpy(zero_copy_only=False)
    y, size = number("y"), number("font_size")[at_p]
    with np.errstate(divide="ignore", invalid="ignore"):
        far = (size != 0) & ((y - y[at_p]) / size > GAP)
    breaks = known & solid & (other | far)
    if not care_about_font:
        c = _codes(rows.column("y"))
        breaks &= c != c[at_p]
    begins = np.flatnonzero(page | breaks)
    ends = np.append(begins[1:], count)
    broken = np.cumsum(breaks)
    run = broken - broken[first] + np.where(first == 0, rows.column("run")[0].as_py(), 0)
    looks = last[ends - 1]
    has = looks >= begins
    looks = np.where(has, looks, begins)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins, count), pa.int32()), rows.column("text")), "")
    least = lambda c: (lambda x: pa.array(x, mask=np.isnan(x)).cast(rows.column(c).type))(np.fmin.reduceat(number(c), begins))
    out = {c: rows.column(c).take(pa.array(looks)) for c in rows.schema.names}
    out |= {"text": text, "solid": pa.array(has), "min_y": least("min_y"), "min_h": least("min_h"), "run": pa.array(run[begins])}
    out["n"] = pa.array(np.add.reduceat(rows.column("n").to_numpy(), begins))
    return pa.RecordBatch.from_arrays([out[c] for c in rows.schema.names], schema=rows.schema)


def _shown(runs: pa.RecordBatch, key: list[str], least_y: float) -> pa.RecordBatch:
    """Runs with a solid piece that stand lower than ``least_y``."""
    kept = runs.filter(pc.and_(runs.column("solid"), pc.fill_null(pc.greater(pc.cast(runs.column("min_y"), pa.float64()), least_y), False)))
    names = {"y": "min_y", "h": "min_h"}
    shown = [*key, "run", "text", "font_size", "font", "colour", "x", "y", "h", "n"]
    return pa.RecordBatch.from_arrays([kept.column(names.get(c, c)) for c in shown], shown)


def lexicon_part(meaning_colour: int) -> Column:
    """What a run is in a dictionary: entry, alternative (a mark that another meaning follows), meaning, or null for anything else."""
    sized = F.abs(F.col("font_size") - SIZE) < TOLERANCE
    head = sized & F.startswith("font", F.lit(HEAD_FONT)) & (F.col("colour") == HEAD_COLOUR)
    meaning = sized & F.startswith("font", F.lit(MEANING_FONT)) & (F.col("colour") == meaning_colour)
    return F.when(head, F.when(F.endswith("text", F.lit(ALTERNATIVE)), "alternative").otherwise("entry")).when(meaning, "meaning")


def lexicon_of_runs(runs: DataFrame, key: list[str], meaning_colour: int) -> DataFrame:
    """key, entry_no, entry and meanings (in order) of a dictionary's runs in its fonts.

    An entry that another entry follows at once is replaced by it, and so goes one that nothing follows; else the last entry is
    kept too. Meanings go on over runs until an alternative; what comes before the first entry belongs to none.
    """
    parts = runs.withColumn("part", lexicon_part(meaning_colour)).where("part IS NOT NULL")
    upto = Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.sum(F.when(F.col("part") == kind, 1).otherwise(0)).over(upto).cast("bigint")
    rows = parts.withColumn("entry_no", count("entry")).withColumn("_seg", count("alternative")).where("entry_no > 0")
    segments = rows.groupBy(*key, "entry_no", "_seg").agg(
        F.max(F.when(F.col("part") == "entry", F.trim("text"))).alias("entry"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("part") == "meaning", F.struct("run", "text")))).alias("m"),
    )
    said = F.when(F.size("m") > 0, F.struct("_seg", F.array_join(F.transform("m", lambda r: F.trim(r["text"])), " ").alias("t")))
    entries = segments.groupBy(*key, "entry_no").agg(F.max("entry").alias("entry"), F.sum("n").alias("n"), F.array_sort(F.collect_list(said)).alias("s"))
    return entries.where("n > 1").select(*key, "entry_no", "entry", F.transform("s", lambda x: x["t"]).alias("meanings"))
