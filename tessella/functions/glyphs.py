"""Folds over the glyphs or lines of one page, in the order in which the page draws them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kept_glyphs(glyphs: Column) -> Column:
    """Ids of the glyphs (id, x, y, w; all of one character) that do not lie on one kept before: nearer than a third of their
    width on both axes, the far edge out."""
    state = F.struct(F.array().cast("array<struct<x:bigint,y:bigint>>").alias("at"), F.array().cast("array<bigint>").alias("ids"))

    def step(s: Column, g: Column) -> Column:
        near = lambda a, b: (a * 3 >= b * 3 - g["w"]) & (a * 3 < b * 3 + g["w"])
        hidden = F.exists(s["at"], lambda p: near(p["x"], g["x"]) & near(p["y"], g["y"]))
        shown = F.struct(F.concat(s["at"], F.array(F.struct(g["x"].alias("x"), g["y"].alias("y")))).alias("at"), F.concat(s["ids"], F.array(g["id"])).alias("ids"))
        return F.when(hidden, s).otherwise(shown)

    return F.aggregate(glyphs, state, step, lambda s: s["ids"])


def line_numbers(glyphs: Column) -> Column:
    """The line (from 0) of each glyph (y: its foot, h: its height): a new one begins where a glyph stands clear of the
    lowest foot and the greatest height of the line so far."""
    state = F.struct(F.lit(-1).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("h"), F.array().cast("array<bigint>").alias("lines"))

    def step(s: Column, g: Column) -> Column:
        meets = (s["line"] >= 0) & g["y"].between(s["y"] - s["h"], s["y"]) | (s["line"] >= 0) & s["y"].between(g["y"] - g["h"], g["y"])
        line = F.when(meets, s["line"]).otherwise(s["line"] + 1)
        y = F.when(meets, F.greatest(s["y"], g["y"])).otherwise(g["y"])
        h = F.when(meets, F.greatest(s["h"], g["h"])).otherwise(g["h"])
        return F.struct(line.alias("line"), y.alias("y"), h.alias("h"), F.concat(s["lines"], F.array(line)).alias("lines"))

    return F.aggregate(glyphs, state, step, lambda s: s["lines"])


def paragraph_starts(lines: Column) -> Column:
    """Whether each line (x, y, h, space, w, shape of its list mark or null) opens a paragraph.

    The first one does, and so does one that is more than 2.5 heights away from the line before. One further in than two
    spaces opens one if the line before did not; else it hangs. One further out than a space opens one if the line before did
    not. One at the same edge (a quarter of a glyph's width) hangs if the line before hangs; after an opening line with a list
    mark it opens one if its own mark has the same shape.
    """
    state = F.lit(None).cast("struct<x:bigint,y:bigint,starts:boolean,hangs:boolean,shape:bigint,out:array<boolean>>")

    def step(s: Column, g: Column) -> Column:
        dx = g["x"] - s["x"]
        far, inner, outer, level = F.abs(g["y"] - s["y"]) > 2.5 * g["h"], dx > 2 * g["space"], dx < -g["space"], F.abs(dx) < 0.25 * g["w"]
        listed = s["starts"] & F.coalesce(s["shape"] == g["shape"], F.lit(False))
        starts = F.when(s.isNull() | far, True).when(inner | outer, ~s["starts"]).when(level & ~s["hangs"], listed).otherwise(False)
        hangs = F.when(s.isNull() | far, False).when(inner, s["starts"]).when(~outer & level, s["hangs"]).otherwise(False)
        out = F.concat(F.coalesce(s["out"], F.array().cast("array<boolean>")), F.array(starts))
        return F.struct(g["x"].alias("x"), g["y"].alias("y"), starts.alias("starts"), hangs.alias("hangs"), g["shape"].alias("shape"), out.alias("out"))

    return F.aggregate(lines, state, step, lambda s: s["out"])
