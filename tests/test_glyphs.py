"""Folds over glyphs and lines by hand-worked cases."""

from pyspark.sql import functions as F

from tessella.functions import glyphs


def one(spark, sql, fn):
    return spark.sql(f"SELECT {sql} AS g").select(fn("g").alias("out")).first()["out"]


def pack(names, rows):
    fields = lambda r: ", ".join(f"'{n}', CAST({'NULL' if v is None else v} AS BIGINT)" for n, v in zip(names, r))
    return "array(" + ", ".join(f"named_struct({fields(r)})" for r in rows) + ")"


def test_a_glyph_on_a_kept_one_goes_and_a_hidden_one_hides_none(spark):
    rows = [(1, 0, 0, 9), (2, 2, 0, 9), (3, 4, 0, 9), (4, 3, 0, 9), (5, 0, 3, 9), (6, 0, -3, 9)]
    # 2 hides under 1; 3 is 4 away from 1, as 2 is not kept; 4 lies on 3; 3 up is still on the near edge, 3 down is out
    assert one(spark, pack(("id", "x", "y", "w"), rows), lambda c: glyphs.kept_glyphs(F.col(c))) == [1, 3, 6]


def test_lines_follow_the_lowest_foot_so_far(spark):
    rows = [(1, 10, 8), (2, 12, 8), (3, 4, 3), (4, 20, 8), (5, 21, 9), (6, 40, 2), (7, 20, 8)]
    # 12 and 4 just meet (8 high), 20 stands on 12's foot, 40 is clear of all, and so is going back to 20
    assert one(spark, pack(("id", "y", "h"), rows), lambda c: glyphs.line_numbers(F.col(c))) == [0, 0, 0, 0, 0, 1, 2]


def test_paragraphs_open_by_distance_indent_and_marks(spark):
    names = ("x", "y", "h", "space", "w", "shape")
    rest = (10, 4, 8)
    rows = [(40, 0, *rest, None), (40, 12, *rest, None), (50, 24, *rest, None), (40, 36, *rest, None), (40, 80, *rest, 1), (40, 92, *rest, 1), (52, 104, *rest, None), (52, 116, *rest, 1)]
    # opens; goes on; indented; further out after an opening line; far away; same mark; hangs; hangs on
    assert one(spark, pack(names, rows), lambda c: glyphs.paragraph_starts(F.col(c))) == [True, False, True, False, True, True, False, False]


def test_empty_pages_have_nothing(spark):
    empty = "CAST(array() AS ARRAY<STRUCT<{}>>)"
    kinds = lambda names: empty.format(", ".join(f"{n}: BIGINT" for n in names))
    assert one(spark, kinds(("id", "x", "y", "w")), lambda c: glyphs.kept_glyphs(F.col(c))) == []
    assert one(spark, kinds(("id", "y", "h")), lambda c: glyphs.line_numbers(F.col(c))) == []
