"""Queries over pieces of text on pages: lines in a total order, runs of one look, a dictionary by its fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import textruns
from tessella.runtime import bytes_of
from tessella.sources.tables import line_scan, table

PART_BYTES = 4_000_000  # of texts as they are stored, in one part
MEANING_COLOUR = 255
_PIECE = "CASE (line_no * 5 + pos) % 11 WHEN 0 THEN ':' WHEN 3 THEN '  ' WHEN 7 THEN '° ' ELSE concat(w, CASE WHEN (line_no + pos) % 13 = 5 THEN '•' ELSE ' ' END) END"
_TURN = "(line_no * 2 + pos div 6 + doc_id) % 5"
_TURN_SQL = "(line_no * 2 + pos // 6 + doc_id) % 5"


def line_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Glyphs in a total reading order: in lines that begin with their highest glyph, from left to right in each."""
    glyphs = table(spark, base, "orders").selectExpr("o_orderkey AS id", "o_custkey % 9 AS page", "o_orderkey * 37 % 600 AS x", "o_orderkey * 53 % 800 AS y", "o_custkey % 5 + 8 AS h")
    w = Window.partitionBy("page").orderBy("line", "x", "y", "id")
    return textruns.with_lines(glyphs, ["page"]).select("page", "id", "line", F.row_number().over(w).cast("bigint").alias("place"))


def _runs(spark: SparkSession, base: str, care_about_font: bool = True) -> DataFrame:
    """Runs of all words of all documents. A word's place gives its look: documents stand for pages, every seventh line for a gap."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-bytes_of(docs) // PART_BYTES))
    lines = line_scan(docs.repartition(parts, "doc_id"))  # texts are dealt whole, so that their words arise where they are needed
    each = lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.posexplode(text.tokens(F.col("line"))).alias("pos", "w"))
    pieces = each.selectExpr(
        "doc_id", f"{_PIECE} AS text", "CAST(pos * 10 AS BIGINT) AS x", "line_no * 12 + line_no div 7 * 30 + pos % 3 AS y", "8 + pos % 2 AS h",
        f"element_at(array(12.96D, 12.955D, 12.96D, 12.9D, 12.96D), CAST({_TURN} + 1 AS INT)) AS font_size",
        f"element_at(array('VOWLNL+Head', 'YARFYB+Body', 'YARFYB+Body', 'VOWLNL+Head', 'Other'), CAST({_TURN} + 1 AS INT)) AS font",
        f"CASE WHEN {_TURN} IN (1, 2) THEN 255 ELSE 0 END AS colour",
    )
    return textruns.runs_in_lines(pieces, ["doc_id"], care_about_font, 0.5)


def text_runs(spark: SparkSession, base: str) -> DataFrame:
    """Runs of pieces that look alike: blanks and small additions never break one."""
    return _runs(spark, base).select("doc_id", "run", F.md5(F.col("text").cast("binary")).alias("digest"), "font_size", "font", F.col("colour").cast("bigint").alias("colour"), "x", "y", F.col("h").cast("bigint").alias("h"), "n")


def text_runs_by_place(spark: SparkSession, base: str) -> DataFrame:
    """The same where another look breaks a run only at another height."""
    return _runs(spark, base, False).groupBy("doc_id").agg(F.count("*").cast("bigint").alias("n_runs"), F.sum("n").cast("bigint").alias("n_pieces"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def lexicon_runs(spark: SparkSession, base: str) -> DataFrame:
    """Entries and meanings of a dictionary that its fonts, sizes and colours tell apart."""
    found = textruns.lexicon_of_runs(_runs(spark, base), ["doc_id"], MEANING_COLOUR)
    return found.select("doc_id", "entry_no", "entry", F.size("meanings").cast("bigint").alias("n_meanings"), F.md5(F.array_join("meanings", "|").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (line_clusters, text_runs, text_runs_by_place, lexicon_runs)}

_SMALL = ", ".join(f"'{c}'" for c in textruns.SMALL)


def _sql(care_about_font: bool) -> str:
    """Runs as DuckDB finds them; lines are those that the pieces were made of."""
    place = "" if care_about_font else " AND y <> q.y"
    return f"""
WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
raw AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM parts),
ws AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda v: v <> '') AS ws FROM raw),
i AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM ws),
t AS (SELECT doc_id, line_no, pos, pos * 10 AS x, line_no * 12 + line_no // 7 * 30 + pos % 3 AS y, 8 + pos % 2 AS h, {_PIECE} AS text,
  list_extract([12.96::DOUBLE, 12.955::DOUBLE, 12.96::DOUBLE, 12.9::DOUBLE, 12.96::DOUBLE], {_TURN_SQL} + 1) AS font_size,
  list_extract(['VOWLNL+Head', 'YARFYB+Body', 'YARFYB+Body', 'VOWLNL+Head', 'Other'], {_TURN_SQL} + 1) AS font, CASE WHEN {_TURN_SQL} IN (1, 2) THEN 255 ELSE 0 END AS colour FROM i),
s AS (SELECT *, trim(text) <> '' AND trim(text) NOT IN ({_SMALL}) AS solid FROM t),
p AS (SELECT *, last_value(CASE WHEN solid THEN {{'font_size': font_size, 'font': font, 'colour': colour, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM s),
b AS (SELECT *, sum(CASE WHEN q IS NOT NULL AND solid AND (font_size <> q.font_size OR font <> q.font OR colour <> q.colour OR (y - q.y) / q.font_size > 2){place} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, x) AS run FROM p),
r AS (SELECT doc_id, CAST(run AS BIGINT) AS run, trim(regexp_replace(string_agg(text, '' ORDER BY line_no, x), '\\s+', ' ', 'g')) AS text, arg_max(font_size, line_no * 1000000 + x) FILTER (solid) AS font_size, arg_max(font, line_no * 1000000 + x) FILTER (solid) AS font,
  arg_max(colour, line_no * 1000000 + x) FILTER (solid) AS colour, arg_max(x, line_no * 1000000 + x) FILTER (solid) AS x, min(y) AS y, min(h) AS h, count(*) AS n
  FROM b GROUP BY doc_id, run HAVING count(*) FILTER (solid) > 0 AND min(y) > 0.5)
"""


ORACLE = {
    "line_clusters": """
WITH RECURSIVE g AS (SELECT o_orderkey AS id, o_custkey % 9 AS page, o_orderkey * 37 % 600 AS x, o_orderkey * 53 % 800 AS y, o_custkey % 5 + 8 AS h FROM orders),
v AS (SELECT page, y, max(h) AS h FROM g GROUP BY ALL),
s AS (SELECT page, y, h FROM v QUALIFY y = min(y) OVER (PARTITION BY page)
  UNION ALL SELECT page, y, h FROM (SELECT v.*, row_number() OVER (PARTITION BY v.page ORDER BY v.y) AS k FROM s JOIN v ON v.page = s.page AND v.y > s.y + 0.25 * (s.h + v.h)) WHERE k = 1),
n AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) - 1 AS line FROM s)
SELECT g.page, id, line, row_number() OVER (PARTITION BY g.page ORDER BY line, x, g.y, id) AS place FROM g ASOF JOIN n ON g.page = n.page AND g.y >= n.y
""",
    "text_runs": _sql(True) + "SELECT doc_id, run, md5(text) AS digest, font_size, font, colour, x, y, h, n FROM r",
    "text_runs_by_place": _sql(False) + "SELECT doc_id, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_pieces, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM r GROUP BY doc_id",
    "lexicon_runs": _sql(True)
    + """, k AS (SELECT *, CASE WHEN abs(font_size - 12.96) >= 0.01 THEN NULL WHEN starts_with(font, 'VOWLNL') AND colour = 0 THEN CASE WHEN text LIKE '%•' THEN 'alternative' ELSE 'entry' END
  WHEN starts_with(font, 'YARFYB') AND colour = 255 THEN 'meaning' END AS part FROM r),
e AS (SELECT doc_id, run, text, part, count(*) FILTER (part = 'entry') OVER o AS entry_no, count(*) FILTER (part = 'alternative') OVER o AS seg FROM k WHERE part IS NOT NULL WINDOW o AS (PARTITION BY doc_id ORDER BY run)),
m AS (SELECT doc_id, entry_no, seg, string_agg(text, ' ' ORDER BY run) AS t FROM e WHERE part = 'meaning' AND entry_no > 0 GROUP BY ALL),
a AS (SELECT doc_id, entry_no, max(text) FILTER (part = 'entry') AS entry FROM e WHERE entry_no > 0 GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, entry_no, entry, count(t) AS n_meanings, md5(coalesce(string_agg(t, '|' ORDER BY seg), '')) AS digest FROM a LEFT JOIN m USING (doc_id, entry_no) GROUP BY ALL
""",
}
