"""Gazettes whose columns run on across pages: labels of all lines of a language's pages as one stream for each column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import legal
from tessella.operators.legalstream import label_stream
from tessella.operators.ranking import with_running
from tessella.plans.search import _BOLD, _LEGAL
from tessella.sources.tables import line_scan, table

_COLUMNS = "CASE WHEN doc_id div 16 % 3 = 2 THEN 3 ELSE 2 END"
_HEIGHT = "idx * 12 - CASE (doc_id + line_no) % 7 WHEN 0 THEN 12 WHEN 3 THEN 14 ELSE 0 END"


def legal_stream(spark: SparkSession, base: str) -> DataFrame:
    """Class, article number and language of every line. Documents of a language are the pages of its gazette, in two or
    three columns; a column goes on from the page before if that has as many columns and lines in this one."""
    lines = line_scan(table(spark, base, "documents").select("doc_id", "lang", "text")).withColumn("line_no", F.col("line_no").cast("bigint"))
    lines = lines.withColumn("n_cols", F.expr(_COLUMNS)).withColumn("col", F.col("line_no") % F.col("n_cols")).withColumn("idx", F.expr("line_no div n_cols"))
    pages = lines.groupBy("lang", "doc_id", "n_cols").agg(F.count("*").alias("n_lines"))
    pages = with_running(pages, ["doc_id"], ["lang"], name="page")
    before = pages.select(F.col("lang").alias("l"), (F.col("page") + 1).alias("p"), F.col("n_cols").alias("cols_before"), F.col("n_lines").alias("lines_before"))
    pages = pages.join(before, (F.col("lang") == F.col("l")) & (F.col("page") == F.col("p")), "left").select("doc_id", "cols_before", "lines_before")
    last = F.col("idx") == F.max("idx").over(Window.partitionBy("doc_id", "col"))
    made = lines.join(pages, "doc_id").select("lang", "col", "doc_id", "idx", "n_cols", "cols_before", "lines_before", F.expr(_LEGAL).alias("line"), F.expr(_BOLD).alias("bold"), last.alias("last"), F.expr(_HEIGHT).alias("y"))
    fresh = ~F.coalesce((F.col("cols_before") == F.col("n_cols")) & (F.col("lines_before") > F.col("col")), F.lit(False))
    x = legal.line_facts(F.col("idx"), F.col("line"), F.col("bold"), F.col("last"))
    made = made.select(F.col("lang").alias("gazette"), "col", "doc_id", "idx", x.alias("x"), (F.trim("line") == "").alias("blank"), fresh.alias("fresh"), "y")
    facts = F.struct("x.raw", "x.num", "x.lang", "x.other", "x.colon", "x.bold", "blank", "fresh", "y")
    return label_stream(made.select("gazette", "col", "doc_id", "idx", facts.alias("facts")), ["gazette", "col"], ["doc_id", "idx"])


QUERIES = {"legal_stream": legal_stream}


def _stream_sql() -> str:
    """Line by line down every column, across pages, by recursion."""
    has = lambda c, *patterns: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in patterns) + ")"
    found = "coalesce(" + ", ".join(f"nullif(regexp_extract(low, '{p}', 2), '')" for _, p in legal.ARTICLES) + ")"
    duck = lambda s: s.replace(" div ", " // ")
    return f"""
WITH RECURSIVE parts AS (SELECT doc_id, lang AS gazette, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, gazette, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
ends AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM every GROUP BY doc_id),
c AS (SELECT doc_id, gazette, line_no, line, {duck(_COLUMNS)} AS n_cols FROM every JOIN ends USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1)),
pages AS (SELECT doc_id, lag(n_cols) OVER w AS cols_before, lag(n_lines) OVER w AS lines_before
  FROM (SELECT gazette, doc_id, n_cols, count(*) AS n_lines FROM c GROUP BY ALL) WINDOW w AS (PARTITION BY gazette ORDER BY doc_id)),
d AS (SELECT *, line_no % n_cols AS col, line_no // n_cols AS idx FROM c JOIN pages USING (doc_id)),
t AS (SELECT *, trim({_LEGAL}) AS x, {_BOLD} AS bold, idx = max(idx) OVER (PARTITION BY doc_id, col) AS is_last, {_HEIGHT} AS y,
  NOT coalesce(cols_before = n_cols AND lines_before > col, false) AS fresh FROM d),
w AS (SELECT *, lower(x) AS low, len(regexp_split_to_array(x, '\\s+')) AS tokens FROM t),
n AS (SELECT *, bold AND {has("low", *[p for _, p in legal.ARTICLES])} AS is_raw, {found} AS found FROM w),
f AS (SELECT gazette, col, doc_id, idx, bold, is_raw, starts_with(x, ':') AS colon, x = '' AS blank, fresh, y,
  CASE WHEN is_raw THEN CASE WHEN found IN ('mbere', 'one', 'premier') THEN 1 ELSE coalesce(TRY_CAST(found AS INTEGER), 0) END END AS num,
  CASE WHEN is_raw THEN CASE found WHEN 'mbere' THEN 'rw' WHEN 'one' THEN 'en' WHEN 'premier' THEN 'fr' ELSE CASE WHEN {has("low", legal.ARTICLE_KINYARWANDA)} THEN 'rw' ELSE 'fe' END END END AS lang,
  CASE WHEN idx = 0 AND {has("low", legal.GAZETTE)} AND {has("low", legal.NUMBER_MARK)} AND ({has("low", legal.DATE)} OR ({has("low", legal.MONTH_ENGLISH)} AND {has("low", legal.YEAR)})) THEN 'gazette'
    WHEN bold AND {has("low", legal.SECTION_KINYARWANDA, legal.SECTION_ENGLISH, legal.SECTION_FRENCH)} THEN 'section'
    WHEN bold AND {has("x", legal.CHAPTER_KINYARWANDA, legal.CHAPTER_ENGLISH, legal.CHAPTER_FRENCH)} THEN 'chapter'
    WHEN bold AND tokens < {legal.ORDER_TOKENS} AND {has("x", legal.ORDER_KINYARWANDA, legal.ORDER_ENGLISH, legal.ORDER_FRENCH)} THEN 'order'
    WHEN tokens < {legal.DONE_TOKENS} AND ({has("low", legal.DONE_DATE)} OR ({has("low", legal.DONE_ON)} AND {has("low", legal.MONTH_ANY)} AND {has("low", legal.YEAR)})) THEN 'done'
    WHEN {has("low", legal.SIGNATURE)} THEN 'signature' WHEN is_last AND {has("x", legal.PAGE)} THEN 'page' END AS other FROM n),
s AS (SELECT *, row_number() OVER o AS pos, coalesce(y <= lag(y) OVER o, false) AS up FROM f WHERE coalesce(other, '') NOT IN ('gazette', 'page') WINDOW o AS (PARTITION BY gazette, col ORDER BY doc_id, idx)),
r AS (
  SELECT gazette, col, doc_id, idx, pos, is_raw AS title, false AS para, coalesce(num, 0) AS num, lang, CASE WHEN is_raw THEN 'title' ELSE coalesce(other, CASE WHEN blank THEN 'blank' ELSE 'unknown' END) END AS class FROM s WHERE pos = 1
  UNION ALL
  SELECT gazette, col, doc_id, idx, pos, title0 OR (goes_on AND ptitle AND (colon OR up)), goes_on AND NOT (ptitle AND (colon OR up OR bold)),
    CASE WHEN goes_on THEN pnum ELSE coalesce(num, 0) END, CASE WHEN goes_on OR NOT is_raw OR takes THEN plang ELSE lang END,
    CASE WHEN title0 OR (goes_on AND ptitle AND (colon OR up)) THEN 'title' WHEN goes_on AND NOT (ptitle AND (colon OR up OR bold)) THEN 'paragraph' ELSE coalesce(other, CASE WHEN blank THEN 'blank' ELSE 'unknown' END) END
  FROM (SELECT *, other IS NULL AND NOT title0 AND (ptitle OR ppara) AS goes_on FROM (
    SELECT *, is_raw AND NOT (ptitle AND coalesce(num, 0) <> pnum + 1) AS title0, coalesce(lang = 'fe' AND num <> 1 AND plang IN ('fr', 'en'), false) AS takes FROM (
      SELECT s.*, r.title AND NOT s.fresh AS ptitle, r.para AND NOT s.fresh AS ppara, r.num AS pnum, CASE WHEN NOT s.fresh THEN r.lang END AS plang
      FROM r JOIN s ON s.gazette = r.gazette AND s.col = r.col AND s.pos = r.pos + 1))))
SELECT gazette, col, doc_id, idx, class, num AS number, lang FROM r
UNION ALL SELECT gazette, col, doc_id, idx, other, 0, NULL FROM f WHERE other IN ('gazette', 'page')"""


ORACLE = {"legal_stream": _stream_sql()}
