"""Layout and legal-structure queries on stand-in intervals, lines and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import layout
from tessella.operators.ranking import with_running
from tessella.sources.tables import line_scan, table


def _intervals(spark: SparkSession, base: str) -> DataFrame:
    start = F.col("o_orderkey") * 37 % 600
    return table(spark, base, "orders").select((F.col("o_custkey") % 5).alias("page"), start.alias("x"), (start + F.col("o_custkey") % 60).alias("end_x"))


def _cells(spark: SparkSession, base: str) -> DataFrame:
    return layout.with_slopes(layout.interval_histogram(_intervals(spark, base), "page", "x", "end_x", 10), "page")


def interval_histogram(spark: SparkSession, base: str) -> DataFrame:
    return _cells(spark, base).select("page", "cell", "n", "left_n", "right_n", "left_step", "right_step")


def border_rank(spark: SparkSession, base: str) -> DataFrame:
    return layout.rank_borders(_cells(spark, base), "page", 2).select("page", "place", "cell", "good", "rank_value")


def extents(spark: SparkSession, base: str) -> DataFrame:
    """Extent and average height of each page; heights of 0 do not count for the smallest."""
    h = F.col("x") % 7
    rows = _intervals(spark, base).withColumn("h", h)
    return rows.groupBy("page").agg(F.min("x").alias("min_x"), F.max("end_x").alias("max_x"), F.round(F.avg("h"), 9).alias("mean_h"), F.min(F.when(F.col("h") > 0, F.col("h"))).alias("min_h"))


def run_break(spark: SparkSession, base: str) -> DataFrame:
    """Runs of a user's events: broken by another type, or by a gap of over six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, base, "events").select("event_id", "user_id", "ts", "event_type")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = events.withColumn("gap", gap).withColumn("before", F.lag("event_type").over(w))
    found = layout.runs(rows, "user_id", ["ts", "event_id"], (F.col("before") != F.col("event_type")) | (F.col("gap") > 6 * 3600 * 1000000))
    return found.groupBy("user_id", "run").agg(F.count("*").cast("bigint").alias("n"), F.min("event_id").alias("first"))


_TITLED = """CASE (doc_id + line_no) % 9
  WHEN 0 THEN 'Article ' || (line_no + 1) || ' ' || line WHEN 1 THEN 'Ingingo ya mbere' WHEN 2 THEN 'CHAPTER II' WHEN 3 THEN ' 12 '
  WHEN 4 THEN 'Article premier' ELSE line END"""


def _lines(spark: SparkSession, base: str) -> DataFrame:
    lines = line_scan(table(spark, base, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.expr(_TITLED).alias("line"))


def label_lines(spark: SparkSession, base: str) -> DataFrame:
    line = F.col("line")
    return _lines(spark, base).select("doc_id", "line_no", layout.label_line(line).alias("label"), layout.article_number(line).cast("bigint").alias("number"), layout.title_language(line).alias("lang"))


def article_islands(spark: SparkSession, base: str) -> DataFrame:
    """Text lines gathered under the article title before them; page numbers are skipped."""
    lines = _lines(spark, base).withColumn("label", layout.label_line(F.col("line"))).where("label <> 'page'")
    found = layout.runs(lines, "doc_id", "line_no", F.col("label") == "article", "island")
    return found.groupBy("doc_id", "island").agg(
        F.count("*").cast("bigint").alias("n_lines"),
        F.max(F.when(F.col("label") == "article", layout.article_number(F.col("line")))).cast("bigint").alias("number"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").cast("binary")).alias("digest"),
    )


def lexicon_islands(spark: SparkSession, base: str) -> DataFrame:
    """Dictionary entries: a line with few words opens one, the lines after it are its meanings; the last is kept too."""
    lines = line_scan(table(spark, base, "documents").select("doc_id", "text")).withColumn("n_words", F.size(text.tokens(F.col("line"))))
    found = layout.runs(lines, "doc_id", "line_no", F.col("n_words").between(1, 3), "entry").where("entry > 0")
    return found.groupBy("doc_id", "entry").agg(F.min_by("line", "line_no").alias("head"), (F.count("*") - 1).cast("bigint").alias("n_meanings"))


def align_languages(spark: SparkSession, base: str) -> DataFrame:
    """One row for each rank, with the document of each language that has it."""
    docs = with_running(table(spark, base, "documents").select("doc_id", "lang"), ["doc_id"], ["lang"])
    return docs.groupBy("rank").pivot("lang", ["en", "fr", "de", "es"]).agg(F.max("doc_id")).where("fr IS NOT NULL AND en IS NOT NULL")


def prune_merge(spark: SparkSession, base: str) -> DataFrame:
    langs = "filter(array(IF(doc_id % 7 <> 0, 'rw', ''), 'en', IF(doc_id % 3 <> 0, 'fr', ''), IF(doc_id % 29 = 0, 'fe', '')), x -> x <> '')"
    # every 13th document has its number moved by six, so that numbers are missing between paragraphs
    docs = table(spark, base, "documents").selectExpr("doc_id div 60 AS section", "doc_id div 6 % 10 AS article", "doc_id % 6 + 1 + IF(doc_id % 13 = 5, 6, 0) AS paragraph", f"explode({langs}) AS lang", "'t' || doc_id AS text")
    return layout.prune_and_merge(docs)


QUERIES = {f.__name__: f for f in (interval_histogram, border_rank, extents, run_break, label_lines, article_islands, lexicon_islands, align_languages, prune_merge)}

_CELLS = """
WITH i AS (SELECT o_custkey % 5 AS page, o_orderkey * 37 % 600 AS x, o_orderkey * 37 % 600 + o_custkey % 60 AS end_x FROM orders),
h AS (SELECT page, c AS cell, count(*) AS n FROM i JOIN (SELECT unnest(range(0, 70)) AS c) ON x <= c * 10 + 5 AND c * 10 + 5 <= end_x GROUP BY ALL),
s AS (SELECT page, cell, n, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_n,
  CAST(coalesce(sum(n) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS right_n,
  coalesce(abs(n - lag(n) OVER w), 0) AS left_step, coalesce(abs(n - lead(n) OVER w), 0) AS right_step FROM h WINDOW w AS (PARTITION BY page ORDER BY cell))
"""
_LINES = f"""
WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
last AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM every GROUP BY doc_id),
raw AS (SELECT doc_id, line_no, line FROM every JOIN last USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1)),
lines AS (SELECT doc_id, line_no, {_TITLED} AS line FROM raw),
labelled AS (SELECT *, CASE WHEN regexp_matches(lower(line), '{layout.ARTICLE_NUMBER}') THEN 'article' WHEN regexp_matches(line, '{layout.CHAPTER}') THEN 'chapter'
  WHEN regexp_matches(trim(line), '{layout.PAGE_NUMBER}') THEN 'page' ELSE 'text' END AS label,
  CASE WHEN regexp_extract(lower(line), '{layout.ARTICLE_NUMBER}', 1) IN ('mbere', 'one', 'premier') THEN 1
  ELSE coalesce(try_cast(regexp_extract(lower(line), '{layout.ARTICLE_NUMBER}', 1) AS BIGINT), 0) END AS number FROM lines)
"""
_N = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))"
ORACLE = {
    "interval_histogram": _CELLS + "SELECT * FROM s",
    "border_rank": _CELLS
    + """, t AS (SELECT page, cell, left_step > avg(left_step) OVER p + stddev_pop(left_step) OVER p AS good, round(left_step / (n + 0.1), 9) AS rank_value FROM s WINDOW p AS (PARTITION BY page))
SELECT * FROM (SELECT page, row_number() OVER (PARTITION BY page ORDER BY good DESC, rank_value DESC, cell) AS place, cell, good, rank_value FROM t) WHERE place <= 8""",
    "extents": """
WITH i AS (SELECT o_custkey % 5 AS page, o_orderkey * 37 % 600 AS x, o_orderkey * 37 % 600 + o_custkey % 60 AS end_x FROM orders)
SELECT page, min(x) AS min_x, max(end_x) AS max_x, round(avg(x % 7), 9) AS mean_h, min(x % 7) FILTER (x % 7 > 0) AS min_h FROM i GROUP BY page
""",
    "run_break": """
WITH b AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL
""",
    "label_lines": _LINES
    + """SELECT doc_id, line_no, label, number, CASE WHEN starts_with(lower(line), 'ingingo') THEN 'rw' WHEN regexp_matches(lower(line), '^article\\s+one\\b') THEN 'en'
  WHEN regexp_matches(lower(line), '^article\\s+premier\\b') THEN 'fr' WHEN starts_with(lower(line), 'article') THEN 'fe' END AS lang FROM labelled""",
    "article_islands": _LINES
    + """, i AS (SELECT *, CAST(sum(CASE WHEN label = 'article' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS island FROM labelled WHERE label <> 'page')
SELECT doc_id, island, count(*) AS n_lines, max(number) FILTER (label = 'article') AS number, md5(string_agg(line, ' ' ORDER BY line_no)) AS digest FROM i GROUP BY ALL""",
    "lexicon_islands": _LINES
    + f""", i AS (SELECT *, CAST(sum(CASE WHEN {_N} BETWEEN 1 AND 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS entry FROM raw)
SELECT doc_id, entry, arg_min(line, line_no) AS head, count(*) - 1 AS n_meanings FROM i WHERE entry > 0 GROUP BY ALL""",
    "align_languages": """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents)
SELECT rank, max(doc_id) FILTER (lang = 'en') AS en, max(doc_id) FILTER (lang = 'fr') AS fr, max(doc_id) FILTER (lang = 'de') AS de, max(doc_id) FILTER (lang = 'es') AS es
FROM r GROUP BY rank HAVING count(*) FILTER (lang = 'fr') > 0 AND count(*) FILTER (lang = 'en') > 0
""",
    "prune_merge": """
WITH d AS (SELECT doc_id // 60 AS section, doc_id // 6 % 10 AS article, doc_id % 6 + 1 + CASE WHEN doc_id % 13 = 5 THEN 6 ELSE 0 END AS paragraph, 't' || doc_id AS text,
  list_filter([CASE WHEN doc_id % 7 <> 0 THEN 'rw' END, 'en', CASE WHEN doc_id % 3 <> 0 THEN 'fr' END, CASE WHEN doc_id % 29 = 0 THEN 'fe' END], lambda x: x IS NOT NULL) AS langs FROM documents),
j AS (SELECT d.*, len(d.langs) AS n, len(h.langs) AS hn, list_contains(d.langs, 'fe') AS fe,
  coalesce(len(h.langs) >= 2 AND list_contains(h.langs, 'rw') AND NOT list_contains(h.langs, 'fe'), false) AS ok
  FROM d LEFT JOIN d h ON h.section = d.section AND h.article = d.article AND h.paragraph = 1),
u AS (SELECT *, CASE WHEN paragraph = 1 OR n >= hn THEN paragraph ELSE (
    SELECT max(a.paragraph) FROM j a WHERE a.section = j.section AND a.article = j.article AND a.paragraph < j.paragraph AND a.n = j.hn
      AND (SELECT count(*) FROM j b WHERE b.section = j.section AND b.article = j.article AND b.paragraph >= a.paragraph AND b.paragraph < j.paragraph) = j.paragraph - a.paragraph) END AS home
  FROM j WHERE ok AND NOT fe),
l AS (SELECT section, article, home, paragraph, text, unnest(langs) AS lang FROM u WHERE home IS NOT NULL)
SELECT l.section, l.article, l.home AS paragraph, l.lang, string_agg(l.text, ' ' ORDER BY l.paragraph) AS text FROM l
JOIN l s ON s.section = l.section AND s.article = l.article AND s.home = l.home AND s.paragraph = l.home AND s.lang = l.lang GROUP BY ALL
""",
}
