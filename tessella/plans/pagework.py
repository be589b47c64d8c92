"""Page and decision queries: crops, columns, regions, borders, paragraphs, list items, descents, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scoring
from tessella.operators.absorption import absorb
from tessella.operators.columns import separators
from tessella.operators.regions import locate
from tessella.sources.tables import line_scan, table


def _glyphs(spark: SparkSession, base: str) -> DataFrame:
    """Stand-in glyphs: a page, a column, a place and a height for every order."""
    return table(spark, base, "orders").selectExpr("o_orderkey AS id", "o_custkey % 9 AS page", "o_orderkey * 37 % 600 AS x", "o_orderkey * 53 % 800 AS y", "o_custkey % 5 + 8 AS h", "IF(o_custkey % 9 < 3, 0, o_orderkey % (o_custkey % 9)) AS col")


def column_pages(spark: SparkSession, base: str) -> DataFrame:
    """Glyphs between the crop's edges (both out) on pages of two or three columns."""
    inside = _glyphs(spark, base).where("y > 40 AND y < 760")
    pages = inside.groupBy("page").agg(F.count_distinct("col").alias("n_columns")).where("n_columns IN (2, 3)")
    return inside.join(pages, "page").groupBy("page").agg(F.max("n_columns").cast("bigint").alias("n_columns"), F.count("*").cast("bigint").alias("n_glyphs"))


def _regions(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "supplier").selectExpr("s_suppkey AS region", "s_suppkey % 9 AS page", "s_suppkey * 71 % 500 AS left", "s_suppkey * 71 % 500 + 120 AS right", "s_suppkey * 97 % 700 AS top", "s_suppkey * 97 % 700 + 150 AS bottom")


def region_join(spark: SparkSession, base: str) -> DataFrame:
    """The region of each glyph: the last one around it, else the last one to its left and above, else to its left, else
    above, else the page's last."""
    found = locate(_glyphs(spark, base), _regions(spark, base))
    return found.groupBy("page", "region", "kind").agg(F.count("*").cast("bigint").alias("n"))


_RUN = "element_at(array(4, 6, 9, 13), CAST(o_orderkey % 4 + 1 AS INT))"


def absorbed_runs(spark: SparkSession, base: str) -> DataFrame:
    """Runs of text with the taller runs that take them as sub- and superscripts, along chains."""
    runs = table(spark, base, "orders").selectExpr("o_orderkey AS id", "o_custkey AS page", "o_orderkey % 3 AS col", "o_orderkey * 7 % 90 AS y", f"{_RUN} AS h")
    return absorb(runs).select("id", F.col("owner").cast("bigint").alias("owner"), "steps")


def border_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Left borders with the nearest right border within a band; cells of the band are listed, so that it is an equi-join."""
    band = 600 // (4 * 3)
    g = _glyphs(spark, base).select("page", "x", "y").distinct()
    left, right = g.where("y < 20").select("page", F.col("x").alias("a")).distinct(), g.where("y > 780").select("page", F.col("x").alias("b")).distinct()
    left = left.withColumn("cell", F.explode(F.expr(f"sequence(a div {band} - 1, a div {band} + 1)")))
    met = left.join(right.withColumn("cell", F.expr(f"b div {band}")), ["page", "cell"]).where(F.abs(F.col("a") - F.col("b")) <= band)
    return met.groupBy("page", "a").agg(F.min(F.struct(F.abs(F.col("a") - F.col("b")).alias("gap"), "b")).alias("m")).select("page", "a", F.col("m.b").alias("b"), F.col("m.gap").alias("gap"))


def reading_order(spark: SparkSession, base: str) -> DataFrame:
    """Glyphs in lines of 12 units, from top to bottom, and from left to right in each."""
    line = F.floor(F.col("y") / 12).cast("bigint")
    w = Window.partitionBy("page").orderBy(line, "x", "y", "id")
    return _glyphs(spark, base).select("page", "id", line.alias("line"), F.row_number().over(w).cast("bigint").alias("place"))


def separator_mass(spark: SparkSession, base: str) -> DataFrame:
    """The share of a page's glyphs between two neighbouring separators, 100 units apart."""
    counts = _glyphs(spark, base).groupBy("page", F.floor(F.col("x") / 100).cast("bigint").alias("band")).agg(F.count("*").cast("bigint").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("page"))
    return counts.select("page", "band", "n", F.round(share, 9).alias("share"), (share >= 0.15).alias("enough"))


#: The shapes of a list item's first characters, in the order in which they are tried.
LIST_ITEMS = (r"^\.", r"^[0-9]+\.", r"^\[[0-9]+\]", r"^[0-9]+\)", r"^[A-Z]\.", r"^[a-z]\.", r"^[A-Z]\)", r"^[a-z]\)", r"^[IVXL]+\.", r"^[ivxl]+\.")
_ITEM_LINE = "concat(element_at(array('', '. ', '12. ', '[3] ', '4) ', 'B. ', 'c. ', 'D) ', 'e) ', 'XI. ', 'iv. '), CAST((doc_id + line_no) % 11 + 1 AS INT)), line)"


def column_separators(spark: SparkSession, base: str) -> DataFrame:
    """The two separators of each page, by which evidence, and what lies between them. Orders stand for glyphs in three columns, with
    some wide ones across them on every third page."""
    wide = "IF(o_custkey % 3 = 0 AND o_orderkey % 97 = 0, 260, o_orderkey * 31 % 120 + 20)"
    rows = table(spark, base, "orders").selectExpr("o_custkey % 40 AS page", "CAST(o_orderkey % 3 * 200 + o_orderkey * 37 % (15 + o_custkey % 5 * 8) AS DOUBLE) AS a", f"{wide} AS w")
    return separators(rows.selectExpr("page", "a", "a + w AS b"), "page", "a", "b", 4, 2)


def list_items(spark: SparkSession, base: str) -> DataFrame:
    """Lines that begin a list item, by the first shape that fits, and those that go on with the shape of the line before."""
    lines = line_scan(table(spark, base, "documents").select("doc_id", "text")).select("doc_id", "line_no", F.expr(_ITEM_LINE).alias("line"))
    shape = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(LIST_ITEMS))):
        shape = F.when(F.rlike("line", F.lit(pattern)), k).otherwise(shape)
    before = F.lag("shape").over(Window.partitionBy("doc_id").orderBy("line_no"))
    found = lines.withColumn("shape", shape).withColumn("same", F.coalesce(before == F.col("shape"), F.lit(False)))
    return found.where("shape IS NOT NULL").groupBy("doc_id", F.col("shape").cast("bigint").alias("shape")).agg(F.count("*").cast("bigint").alias("n"), F.sum(F.col("same").cast("int")).cast("bigint").alias("n_same"))


def type_descent(spark: SparkSession, base: str) -> DataFrame:
    """Word types from the best score on, until one falls by more than 0.1 below the one before it."""
    v = table(spark, base, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("type", "score"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "type")
    falls = F.when(F.lag("score").over(w) - F.col("score") > 0.1, 1).otherwise(0)
    kept = v.withColumn("falls", falls).withColumn("stopped", F.sum("falls").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("stopped = 0")
    return kept.groupBy("vec_id").agg(F.count("*").cast("bigint").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "type"))), lambda x: x["type"]), " ").alias("types"))


def latency_report(spark: SparkSession, base: str) -> DataFrame:
    """Seconds for each event, milliseconds for each unit and the share of all time, by phase and report of 200 events."""
    events = table(spark, base, "events").select((F.col("event_id") / 200).cast("bigint").alias("report"), F.col("event_type").alias("phase"), F.round("value", 6).cast("decimal(18,6)").alias("value"), (F.col("event_id") % 17 + 1).alias("units"))
    phases = events.groupBy("report", "phase").agg(F.count("*").cast("bigint").alias("n"), F.sum("value").cast("double").alias("took"), F.sum("units").cast("bigint").alias("units"))
    total = F.sum("took").over(Window.partitionBy("report"))
    return phases.select("report", "phase", "n", F.round(F.col("took") / F.col("n"), 6).alias("per_event"), F.round(1000 * F.col("took") / F.col("units"), 4).alias("ms_per_unit"), F.round(100 * F.col("took") / total, 4).alias("percent"))


def prediction_score(spark: SparkSession, base: str) -> DataFrame:
    """A prediction's score: the mean of the logarithms of three parts and of the affixes' mean probability (not its logarithm);
    without affixes the mean of the three stands for it."""
    p = table(spark, base, "embeddings").select("vec_id", scoring.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    parts = [F.log(F.get("p", F.lit(k))) for k in range(3)]
    three = sum(parts[1:], parts[0])
    count = (F.col("vec_id") % 4).cast("int")
    affixes = F.aggregate(F.slice("p", F.lit(4), count), F.lit(0.0), lambda a, x: a + x) / count
    return p.select("vec_id", F.round((three + F.when(count > 0, affixes).otherwise(three / 3)) / 4, 9).alias("score"))


def binary_losses(spark: SparkSession, base: str) -> DataFrame:
    """Mean binary cross-entropy of logits against a multi-hot target, in the form that does not overflow."""
    v = table(spark, base, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    loss = F.transform("x", lambda z, i: F.greatest(z, F.lit(0.0)) - z * F.when((F.col("vec_id") + i) % 5 == 0, 1.0).otherwise(0.0) + F.log1p(F.exp(-F.abs(z))))
    return v.select("vec_id", F.round(F.aggregate(loss, F.lit(0.0), lambda a, y: a + y) / F.size("x"), 9).alias("loss"))


QUERIES = {f.__name__: f for f in (column_pages, region_join, absorbed_runs, border_pairs, reading_order, separator_mass, column_separators, list_items, type_descent, latency_report, prediction_score, binary_losses)}

_G = "g AS (SELECT o_orderkey AS id, o_custkey % 9 AS page, o_orderkey * 37 % 600 AS x, o_orderkey * 53 % 800 AS y, CASE WHEN o_custkey % 9 < 3 THEN 0 ELSE o_orderkey % (o_custkey % 9) END AS col FROM orders)"
_RAW = """
parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
last AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM every GROUP BY doc_id),
raw AS (SELECT doc_id, line_no, line FROM every JOIN last USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1))
"""
ORACLE = {
    "column_pages": f"WITH {_G} SELECT page, count(DISTINCT col) AS n_columns, count(*) AS n_glyphs FROM g WHERE y > 40 AND y < 760 GROUP BY page HAVING count(DISTINCT col) IN (2, 3)",
    "region_join": f"""
WITH {_G}, r AS (SELECT s_suppkey AS region, s_suppkey % 9 AS page, s_suppkey * 71 % 500 AS l, s_suppkey * 97 % 700 AS t FROM supplier),
k AS (SELECT id, g.page, region, CASE WHEN x >= l AND x <= l + 120 AND y >= t AND y <= t + 150 THEN 0 WHEN l <= x AND t <= y THEN 1 WHEN l <= x THEN 2 WHEN t <= y THEN 3 ELSE 4 END AS kind FROM g LEFT JOIN r ON g.page = r.page),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, region DESC) AS place FROM k)
SELECT page, CAST(coalesce(region, -1) AS BIGINT) AS region, CASE WHEN region IS NULL THEN -1 ELSE kind END AS kind, count(*) AS n FROM b WHERE place = 1 GROUP BY ALL
""",
    "absorbed_runs": """
WITH RECURSIVE r AS (SELECT o_orderkey AS id, o_custkey AS page, o_orderkey % 3 AS col, o_orderkey * 7 % 90 AS y, list_extract([4, 6, 9, 13], o_orderkey % 4 + 1) AS h FROM orders),
d AS (SELECT b.id, a.id AS taker, a.h AS h_a, b.h, CASE WHEN b.y < a.y THEN a.y - (b.y + b.h) ELSE b.y - (a.y + a.h) END AS gap
  FROM r b JOIN r a ON a.page = b.page AND a.col = b.col AND 0.8 * a.h > b.h),
p AS (SELECT id, taker FROM d WHERE gap < 0.6 * h QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, h_a DESC, taker) = 1),
c AS (SELECT id, id AS owner, CAST(0 AS BIGINT) AS steps FROM r UNION ALL SELECT c.id, p.taker, steps + 1 FROM c JOIN p ON p.id = c.owner)
SELECT id, arg_max(owner, steps) AS owner, max(steps) AS steps FROM c GROUP BY id
""",
    "border_pairs": f"""
WITH {_G}, p AS (SELECT DISTINCT l.page, l.x AS a, r.x AS b, abs(l.x - r.x) AS gap FROM g l JOIN g r ON l.page = r.page AND l.y < 20 AND r.y > 780 AND abs(l.x - r.x) <= 50)
SELECT page, a, b, gap FROM (SELECT *, row_number() OVER (PARTITION BY page, a ORDER BY gap, b) AS k FROM p) WHERE k = 1
""",
    "reading_order": f"WITH {_G} SELECT page, id, y // 12 AS line, row_number() OVER (PARTITION BY page ORDER BY y // 12, x, y, id) AS place FROM g",
    "separator_mass": f"""
WITH {_G}, c AS (SELECT page, x // 100 AS band, count(*) AS n FROM g GROUP BY ALL)
SELECT page, band, n, round(n / sum(n) OVER (PARTITION BY page), 9) AS share, n / sum(n) OVER (PARTITION BY page) >= 0.15 AS enough FROM c
""",
    "list_items": f"""
WITH {_RAW}, l AS (SELECT doc_id, line_no, list_extract(['', '. ', '12. ', '[3] ', '4) ', 'B. ', 'c. ', 'D) ', 'e) ', 'XI. ', 'iv. '], (doc_id + line_no) % 11 + 1) || line AS line FROM raw),
s AS (SELECT doc_id, line_no, CASE {" ".join(f"WHEN regexp_matches(line, '{p}') THEN {k}" for k, p in enumerate(LIST_ITEMS))} END AS shape FROM l),
b AS (SELECT *, coalesce(lag(shape) OVER (PARTITION BY doc_id ORDER BY line_no) = shape, false) AS same FROM s)
SELECT doc_id, CAST(shape AS BIGINT) AS shape, count(*) AS n, count(*) FILTER (same) AS n_same FROM b WHERE shape IS NOT NULL GROUP BY ALL
""",
    "type_descent": """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS score, generate_subscripts(embedding, 1) - 1 AS type FROM embeddings),
f AS (SELECT *, CASE WHEN lag(score) OVER (PARTITION BY vec_id ORDER BY score DESC, type) - score > 0.1 THEN 1 ELSE 0 END AS f FROM v),
s AS (SELECT *, sum(f) OVER (PARTITION BY vec_id ORDER BY score DESC, type ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT vec_id, count(*) AS n, string_agg(CAST(type AS VARCHAR), ' ' ORDER BY score DESC, type) AS types FROM s WHERE s = 0 GROUP BY vec_id
""",
    "latency_report": """
WITH p AS (SELECT event_id // 200 AS report, event_type AS phase, count(*) AS n, CAST(sum(CAST(round(value, 6) AS DECIMAL(18, 6))) AS DOUBLE) AS took, sum(event_id % 17 + 1) AS units FROM events GROUP BY ALL)
SELECT report, phase, n, round(took / n, 6) AS per_event, round(1000 * took / units, 4) AS ms_per_unit, round(100 * took / sum(took) OVER (PARTITION BY report), 4) AS percent FROM p
""",
    "prediction_score": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings),
p AS (SELECT vec_id, vec_id % 4 AS k, list_sum(e) AS s, e FROM e),
t AS (SELECT vec_id, k, ln(e[1] / s) + ln(e[2] / s) + ln(e[3] / s) AS three, coalesce(list_sum(e[4:3 + k]), 0) / s AS a FROM p)
SELECT vec_id, round((three + CASE WHEN k > 0 THEN a / k ELSE three / 3 END) / 4, 9) AS score FROM t
""",
    "binary_losses": """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, round(avg(greatest(z, 0) - z * CASE WHEN (vec_id + i) % 5 = 0 THEN 1 ELSE 0 END + ln(1 + exp(-abs(z)))), 9) AS loss FROM v GROUP BY vec_id
""",
}
