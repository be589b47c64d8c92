"""Queries over record files: packed lines, name lists, statistics, vocabularies, tables, collections, page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import records, text
from tessella.operators import vocabulary
from tessella.sources.tables import line_scan, table


def _lines(spark: SparkSession, base: str) -> DataFrame:
    return line_scan(table(spark, base, "documents").select("doc_id", "text"))


def delimiter_lengths(spark: SparkSession, base: str) -> DataFrame:
    """The length of each packed line from its delimiters, every second document tab-separated; blank lines are not left out."""
    packed = F.when(F.col("doc_id") % 2 == 0, F.replace("line", F.lit(" "), F.lit(";"))).otherwise(F.replace("line", F.lit(" "), F.lit("\t")))
    lines = _lines(spark, base).withColumn("n", records.delimiter_length(packed))
    return lines.groupBy("doc_id").agg(F.count("*").cast("bigint").alias("n_lines"), F.sum("n").cast("bigint").alias("n_tokens"))


def name_list(spark: SparkSession, base: str) -> DataFrame:
    """Names and numbers: all cells of comma-split lines after the header, with customers' and frequent capitalised words,
    trimmed, each once, Latin letters only."""
    cells = _lines(spark, base).where("line_no > 0").select(F.explode(F.split("line", ",")).alias("cell")).select(records.trimmed_name(F.col("cell")).alias("name"))
    people = table(spark, base, "customer").select(records.trimmed_name(F.concat(F.lit("\t"), "c_name", F.lit(".’"))).alias("name"))
    docs = vocabulary.dealt_whole(table(spark, base, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("t"), "doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.rlike("w", F.lit("^[A-Z]")), 1).otherwise(0)).alias("up"))
    stats = counts.groupBy("t").agg(F.count("*").alias("docs"), F.sum("n").alias("total"), F.sum("up").alias("up"))
    proper = stats.where("docs > 3 AND total > 6 AND up > 0.7 * total").select(records.trimmed_name(text.capitalise(F.col("t"))).alias("name"))
    every = cells.unionByName(people).unionByName(proper).distinct()
    return every.where(text.is_latin(F.col("name"))).select("name", F.length("name").cast("bigint").alias("n_chars"))


_STATS_LINE = """concat(CASE WHEN p_partkey % 17 = 0 THEN ',' ELSE p_name END, ',', p_partkey % 2, ',', p_size * 10, ',', p_size, ',', p_partkey % 5, ',', p_partkey % 7, ',', p_size * (p_partkey % 11),
  CASE WHEN p_partkey % 23 = 1 THEN '' ELSE concat(',', CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) END)"""


def stats_records(spark: SparkSession, base: str) -> DataFrame:
    """Records of a statistics file, their percentile by line, and the form that the proper-noun rule gives them."""
    lines = table(spark, base, "part").select("p_partkey", F.expr(_STATS_LINE).alias("line"))
    total = lines.agg(F.count("*").alias("lines"))
    read = lines.select("p_partkey", records.stats_record(F.col("line")).alias("r")).crossJoin(F.broadcast(total)).where("r IS NOT NULL")
    kept = (F.col("r.documents") > 3) & (F.col("r.total") > 6)
    form = F.when(kept & (F.col("r.first_up") > 0.7 * F.col("r.total")), text.capitalise(F.col("r.token"))).when(kept & (F.col("r.numeric") != 0), F.col("r.token"))
    return read.select("p_partkey", "r.token", "r.total", "r.documents", "r.first_up", F.floor(100 * F.col("p_partkey") / F.col("lines")).cast("bigint").alias("pct_rank"), form.alias("form"))


def stem_vocabulary(spark: SparkSession, base: str) -> DataFrame:
    lines = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ',', p_size) WHEN 1 THEN concat(p_name, ',,', p_size) ELSE concat(',', p_name, ',,') END")
    return table(spark, base, "part").select("p_partkey", records.stem_value(lines).alias("stem"))


def affix_table(spark: SparkSession, base: str) -> DataFrame:
    """Rows of a colon-separated table, blank lines skipped, with the affixes that each set lists."""
    line = F.expr("CASE WHEN l_linenumber = 3 THEN '  ' ELSE concat(' ', l_orderkey % 9, ':', l_linenumber, ':', l_suppkey % 50, '-', l_partkey % 50, ' ') END")
    read = table(spark, base, "lineitem").select(records.fields(line, ":").alias("f")).where("f IS NOT NULL")
    affixes = F.transform(F.split(F.get("f", F.lit(2)), "-"), lambda x: x.cast("bigint"))
    parsed = read.select(F.get("f", F.lit(0)).cast("bigint").alias("word_type"), F.get("f", F.lit(1)).cast("bigint").alias("slot"), F.explode(affixes).alias("affix"))
    return parsed.groupBy("word_type", "slot", "affix").agg(F.count("*").cast("bigint").alias("n"))


def top_names(spark: SparkSession, base: str) -> DataFrame:
    """The first names of each country and group, as many as the country may have."""
    most = F.when(F.col("c_nationkey") % 5 == 0, 5).when(F.col("c_nationkey") % 5 == 1, 3).otherwise(1)
    place = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranked = table(spark, base, "customer").withColumn("place", place.cast("bigint")).where(F.col("place") <= most)
    return ranked.select("c_nationkey", "c_mktsegment", "place", "c_name")


def page_range(spark: SparkSession, base: str) -> DataFrame:
    """Lines of pages 2 to 3 of each document, a page being 20 lines; pages count from 1 and both bounds are in."""
    page = F.floor(F.col("line_no") / 20).cast("bigint") + 1
    kept = _lines(spark, base).withColumn("page", page).where(F.col("page").between(2, 3))
    return kept.groupBy("doc_id", "page").agg(F.count("*").cast("bigint").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars"))


#: corpus, role, whether names, foreign terms and evaluation sets are asked for when it is taken.
_CONFIG = [("src0", "train", 0), ("src1", "names", 1), ("src2", "foreign", 0), ("src3", "train", 0), ("src4", "eval", 1)]


def named_collections(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the collections that a configuration names; names and evaluation sets join only if they are asked for."""
    config = spark.createDataFrame(_CONFIG, "source string, role string, asked int").where("role = 'train' OR asked = 1")
    docs = table(spark, base, "documents").select("source", "doc_id")
    return docs.join(F.broadcast(config), "source").groupBy("source", "role").agg(F.count("*").cast("bigint").alias("n_rows"))


QUERIES = {f.__name__: f for f in (delimiter_lengths, name_list, stats_records, stem_vocabulary, affix_table, top_names, page_range, named_collections)}

_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_RAW = """
WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
last AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM every GROUP BY doc_id),
raw AS (SELECT doc_id, line_no, line FROM every JOIN last USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1))
"""
_TRIM = "trim(trim({x}), concat(chr(9), ';,.’‘', chr(39), '\"'))"
ORACLE = {
    "delimiter_lengths": _RAW
    + """SELECT doc_id, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(CASE WHEN doc_id % 2 = 0 THEN replace(line, ' ', ';') ELSE replace(line, ' ', chr(9)) END, '[;\\t]')) // 2 + 1) AS BIGINT) AS n_tokens FROM raw GROUP BY doc_id""",
    "name_list": _RAW
    + f""", w AS (SELECT doc_id, unnest({_W}) AS w FROM documents),
s AS (SELECT lower(w) AS t FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 3 AND count(*) > 6 AND count(*) FILTER (regexp_matches(w, '^[A-Z]')) > 0.7 * count(*)),
a AS (SELECT {_TRIM.format(x="unnest(string_split(line, ','))")} AS name FROM raw WHERE line_no > 0
  UNION SELECT c_name FROM customer UNION SELECT {_TRIM.format(x="upper(left(t, 1)) || substr(t, 2)")} FROM s)
SELECT name, length(name) AS n_chars FROM a WHERE NOT regexp_matches(regexp_replace(name, '\\p{{Latin}}', '', 'g'), '\\p{{L}}')""",
    "stats_records": f"""
WITH l AS (SELECT p_partkey, {_STATS_LINE} AS line, count(*) OVER () AS lines FROM part),
f AS (SELECT *, string_split(line, ',') AS f FROM l),
r AS (SELECT p_partkey, lines, CASE WHEN len(f) = 9 THEN ',' ELSE f[1] END AS token, CAST(f[-6] AS DOUBLE) AS total, CAST(f[-5] AS DOUBLE) AS documents,
  CAST(f[-2] AS DOUBLE) AS first_up, CAST(f[-1] AS DOUBLE) AS is_number FROM f WHERE len(f) IN (8, 9))
SELECT p_partkey, token, total, documents, first_up, 100 * p_partkey // lines AS pct_rank,
  CASE WHEN documents > 3 AND total > 6 THEN CASE WHEN first_up > 0.7 * total THEN upper(left(token, 1)) || substr(token, 2) WHEN is_number <> 0 THEN token END END AS form FROM r
""",
    "stem_vocabulary": """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ',' ELSE ',' || p_name || ',' END AS stem FROM part
""",
    "affix_table": """
SELECT word_type, slot, affix, count(*) AS n FROM (SELECT l_orderkey % 9 AS word_type, CAST(l_linenumber AS BIGINT) AS slot, unnest([l_suppkey % 50, l_partkey % 50]) AS affix FROM lineitem WHERE l_linenumber <> 3) GROUP BY ALL
""",
    "top_names": """
SELECT c_nationkey, c_mktsegment, place, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer)
WHERE place <= CASE c_nationkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END
""",
    "page_range": _RAW + "SELECT doc_id, line_no // 20 + 1 AS page, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM raw WHERE line_no BETWEEN 20 AND 59 GROUP BY ALL",
    "named_collections": """
SELECT source, CASE source WHEN 'src1' THEN 'names' WHEN 'src4' THEN 'eval' ELSE 'train' END AS role, count(*) AS n_rows FROM documents WHERE source IN ('src0', 'src1', 'src3', 'src4') GROUP BY ALL
""",
}
