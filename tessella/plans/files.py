"""Queries that write files and read them back: lines, shards, ids, pairs, aligned files, a casing lexicon, resumed streams.

Each run writes to a folder of its own in the shared folder, which goes when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import records, text
from tessella.runtime import gone_at_end, shared_dir
from tessella.sources import sinks
from tessella.sources.tables import line_scan, table
from tessella.streaming.ingest import append_new, stream_files

SHARD = 4096  # places in a file


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    gone_at_end(spark, path)
    return path


def line_files(spark: SparkSession, base: str) -> DataFrame:
    """Every line of every document, written as line files and counted there; blank lines stay lines."""
    path = _folder(spark, "lines")
    sinks.write_lines(line_scan(table(spark, base, "documents").select("doc_id", "text")), path)
    return spark.read.schema("line string").text(path).groupBy("line").agg(F.count("*").cast("bigint").alias("n"))


def shard_files(spark: SparkSession, base: str) -> DataFrame:
    """Documents in files of 4,096 places each, whose names carry number, start and end."""
    path = _folder(spark, "shards")
    sinks.write_shards(table(spark, base, "documents").select(F.col("doc_id").alias("place"), F.col("text").alias("line")), path, SHARD)
    read = spark.read.schema("value string, shard string").text(path)
    digests = F.array_sort(F.collect_list(F.md5(F.col("value").cast("binary"))))
    return read.groupBy("shard").agg(F.count("*").cast("bigint").alias("n"), F.sum(F.length("value")).cast("bigint").alias("n_chars"), F.md5(F.array_join(digests, ",").cast("binary")).alias("digest"))


def token_files(spark: SparkSession, base: str) -> DataFrame:
    """Token ids (word lengths) of every document, written with tabs between and read again: lines by number and sum of ids."""
    path = _folder(spark, "ids")
    sinks.write_ids(table(spark, base, "documents").select(F.transform(text.tokens(F.col("text")), lambda x: F.length(x)).alias("ids")), path)
    sums = sinks.read_ids(spark, path).select(F.size("ids").cast("bigint").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
    return sums.groupBy("n_ids", "total").agg(F.count("*").cast("bigint").alias("n"))


def _said(spark: SparkSession, base: str) -> DataFrame:
    """What users say with the assistant's answers, each pair with a place."""
    turns = table(spark, base, "conversations")
    asked, answered = turns.where("role = 'user'"), turns.where("role = 'assistant'")
    met = asked.alias("a").join(answered.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return met.select((F.col("a.conv_id") * 64 + F.col("a.turn")).alias("place"), F.col("a.text").alias("asked"), F.col("b.text").alias("answered"))


def pair_files(spark: SparkSession, base: str) -> DataFrame:
    """Pairs on one line each, with a tab between their sides."""
    path = _folder(spark, "pairs")
    sinks.write_pairs(_said(spark, base), path, "asked", "answered")
    sides = F.split("value", "\t", -1)
    read = spark.read.schema("value string").text(path).select(F.get(sides, F.lit(0)).alias("asked"), F.get(sides, F.lit(1)).alias("answered"))
    return read.groupBy("asked", "answered").agg(F.count("*").cast("bigint").alias("n"))


def aligned_files(spark: SparkSession, base: str) -> DataFrame:
    """The same pairs as two row-aligned files for every 4,096 places, joined again by file and line."""
    path = _folder(spark, "aligned")
    sinks.write_aligned(_said(spark, base), path, ["asked", "answered"], SHARD)
    return sinks.read_aligned(spark, path, ["asked", "answered"]).select("shard", F.col("line_no").cast("bigint").alias("line_no"), "asked", "answered")


def casing_lexicon(spark: SparkSession, base: str) -> DataFrame:
    """Words with their counts and how often they begin with a capital, written as a lexicon file and read again. Words of seven
    characters are written without the last field and those of eight with one too many, and so are no records."""
    path = _folder(spark, "lexicon")
    words = table(spark, base, "documents").select(F.explode(text.tokens(F.col("text"))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").cast("string").alias("n"), F.sum(F.when(F.rlike("w", F.lit("^[A-Z]")), 1).otherwise(0)).cast("string").alias("up"))
    fields = F.when(F.length("word") == 7, F.array("word", "n")).when(F.length("word") == 8, F.array("word", "n", "up", F.lit("x")))
    sinks.write_lines(counts.select(F.array_join(F.coalesce(fields, F.array("word", "n", "up")), "\t").alias("line")), path)
    return spark.read.schema("line string").text(path).select(records.casing_record(F.col("line")).alias("r")).where("r IS NOT NULL").select("r.*")


def ingested_events(spark: SparkSession, base: str) -> DataFrame:
    """Events streamed into a table that holds every third of them already, twice over with one checkpoint: each is there once, and
    those that were there first stay as they were."""
    path = _folder(spark, "events")
    events = table(spark, base, "events").select("event_id", "user_id", "event_type")
    events.where("event_id % 3 = 0").withColumn("run", F.lit(0)).write.parquet(f"{path}/out")
    made = lambda batch: batch.select("event_id", "user_id", "event_type").withColumn("run", F.lit(1))
    for _ in range(2):
        stream = stream_files(spark, f"{base}/events*.parquet", table(spark, base, "events").schema)
        append_new(stream, "event_id", f"{path}/out", f"{path}/checkpoint", made).awaitTermination()
    done = spark.read.parquet(f"{path}/out")
    return done.groupBy("event_type", "run").agg(F.count("*").cast("bigint").alias("n"), F.count_distinct("event_id").cast("bigint").alias("n_ids"), F.sum("user_id").cast("bigint").alias("users"))


QUERIES = {f.__name__: f for f in (line_files, shard_files, token_files, pair_files, aligned_files, casing_lexicon, ingested_events)}

_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_RAW = """
WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
last AS (SELECT doc_id, coalesce(max(line_no) FILTER (line <> ''), -1) AS full_no FROM every GROUP BY doc_id),
raw AS (SELECT doc_id, line_no, line FROM every JOIN last USING (doc_id) WHERE line_no <= greatest(full_no, n - 4 - 1))
"""
_SAID = """
WITH s AS (SELECT a.conv_id * 64 + a.turn AS place, coalesce(a.text, '') AS asked, coalesce(b.text, '') AS answered
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')
"""
_FLAT = "regexp_replace({}, '[\\r\\n]+', ' ', 'g')"
ORACLE = {
    "line_files": _RAW + f"SELECT {_FLAT.format('line')} AS line, count(*) AS n FROM raw GROUP BY 1",
    "shard_files": f"""
WITH d AS (SELECT doc_id // {SHARD} AS k, {_FLAT.format("coalesce(text, '')")} AS v FROM documents)
SELECT concat_ws('_', k, k * {SHARD}, (k + 1) * {SHARD}) AS shard, count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS n_chars, md5(string_agg(md5(v), ',' ORDER BY md5(v))) AS digest FROM d GROUP BY k
""",
    "token_files": f"""
WITH d AS (SELECT list_transform(coalesce({_W}, []), lambda x: length(x)) AS ids FROM documents)
SELECT len(ids) AS n_ids, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS total, count(*) AS n FROM d GROUP BY ALL
""",
    "pair_files": _SAID + "SELECT regexp_replace(asked, '[\\t\\r\\n]+', ' ', 'g') AS asked, regexp_replace(answered, '[\\t\\r\\n]+', ' ', 'g') AS answered, count(*) AS n FROM s GROUP BY 1, 2",
    "aligned_files": _SAID + f"SELECT place // {SHARD} AS shard, row_number() OVER (PARTITION BY place // {SHARD} ORDER BY place) - 1 AS line_no, {_FLAT.format('asked')} AS asked, {_FLAT.format('answered')} AS answered FROM s",
    "casing_lexicon": f"""
SELECT lower(w) AS word, count(*) AS n, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS n_first_up FROM (SELECT unnest({_W}) AS w FROM documents) GROUP BY 1 HAVING length(lower(w)) NOT IN (7, 8)
""",
    "ingested_events": "SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS run, count(*) AS n, count(DISTINCT event_id) AS n_ids, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY ALL",
}
