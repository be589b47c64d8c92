"""Positional pairing of two languages and the length filter (the flagship query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.pairing import length_filter, pair_by_rank
from tessella.sources.tables import table


def positional_pairs(spark: SparkSession, base: str) -> DataFrame:
    pairs = pair_by_rank(table(spark, base, "documents"), "en", "fr")
    return pairs.select("rank", F.col("left_id").alias("en_id"), F.col("right_id").alias("fr_id"))


def pair_length_filter(spark: SparkSession, base: str) -> DataFrame:
    kept = length_filter(pair_by_rank(table(spark, base, "documents"), "en", "fr"), 300)
    return kept.groupBy("source").agg(
        F.count("*").cast("bigint").alias("n_pairs"),
        F.sum("avg_len").cast("bigint").alias("sum_avg_len"),
        F.round(F.avg("avg_len"), 6).alias("mean_avg_len"),
    )


_RANKED = """
WITH ranked AS (
  SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank
  FROM documents WHERE lang IN ('en', 'fr')
), paired AS (
  SELECT a.rank, a.doc_id AS en_id, b.doc_id AS fr_id, a.source,
         len(list_filter(regexp_split_to_array(a.text, '\\s+'), lambda x: x <> '')) AS n_en,
         len(list_filter(regexp_split_to_array(b.text, '\\s+'), lambda x: x <> '')) AS n_fr
  FROM ranked a JOIN ranked b ON a.rank = b.rank AND a.lang = 'en' AND b.lang = 'fr'
)
"""

QUERIES = {"positional_pairs": positional_pairs, "pair_length_filter": pair_length_filter}
ORACLE = {
    "positional_pairs": _RANKED + "SELECT rank, en_id, fr_id FROM paired",
    "pair_length_filter": _RANKED
    + """
SELECT source, count(*) AS n_pairs, CAST(sum((n_en + n_fr + 4) // 2 + 1) AS BIGINT) AS sum_avg_len,
       round(avg((n_en + n_fr + 4) // 2 + 1), 6) AS mean_avg_len
FROM paired WHERE n_en < 300 AND n_fr < 300 GROUP BY source
""",
}
