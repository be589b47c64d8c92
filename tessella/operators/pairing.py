"""Joining two line files by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranking import with_running


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens; null and blank text have none."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.size(F.split(squeezed, " ")))


def pair_by_rank(docs: DataFrame, left: str, right: str) -> DataFrame:
    """Row k of language ``left`` joined to row k of ``right``; rows without a partner go.

    Only the token counts travel: texts are reduced to their length before the ranking shuffle.
    """
    ranked = docs.where(F.col("lang").isin(left, right)).select("doc_id", "lang", "source", token_count(F.col("text")).alias("n_tokens"))
    ranked = with_running(ranked, ["doc_id"], ["lang"])
    a = ranked.where(F.col("lang") == left).select("rank", F.col("doc_id").alias("left_id"), "source", F.col("n_tokens").alias("n_left"))
    b = ranked.where(F.col("lang") == right).select("rank", F.col("doc_id").alias("right_id"), F.col("n_tokens").alias("n_right"))
    return a.join(b, "rank")


def length_filter(pairs: DataFrame, limit: int) -> DataFrame:
    """Pairs with fewer than ``limit`` tokens on both sides, with ``avg_len`` over wrapped lengths."""
    wrapped = F.col("n_left") + F.col("n_right") + 4
    return pairs.where((F.col("n_left") < limit) & (F.col("n_right") < limit)).withColumn("avg_len", F.expr("CAST(0 AS INT)") + F.floor(wrapped / 2) + 1)
