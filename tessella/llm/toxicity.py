"""Toxicity: subword-bag embeddings under a linear softmax, read in windows of words.

Misspelt and unseen words share the vectors of their character n-grams with those that were seen. A
document is as toxic as its most toxic window, so a few words count in a text of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.subword import Model, Spec, is_held_out, labelled_sample, score, train

#: The window and its epochs were chosen on an inner fold of the training rows.
SPEC = Spec(window=3, bag_epochs=6, window_epochs=20)
MODULUS, HELD_OUT = 3, 1
FLAG = 0.7


def fit(docs: DataFrame, labels: DataFrame, spec: Spec = SPEC) -> Model:
    """Learns ``labels.toxic`` from a bounded sample outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, spec), spec)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, by a model that never saw the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id", MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))
