"""Quality classifier: supervised subword embeddings averaged per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.subword import Model, Spec, is_held_out, labelled_sample, score, train

#: Case and marks matter for quality, so nothing is folded; word pairs show lists and repetition.
SPEC = Spec(fold=False, pairs=True, n_grams=(3, 4), bag_epochs=15)
MODULUS, HELD_OUT = 4, 2
ACCEPT = 0.7


def fit(docs: DataFrame, labels: DataFrame, spec: Spec = SPEC) -> Model:
    """Learns ``labels.quality`` from a bounded sample outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, spec), spec)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, by a model that never saw the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id", MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
