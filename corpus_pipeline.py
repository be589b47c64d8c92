"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, contamination, jaccard, quality, secrets
from tessella.llm.common import drop, table, unused, written
from tessella.llm.subword import score

#: Share of a document's words in benchmark windows beyond which the whole document goes.
MOST_BENCHMARK = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts get the score of an empty bag.

    Rows that repeat are judged each; the input's columns come back whatever their names; an empty table
    gives no rows.
    """
    model, name = quality.fit(docs, table(spark, sf_dir, "labels")), unused(docs, "quality_score")
    return score(docs, model, name).where(F.col(name) >= quality.ACCEPT).select(*_named(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id; texts without words all stay."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark windows cover; documents that are mostly benchmark go.

    Null texts stay null. Other columns come back as they were, whatever their names, but ``n_chars`` counts anew.
    """
    found = contamination.find_contamination(_narrow(docs), table(spark, sf_dir, "benchmark"))
    return _recounted(contamination.remove_spans(found, most_share=MOST_BENCHMARK), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; no document goes. Columns as for ``without_benchmark``."""
    return _recounted(secrets.redact(secrets.scan(_narrow(docs))), docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the digests of the ids and of the text decoded from them; null text counts as empty."""
    return bpe.encode_documents(docs)


def _named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and, in one column, all others, so that none can clash with what a stage adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("others")] if rest else []))


def _recounted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from what ``_narrow`` made of them; ``n_chars`` is that of the new text."""
    out = changed.select(*[F.col(c if c in ("doc_id", "text") else f"others.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", as_tokens),
]

#: The classifier is trained, so no SQL gives the rows; tests/llm/test_pipeline.py holds them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again as the next one's input, and goes
    when that stage's output is written. The last one's is read lazily, and goes when the application ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = written(docs, f"pipeline-{name}")
            if before:
                drop(spark, before)
            before = path
    return docs
