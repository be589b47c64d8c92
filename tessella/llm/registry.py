"""The queries of this part, each over its whole table, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, chat, contamination, divergence, jaccard, negatives, neighbours, quality, repeats, secrets, sharding, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_secret_scans": secrets.op2_secret_scans,
        "op3_bpe": bpe.op3_bpe,
        "op4_decontamination": contamination.op4_decontamination,
        "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
        "op6_sharding": sharding.op6_sharding,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_ann": neighbours.op9_ann,
        "op10_suffix_array_dedup": repeats.op10_suffix_array_dedup,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_simhash": simhash.op12_simhash,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scans": secrets.ORACLE,
        "op4_decontamination": contamination.ORACLE,
        "op5_ngram_jaccard_join": jaccard.ORACLE,
        "op7_chat_formatting": chat.ORACLE,
        "op9_ann": neighbours.ORACLE,
        "op10_suffix_array_dedup": repeats.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op13_hard_negatives": negatives.ORACLE,
    }
