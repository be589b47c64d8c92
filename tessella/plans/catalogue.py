"""Every registered query of the corpus engine, with its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import assembly, decoding, evaluation, files, gazettes, glyphs, layouts, models, morphs, pagework, pairs, records, runs, scripts, search, sequences, texts

FAMILIES = [pairs, records, assembly, sequences, texts, decoding, evaluation, layouts, pagework, search, glyphs, gazettes, morphs, scripts, runs, files, models]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in FAMILIES:
        found.update(family.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(family.ORACLE)
    return found
