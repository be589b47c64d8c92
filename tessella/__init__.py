"""Tessella: a Spark-first engine for building, aligning, batching and scoring bilingual text."""
