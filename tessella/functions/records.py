"""Readers of the record formats of statistics, vocabularies, affix tables and name lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that are cut off both ends of a name.
NAME_EDGES = "\t;,.’‘'\""
#: Fields after the token in a statistics record, from the left.
STATS_FIELDS = ("correctness", "total", "documents", "all_up", "all_low", "first_up", "numeric")


def delimiter_length(line: Column) -> Column:
    """Tokens of a packed line, from its delimiters alone: one more than half of all ``;`` and tabs."""
    marks = F.length(line) - F.length(F.replace(F.replace(line, F.lit(";"), F.lit("")), F.lit("\t"), F.lit("")))
    return F.floor(marks / 2).cast("bigint") + 1


def trimmed_name(cell: Column) -> Column:
    """A name without white space and marks at its ends."""
    return F.btrim(F.trim(cell), F.lit(NAME_EDGES))


def stats_record(line: Column) -> Column:
    """A statistics record: a token and seven numbers. In a record of nine fields the token is the comma itself.

    Null where the number of fields is neither eight nor nine.
    """
    f = F.split(line, ",", -1)
    field = lambda k: F.try_element_at(f, F.lit(k))
    numbers = [F.try_to_number(field(k - 7), F.lit("999999999999")).cast("double").alias(name) for k, name in enumerate(STATS_FIELDS)]
    token = F.when(F.size(f) == 9, ",").otherwise(F.get(f, F.lit(0)))
    return F.when(F.size(f).isin(8, 9), F.struct(token.alias("token"), *numbers))


def stem_value(line: Column) -> Column:
    """The stem of a vocabulary line: what stands before the first comma, with it if two commas follow each other first.

    A line without a comma is an error, as it cannot come from a vocabulary.
    """
    at, double = F.instr(line, ","), F.instr(line, ",,")
    missing = F.raise_error(F.concat(F.lit("a vocabulary line without a comma: "), line)).cast("string")
    return F.when(at == 0, missing).when(double > 0, F.left(line, double)).otherwise(F.left(line, at - 1))


def fields(line: Column, separator: str) -> Column:
    """The trimmed fields of a table's line; null for a blank line, which is skipped."""
    return F.when(F.trim(line) != "", F.transform(F.split(F.trim(line), separator), lambda x: F.trim(x)))


def casing_record(line: Column) -> Column:
    """(word, n, n_first_up) of a line of three tab-separated fields; null for a line of more or fewer, or whose counts are none."""
    f = F.split(line, "\t", -1)
    number = lambda k: F.try_to_number(F.get(f, F.lit(k)), F.lit("999999999999999999")).cast("bigint")
    record = F.struct(F.get(f, F.lit(0)).alias("word"), number(1).alias("n"), number(2).alias("n_first_up"))
    return F.when((F.size(f) == 3) & number(1).isNotNull() & number(2).isNotNull(), record)
