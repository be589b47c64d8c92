"""Deterministic generation of numeric sentence pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import numbers

# Largest numbers with their shares, prefixes with their shares, formats with theirs.
LIMITS = ((999, 0.5), (999_999, 0.28125), (999_999_999, 0.125), (999_999_999_999, 0.0625), (999_999_999_999_999, 0.03125))
MANY = (("a", 0.4), ("ka", 0.3), ("ba", 0.05), ("i", 0.05), ("bi", 0.05), ("tu", 0.05), ("ha", 0.05), ("zi", 0.05))
ONE = (("a", 0.3), ("ka", 0.3), ("ba", 0.05), ("i", 0.05), ("bi", 0.05), ("tu", 0.05), ("ha", 0.05), ("zi", 0.05), ("ru", 0.05), ("ku", 0.05))
FORMATS = (("grouped", 0.1), ("plain", 0.1), ("spelt", 0.8))
#: A linear congruence modulo a prime, so that any engine draws the same numbers.
PRIME = 2_147_483_647
FACTORS = (48_271, 69_621, 39_373, 16_807)


def draw(row: Column, which: int) -> Column:
    """A number from 0 to PRIME - 1 for each row and purpose."""
    step = lambda x: (x * FACTORS[which]) % PRIME
    return step(step(step(row + 1) + which * 7_919 + 11) + 97)


def choose(u: Column, shares) -> Column:
    """One of the values by its share, for u from 0 to PRIME - 1."""
    out, upto = F, 0.0
    for value, share in shares[:-1]:
        upto += share
        out = out.when(u < int(upto * PRIME), F.lit(value))
    return out.otherwise(F.lit(shares[-1][0]))


def numeric_pairs(rows: DataFrame) -> DataFrame:
    """row, n, prefix, format and the Kinyarwanda side for every ``row`` number; ru and ku count only 1, so others with them go."""
    r = rows.select(F.col("row").cast("bigint").alias("row"))
    limit = choose(draw(F.col("row"), 0), LIMITS)
    r = r.select(F.inline(F.array(F.struct("row", (1 + (draw(F.col("row"), 1) * 1_000_003 + draw(F.col("row"), 2)) % limit).alias("n")))))
    prefix = F.when(F.col("n") % 10 == 1, choose(draw(F.col("row"), 3), ONE)).otherwise(choose(draw(F.col("row"), 3), MANY))
    drawn = F.struct("row", "n", prefix.alias("prefix"), choose(draw(F.col("row") + 5, 2), FORMATS).alias("format"))
    r = r.select(F.inline(F.array(drawn)))  # a generator, so that the drawn values are not spelled out again in every use
    prefixes = tuple(p for p, _ in ONE)
    spelt = numbers.spell(numbers.units_for(F.col("prefix"), prefixes), F.col("n"))
    side = F.when(F.col("format") == "spelt", spelt).when(F.col("format") == "grouped", F.regexp_replace(F.col("n").cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")).otherwise(F.col("n").cast("string"))
    return r.withColumn("rw", side).where("rw IS NOT NULL")
