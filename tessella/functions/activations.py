"""Activations of the feed-forward layers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_OVER_ROOT_PI = 1.1283791670955126
#: Fixed value: what stands for the root of two where a bias is added.
SHORT_ROOT = 1.41421
FLAT = 6.0  # from here on the error function is 1 in double precision


def erf(x: Column) -> Column:
    """The error function to about 1e-15: exp(-x²) times a series whose terms are all positive, so that none cancel."""
    square = x * x
    terms = F.sequence(F.lit(1), F.ceil(4 * square).cast("int") + 24)
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * (square * 2 / (k * 2 + 1))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    inside = x * TWO_OVER_ROOT_PI * F.exp(-square) * F.aggregate(terms, state, step, lambda s: s["sum"])
    return F.when(F.isnan(x), x).when(F.abs(x) >= FLAT, F.signum(x)).otherwise(inside)


def gelu(x: Column) -> Column:
    return x * 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


def bias_gelu(x: Column, bias: Column) -> Column:
    return (x + bias) * 0.5 * (1 + erf((x + bias) / SHORT_ROOT))


def bias_tanh(x: Column, bias: Column) -> Column:
    return F.tanh(x + bias)


def swish(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
