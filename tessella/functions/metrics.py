"""Translation metrics: character/word n-gram F-score per sentence, and corpus BLEU from n-gram counts."""

from __future__ import annotations

import string
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.runtime import ship_code

_PUNCTUATION = set(string.punctuation)


def _words(text: str) -> list[str]:
    """White-space words, with one mark at the end (or else the start) split off."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _overlap(hyp, ref, n: int) -> tuple[int, int, int]:
    a = Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1))
    b = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
    return sum((a & b).values()), sum(a.values()), sum(b.values())


def chrf_score(hyp: str, ref: str, chars: int = 6, words: int = 2, beta: float = 2.0) -> float:
    """Mean over all orders of the F-score of clipped n-gram overlap; characters without white space."""
    total = 0.0
    for seq, orders in ((lambda t: "".join(t.split()), chars), (_words, words)):
        h, r = seq(hyp), seq(ref)
        for n in range(1, orders + 1):
            hit, n_h, n_r = _overlap(h, r, n)
            p, q = hit / n_h if n_h else 0.0, hit / n_r if n_r else 0.0
            total += (1 + beta**2) * p * q / max(beta**2 * p + q, 1e-16)
    return total / (chars + words)


def _chrf_batch(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([chrf_score(h or "", r or "") for h, r in zip(hyp, ref)])


def chrf(hyp: str, ref: str) -> Column:
    """``chrf_score`` of two string columns, in Arrow batches: exploding all n-grams would make thousands of rows each."""
    ship_code(SparkSession.active())
    return F.pandas_udf(_chrf_batch, T.DoubleType())(hyp, ref)


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams as strings, with repeats."""
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _numbered(grams: Column, n: int, h: int, r: int) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(h).alias("h"), F.lit(r).alias("r")))


def clipped_counts(pairs: DataFrame, key: str, hyp: str, ref: str, orders: int = 4) -> DataFrame:
    """n, matched and total over all pairs of ``key``, hyp and ref word arrays, for each order.

    Both sides' n-grams come from one pass, so that those of pairs that were dealt by ``key`` are counted where they arise.
    """
    numbered = [_numbered(ngrams(F.col(side), n), n, int(side == hyp), int(side == ref)) for side in (hyp, ref) for n in range(1, orders + 1)]
    each = pairs.select(key, F.explode(F.flatten(F.array(*numbered))).alias("x")).select(key, "x.*")
    counts = each.groupBy(key, "n", "g").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    return counts.groupBy("n").agg(F.sum(F.least("h", "r")).alias("matched"), F.sum("h").alias("total"))

