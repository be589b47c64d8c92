"""Copies, activations and turned gradients against plain Python."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import activations
from tessella.operators import copying, vaccine


def plain_choice(probs, words):
    """The rule as a loop over words in the order of their first places."""
    out = {}
    for n, p in probs.items():
        best, share = None, 0.0
        for word, (_, at) in sorted(words.get(n, {}).items(), key=lambda w: w[1][0]):
            hit = sum(p.get(k, 0) > 0.5 for k in at)
            mass = round(sum(p.get(k, 0) for k in at) / sum(p.values()), 12) if sum(p.values()) else 0
            if hit / len(at) > 0.5 and mass > share:
                best, share = word, mass
        out[n] = (best, math.log(share + 1e-36))
    return out


def test_copied_words_stay_where_their_hypothesis_is(spark):
    """Words dealt by hypothesis are dealt no more: neither to meet the probabilities nor to be grouped by word."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        probs = spark.range(40).selectExpr("id div 4 AS n", "CAST(id % 4 AS INT) AS pos", "id / 40 AS p")
        words = spark.range(40).selectExpr("id div 4 AS n", "CAST(id % 4 AS INT) AS pos", "CAST(id % 3 AS STRING) AS word", "id AS place").repartition("n")
        plan = copying.copy_choice(probs, words)._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert dealt and not any("word#" in by or "pos#" in by for by in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_copy_choice_equals_a_loop(spark):
    rng = random.Random(8)
    probs = {n: {k: rng.choice([0.0, 0.1, 0.5, 0.6, 0.9]) for k in range(rng.randint(1, 9))} for n in range(60)}
    probs[60] = {0: 0.0, 1: 0.0}
    words = {n: {f"w{j}": (j, set(rng.sample(range(11), rng.randint(1, 4)))) for j in range(rng.randint(1, 6))} for n in range(50)}
    words[60] = {"w0": (0, {0, 1})}
    left = spark.createDataFrame([(n, k, x) for n, p in probs.items() for k, x in p.items()], "n int, pos int, p double")
    right = spark.createDataFrame([(n, k, w, place) for n, ws in words.items() for w, (place, at) in ws.items() for k in at], "n int, pos int, word string, place int")
    got = {r["n"]: (r["word"], r["logp"]) for r in copying.copy_choice(left, right).collect()}
    want = plain_choice(probs, words)
    assert {n: w for n, (w, _) in got.items()} == {n: w for n, (w, _) in want.items()}
    assert all(abs(got[n][1] - want[n][1]) < 1e-9 for n in want)
    assert copying.copy_choice(left.limit(0), right).count() == 0


def test_extensions_by_hand(spark):
    choice = spark.createDataFrame([(1, "ab", -0.5), (2, None, -80.0), (3, "ab", -0.5)], "n int, word string, logp double")
    option = "array<struct<id:int,lp:double>>"
    hypotheses = spark.createDataFrame([(1, 3, -1.0, [(7, -0.1)]), (2, 3, -1.0, [(7, -0.1), (8, -0.4)]), (3, 6, -1.0, []), (4, 2, 0.0, [(9, -2.0)])], f"n int, length int, logp0 double, options {option}")
    ids = F.transform(F.split("word", ""), lambda c: F.ascii(c))
    got = {(r["n"], r["rank"]): (r["kind"], r["added"], round(r["logp"], 9)) for r in copying.extended(choice, hypotheses, ids, 8).collect()}
    assert got == {(1, 0): ("copied", [97, 98], -1.5), (2, 0): ("beam", [7], -1.1), (2, 1): ("beam", [8], -1.4), (3, 0): ("completed", [97, 98], -1.5), (4, 0): ("beam", [9], -2.0)}


def test_error_function_is_exact(spark):
    xs = [0.0, -0.0, 1e-300, 1e-9, 5.9999, 6.0, -7.0, 40.0, math.inf, -math.inf] + [k / 37 for k in range(-260, 260)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").select("k", activations.erf(F.col("x")).alias("e")).collect()
    assert all(abs(r["e"] - math.erf(xs[r["k"]])) < 4e-15 for r in got)
    row = spark.createDataFrame([(float("nan"), None)], "x double, y double").select(activations.erf(F.col("x")).alias("a"), activations.gelu(F.col("y")).alias("b"), activations.swish(F.lit(-800.0)).alias("c")).first()
    assert math.isnan(row["a"]) and row["b"] is None and row["c"] == 0


def test_gradients_keep_their_agreement(spark):
    rng = np.random.default_rng(5)
    rows = [(run, step, task, rng.normal(size=6).tolist()) for run in range(3) for step in range(5) for task in range(1 + (run + step) % 3)]
    frame = spark.createDataFrame([*rows, (None, 0, 0, [1.0]), (0, 0, 0, None)], "run long, step long, task long, grad array<double>").repartition(4)
    got = {(r["run"], r["step"]): (r["grad"], r["turns"]) for r in vaccine.merged_gradients(frame, 0.2, seed=3).collect()}
    want = {}
    for run in range(3):
        target = {}
        for step in range(5):
            grads = {t: np.array(g) for r, s, t, g in rows if (r, s) == (run, step)}
            turned, turns = {}, 0
            for i in grads:
                g = grads[i]
                for j in vaccine.order_of(step, i, [k for k in grads if k != i], 3):
                    cos, t = g @ grads[j] / np.linalg.norm(g) / np.linalg.norm(grads[j]), target.get((i, j), 0.0)
                    if cos < t:
                        before = np.linalg.norm(g)
                        g = g + grads[j] * before * (t * math.sqrt(1 - cos**2) - cos * math.sqrt(1 - t * t)) / (np.linalg.norm(grads[j]) * math.sqrt(1 - t * t))
                        assert abs(g @ grads[j] / np.linalg.norm(g) / np.linalg.norm(grads[j]) - t) < 1e-9  # the turned one agrees as much as it should
                        target[i, j] = 0.8 * t + 0.2 * cos
                        turns += 1
                turned[i] = g
            want[run, step] = (np.mean(list(turned.values()), axis=0), turns)
    assert set(got) == set(want)
    assert all(np.allclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_zero_gradients_and_parts_that_some_lack(spark):
    rows = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (0, 0, 1, [3.0, 4.0]), (0, 1, 0, [0.0, 0.0]), (0, 1, 1, [2.0, 2.0])], "run long, step long, task long, grad array<double>")
    got = {r["step"]: r["grad"] for r in vaccine.merged_gradients(rows).collect()}
    assert got == {0: [2.0, 4.0], 1: [2.0, 2.0]}
    assert vaccine.merged_gradients(rows.limit(0)).count() == 0
