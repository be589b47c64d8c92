"""Absorbed runs against a plain loop."""

import random

import pytest

from tessella.operators.absorption import absorb

SCHEMA = "id long, page long, col long, y double, h double"


def brute(runs):
    taker = {}
    for i, page, col, y, h in runs:
        near = []
        for j, p, c, y_a, h_a in runs:
            gap = y_a - (y + h) if y < y_a else y - (y_a + h_a)
            if (p, c) == (page, col) and 0.8 * h_a > h and gap < 0.6 * h:
                near.append((gap, -h_a, j))
        if near:
            taker[i] = min(near)[2]
    out = {}
    for i, *_ in runs:
        owner, steps = i, 0
        while owner in taker:
            owner, steps = taker[owner], steps + 1
        out[i] = (owner, steps)
    return out


def solve(spark, runs):
    return {r["id"]: (r["owner"], r["steps"]) for r in absorb(spark.createDataFrame(runs, SCHEMA)).collect()}


def test_a_chain_of_four(spark):
    runs = [(1, 1, 1, 100.0, 20.0), (2, 1, 1, 121.0, 12.0), (3, 1, 1, 134.0, 8.0), (4, 1, 1, 143.0, 5.0), (5, 1, 2, 121.0, 12.0), (6, 1, 1, 200.0, 5.0)]
    assert solve(spark, runs) == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (6, 0)} == brute(runs)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    runs = [(k, rng.randint(0, 2), rng.randint(0, 1), float(rng.randint(-40, 400)), rng.choice([3.0, 5.0, 8.0, 11.0, 16.0, 90.0])) for k in range(300)]
    want = brute(runs)
    assert max(s for _, s in want.values()) >= 2
    assert solve(spark, runs) == want


def test_no_runs(spark):
    assert absorb(spark.createDataFrame([], SCHEMA)).collect() == []
