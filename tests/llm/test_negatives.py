import math
import random

import numpy as np
import pytest

from tessella.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, list int, n int"


def brute(rows, every=50, positives=5, count=3):
    kept = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    if not kept:
        return []
    sizes = [len(r[2]) for r in kept]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), -d))
    kept = [r for r in kept if len(r[2]) == dim]
    anchors = {}
    for r in kept:
        if r[0] % every == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r)
    out = []
    for i, label, v in anchors.values():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i))
        best = {}
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            best[j] = max(best.get(j, -s), -s)
        for j, s in best.items():
            hard = [(t, -u) for u, t, other in scored if other != label and 50 * s <= -100 * u <= 95 * s][:count]
            out += [(i, j, k, t, s, u) for k, (t, u) in enumerate(hard, 1)]
    return sorted(out)


def check(spark, rows, **named):
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **named)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows, named.get("every", 50))
    return got


def table(seed, n=400, dim=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(k, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(10), 0, 0) for k in range(n)]
    rows += [(1000, None, 1, 0, 0), (1050, [1.0] * dim, None, 0, 0), (None, [1.0] * dim, 1, 0, 0), (1100, [float("nan")] + [1.0] * (dim - 1), 1, 0, 0)]
    rows += [(1150, [float("inf")] + [1.0] * (dim - 1), 1, 0, 0), (1200, [None] + [1.0] * (dim - 1), 1, 0, 0), (1250, [1.0], 1, 0, 0), (1300, [0.0] * dim, 3, 0, 0), (1350, [], 3, 0, 0)]
    return rows


def test_equals_brute_force(spark):
    assert len(check(spark, table(1), every=5)) > 300


@pytest.mark.parametrize("lists,first", [(1, 8), (400, 1), (30, 2)])
def test_lists_and_waves_change_nothing(spark, monkeypatch, lists, first):
    monkeypatch.setattr(negatives, "LISTS", lists)
    monkeypatch.setattr(negatives, "FIRST_WAVE", first)
    monkeypatch.setattr(negatives, "WAVE_GROWTH", 3)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 11)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 7)
    monkeypatch.setattr(negatives, "HELD", 40)
    check(spark, table(2), every=5)


def test_ties_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(k, [float(rng.randint(-1, 1)) for _ in range(4)], k % 3, 0, 0) for k in range(300)]
    rows += [(k, [1.0, 1.0, 0.0, 0.0], k % 2, 0, 0) for k in range(300, 420)] + rows[:60]
    check(spark, rows, every=10)


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[3.0e8, 1.0, -2.0]]), np.array([[3.0e8, 5.0, 7.0], [2.0e8, 0.0, 1.0]])
    assert negatives.scores(a, b).tolist() == [[9 * 10**16 + 5 - 14, 6 * 10**16 - 2]]
    assert negatives.scores(np.array([[1e200]]), np.array([[1e200], [-1e200]])).tolist() == [[2**63 - 1, -(2**63) + 1]]


def test_far_lists_are_not_visited():
    lists = negatives.Lists(np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]]), np.array([5.0, 5.0, 5.0]))
    low, high = lists.bounds(np.array([[10.0, 0.0]]))
    assert (low[0, 0] > 900, high[0, 2] < -900, high[0, 1] < 100) == (True, True, True)


@pytest.mark.parametrize("rows", [[], [(3, [1.0, 2.0], 1, 0, 0)], [(50, [1.0, 2.0], 1, 0, 0)], [(50, [], 1, 0, 0), (51, [], 1, 0, 0), (52, [], 2, 0, 0)]])
def test_nothing_to_find(spark, rows):
    check(spark, rows)


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans, cut = [], negatives.cut

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(negatives, "cut", seen)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), [float(v) for v in rng.normal(size=4)]) for i in range(2_000)]
    found = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
