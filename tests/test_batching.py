"""Greedy batches by composed transition functions, against the plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import batching, scan


def greedy(lengths, budget):
    batch = held = 0
    out = []
    for n in lengths:
        if held and held + n > budget:
            batch, held = batch + 1, 0
        held += n
        out.append(batch)
    return out


def draw(seed, n):
    rng = random.Random(seed)
    return [rng.choice([0, 0, 1, 2, 5, 9, 10, 11, 30]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_functions_do_what_the_loop_does(seed):
    lengths, budget = draw(seed, 60), 10
    for before in range(0, 50, 7):
        head, tail = lengths[:before], np.array(lengths[before:], np.int64)
        marks, held = greedy(head, budget), 0
        if head:
            held = min(sum(n for n, m in zip(head, marks) if m == marks[-1]), budget + 1)
        batch = marks[-1] if head else 0
        nxt, counts = batching.transition(tail, budget)
        whole = greedy(lengths, budget)
        assert batching.numbered(tail, budget, held, batch).tolist() == whole[before:]
        assert counts[held] == whole[-1] - batch
        assert nxt[held] == min(sum(n for n, m in zip(lengths, whole) if m == whole[-1]), budget + 1)


@pytest.mark.parametrize("stretch,fan", [(4_096, 64), (5, 3), (1, 2)])
def test_batches_of_long_keys(spark, monkeypatch, stretch, fan):
    monkeypatch.setattr(batching, "STRETCH", stretch)
    monkeypatch.setattr(scan, "FAN", fan)
    rows = [(key, k, n) for key, count in (("a", 150), (None, 40), ("c", 1)) for k, n in enumerate(draw(len(key or ""), count))]
    df = spark.createDataFrame(rows, "key string, id long, n int")
    got = {(r["key"], r["id"]): r["batch"] for r in batching.token_budget_batches(df, "key", "n", ["n", "id"], 10).collect()}
    want = {}
    for key in ("a", None, "c"):
        own = sorted((n, i) for k, i, n in rows if k == key)
        want |= {(key, i): b for (_, i), b in zip(own, greedy([n for n, _ in own], 10))}
    assert got == want


def test_drop_last_and_empty(spark):
    df = spark.createDataFrame([("a", k, 4) for k in range(5)], "key string, id long, n int")
    assert sorted(r["id"] for r in batching.token_budget_batches(df, "key", "n", ["id"], 8, drop_last=True).collect()) == [0, 1, 2, 3]
    assert batching.token_budget_batches(df.limit(0), "key", "n", ["id"], 8).collect() == []
    assert batching.mark_buckets(df.limit(0), "key", "n", ["id"], 3).collect() == []


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_buckets(spark, buckets):
    rows = [(key, k, n) for key, count in (("a", 90), ("b", 3), (None, 20)) for k, n in enumerate(draw(count, count))]
    got = {(r["key"], r["id"]): r["bucket"] for r in batching.mark_buckets(spark.createDataFrame(rows, "key string, id long, n int"), "key", "n", ["n", "id"], buckets).collect()}
    want = {}
    for key in ("a", "b", None):
        own = sorted((n, i) for k, i, n in rows if k == key)
        marks = greedy([n for n, _ in own], sum(n for n, _ in own) // buckets + 1)
        want |= {(key, i): min(m, max(marks[-1] - 1, 0)) for (_, i), m in zip(own, marks)}
    assert got == want


@pytest.mark.parametrize("short_last", [False, True])
def test_an_epoch(spark, short_last):
    df = spark.createDataFrame([("a", k, 1 + k * 7 % 13) for k in range(120)], "key string, id long, n int")
    epoch = lambda seed: batching.shuffled_batches(df, "key", "n", "id", 4, 20, seed, short_last)
    rows = epoch(1).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault((r["batch"], r["place"]), []).append(r)
    places = sorted(p for _, p in by_batch)
    assert places == list(range(1, len(by_batch) + 1)) != [p for _, p in sorted(by_batch)]
    assert all(sum(r["n"] for r in b) <= 20 for b in by_batch.values())
    assert 100 <= len(rows) < 120 and len({r["id"] for r in rows}) == len(rows)
    lengths = {}
    for r in rows:
        lengths.setdefault(r["bucket"], []).append(r["n"])
    means = [sum(v) / len(v) for _, v in sorted(lengths.items())]
    assert means == sorted(means, reverse=short_last)
    again, other = epoch(1).collect(), epoch(2).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows)) != sorted(map(tuple, other))


def test_one_large_corpus_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("a").alias("key"), "id", (F.col("id") % 97).alias("n"))
    out = batching.token_budget_batches(df, "key", "n", ["id"], 500)
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString().replace("MapInArrow", "")
    got = np.array(sorted((r["id"], r["batch"]) for r in out.select("id", "batch").collect()))
    assert got[:, 1].tolist() == greedy((np.arange(200_000) % 97).tolist(), 500)
