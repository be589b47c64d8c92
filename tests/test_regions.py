"""Points and regions by a sweep, against all pairs."""

import random

import pytest

from tessella.operators import regions


def brute(points, boxes):
    out = {}
    for i, page, x, y in points:
        kinds = []
        for p, region, left, right, top, bottom in boxes:
            if p == page:
                kind = 0 if left <= x <= right and top <= y <= bottom else 1 if left <= x and top <= y else 2 if left <= x else 3 if top <= y else 4
                kinds.append((kind, -region))
        out[i] = (min(kinds)[0], -min(kinds)[1]) if kinds else (-1, -1)
    return out


def draw(seed, n_points, n_regions, size):
    rng = random.Random(seed)
    place = lambda: rng.choice([rng.randint(-20, 300), rng.randint(0, 30) * 10, rng.uniform(0, 300)])
    points = [(k, rng.choice([0, 0, 0, 1, 7]), float(place()), float(place())) for k in range(n_points)]
    boxes = []
    for r in range(n_regions):
        left, top = float(place()), float(place())
        boxes.append((rng.randint(0, 1), r, left, left + rng.randint(-2, size), top, top + rng.randint(-2, size)))
    return points, boxes


@pytest.mark.parametrize("seed,size", [(1, 40), (2, 250), (3, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, size):
    monkeypatch.setattr(regions, "POINTS_AT_ONCE", 30)
    points, boxes = draw(seed, 400, 60, size)
    p = spark.createDataFrame(points, "id long, page long, x double, y double")
    r = spark.createDataFrame(boxes, "page long, region long, left double, right double, top double, bottom double")
    got = {x["id"]: (x["kind"], x["region"]) for x in regions.locate(p, r).collect()}
    assert got == brute(points, boxes)


@pytest.mark.parametrize("seed", range(5))
def test_one_stripe(seed):
    points, boxes = draw(seed, 300, 80, 90)
    points, boxes = [p for p in points if p[1] == 0], [b for b in boxes if b[0] == 0]
    page = [(b[4], b[1]) for b in boxes]
    got = regions.sweep([p[2:] for p in points], [(*b[2:6], b[1]) for b in boxes], [], page)
    assert dict(zip([p[0] for p in points], got)) == brute(points, boxes)


def test_no_regions_and_no_points(spark):
    p = spark.createDataFrame([(1, 1, 2.0, 3.0)], "id long, page long, x double, y double")
    r = spark.createDataFrame([], "page long, region long, left double, right double, top double, bottom double")
    assert [(x["kind"], x["region"]) for x in regions.locate(p, r).collect()] == [(-1, -1)]
    assert regions.locate(p.limit(0), r).collect() == []
