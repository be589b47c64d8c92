"""Column separators against a plain loop over pages, and hand-made pages for each kind of evidence."""

import math
import random

import pytest

from tessella.operators import columns
from tessella.operators.columns import Cell


def plain_cells(intervals, size):
    first, last = math.floor(min(a for a, _ in intervals) / size), math.floor(max(b for _, b in intervals) / size) - 1
    n = [sum(a <= (k + 0.5) * size <= b for a, b in intervals) for k in range(first, last + 1)]
    at = lambda i: n[i] if 0 <= i < len(n) else None
    step = lambda i, j: 0 if at(j) is None else abs(n[i] - n[j])
    return [Cell(first + i, (first + i) * size, (first + i + 1) * size, n[i], sum(n[:i]), sum(n[i + 1 :]), step(i, i - 1), step(i, i + 1)) for i in range(len(n))]


def plain_borders(cells, k):
    mean = lambda v: sum(v) / len(v)
    sd = lambda v: math.sqrt(max(mean([x * x for x in v]) - mean(v) ** 2, 0))
    n = [c.n for c in cells]
    low, wide = mean(n) - sd(n), cells[-1].end_x - cells[0].x
    thin = lambda c: (c.n < low and c.n < 5) or c.n == 0 or (low < 2 and c.n < 4)
    side = {}
    for s, sigmas in (("left", 1.0), ("right", 1.5)):
        v = [getattr(c, f"{s}_step") for c in cells]
        side[s] = (lambda c, s=s, t=mean(v) + sigmas * sd(v): getattr(c, f"{s}_step") >= t, lambda c, s=s: getattr(c, f"{s}_n") >= (c.left_n + c.right_n) / (16 * (k + 1)))
    good = lambda c: thin(c) and (side["left"][0](c) or side["right"][0](c)) and side["left"][1](c) and side["right"][1](c)
    out = {}
    for s in ("left", "right"):
        ranked = sorted(cells, key=lambda c: (not (thin(c) and side[s][0](c) and side[s][1](c)), -getattr(c, f"{s}_step") / (c.n + 0.1), c.cell))[: 4 * k]
        taken = []
        for c in filter(good, ranked):
            if taken and (abs(taken[-1].middle - c.middle) < wide / (4 * (k + 1)) or c.n - taken[-1].n > sd(n)):
                break
            taken.append(c)
        out[s] = (taken, ranked)
    return out["left"][0], out["right"][0], out["right"][1]


def page(seed):
    rng = random.Random(seed)
    kind, out = seed % 4, []
    for col in range(3):
        for _ in range(rng.randint(10, 60)):
            a = col * 200 + rng.randint(0, 12 if kind == 1 else 40)
            out.append((float(a), float(a + rng.randint(20, 150 if kind != 2 else 190))))
    if kind == 3:
        out += [(float(a), float(a + 260)) for a in (rng.randint(0, 300) for _ in range(rng.randint(1, 6)))]
    return out


def test_pages_equal_the_plain_version(spark):
    pages = {p: page(p) for p in range(40)} | {99: [(5.0, 6.0)], 98: [(0.0, 100.0)]}
    rows = [(p, a, b) for p, intervals in pages.items() for a, b in intervals]
    got, want = {}, {}
    for r in columns.separators(spark.createDataFrame(rows, "page long, a double, b double"), "page", "a", "b", 4, 2).collect():
        got.setdefault(r["page"], []).append((r["x"], r["evidence"]))
    for p, intervals in pages.items():
        cells = plain_cells(intervals, 4)
        if cells:
            want[p] = columns.choose(cells, *plain_borders(cells, 2), 2)
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in want.items() if v}
    assert len({e for v in want.values() for _, e in v}) >= 3


def test_gutters_of_full_pages_are_found():
    for seed in range(8):
        rng = random.Random(seed)
        full = [(float(col * 200 + rng.choice([0, 0, 0, 1, 6])), float(col * 200 + rng.choice([170, 171, 172, 168, 90]))) for col in range(3) for _ in range(50)]
        cells = plain_cells(full, 4)
        assert [round(x) for x, _ in columns.choose(cells, *plain_borders(cells, 2), 2)] == [174, 374]


def cells_of(counts):
    total = sum(counts)
    step = lambda i, j: abs(counts[i] - counts[j]) if 0 <= j < len(counts) else 0
    return [Cell(i, 10.0 * i, 10.0 * (i + 1), n, sum(counts[:i]), total - sum(counts[: i + 1]), step(i, i - 1), step(i, i + 1)) for i, n in enumerate(counts)]


COUNTS = [20] * 9 + [1, 2] + [20] * 9 + [0] + [20] * 9


@pytest.mark.parametrize(
    ("lefts", "rights", "ranked", "want"),
    [
        ([9], [10], [], [(100.0, "pair")]),  # neither is empty: the middle of both
        ([9, 20], [10, 20], [], [(100.0, "pair"), (205.0, "both")]),
        ([], [20], [], [(205.0, "empty")]),
        ([20], [], [], [(205.0, "empty")]),
        ([], [10], [], [(100.0, "thin right")]),
        ([9], [], [], [(100.0, "thin left")]),
        ([], [8], [], []),  # 20 glyphs and a step of 19: not twice as steep
        ([], [], [10], [(100.0, "any")]),
        ([], [], [0], []),
        ([], [], [], []),
    ],
)
def test_each_kind_of_evidence(lefts, rights, ranked, want):
    cells = cells_of(COUNTS)
    of = lambda places: [cells[k] for k in places]
    assert columns.choose(cells, of(lefts), of(rights), of(ranked), 2) == want


def test_steep_right_border_and_mass():
    cells = cells_of([2] * 10 + [5, 16] + [2] * 10)
    assert columns.choose(cells, [], [cells[10]], [], 2) == [(100.0, "steep")]
    cells = cells_of(COUNTS)
    assert columns.mass_between(cells, 2, 100.0, 205.0) == pytest.approx((2 + 9 * 20) / (543 / 3), abs=0.02)
