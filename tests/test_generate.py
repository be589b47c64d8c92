"""The number generator by its rules, and by rows worked by hand."""

from collections import Counter

import pytest

from tessella.functions import generate

P = 2**31 - 1


def drawn(row, factor, which):
    """The congruence three times, from row + 1, with 7919 which + 11 and then 97 added between."""
    x = (row + 1) * factor % P
    x = (x + 7919 * which + 11) * factor % P
    return (x + 97) * factor % P


def chosen(u, values, shares):
    """By exact hundred-thousandths of the range."""
    upto = 0
    for v, s in zip(values, shares):
        upto += s
        if u * 100_000 < upto * P:
            return v
    return values[-1]


def by_the_rules(row):
    most = chosen(drawn(row, 48271, 0), [10**3 - 1, 10**6 - 1, 10**9 - 1, 10**12 - 1, 10**15 - 1], [50_000, 28_125, 12_500, 6_250, 3_125])
    n = 1 + (drawn(row, 69621, 1) * 1_000_003 + drawn(row, 39373, 2)) % most
    many = ["a", "ka", "ba", "i", "bi", "tu", "ha", "zi"]
    one = [*many, "ru", "ku"]
    u = drawn(row, 16807, 3)
    prefix = chosen(u, one, [30_000, 30_000, *[5_000] * 8]) if n % 10 == 1 else chosen(u, many, [40_000, 30_000, *[5_000] * 6])
    return n, prefix, chosen(drawn(row + 5, 39373, 2), ["grouped", "plain", "spelt"], [10_000, 10_000, 80_000])


def test_rows_follow_the_rules(spark):
    got = generate.numeric_pairs(spark.range(2_000).withColumnRenamed("id", "row")).collect()
    assert {r["row"]: (r["n"], r["prefix"], r["format"]) for r in got} == {k: by_the_rules(k) for k in range(2_000)}
    for r in got:
        if r["format"] == "grouped":
            assert r["rw"] == f"{r['n']:,}"
        if r["format"] == "plain":
            assert r["rw"] == str(r["n"])


def test_as_many_as_the_reference_makes_keep_the_shares(spark):
    got = generate.numeric_pairs(spark.range(200_000).withColumnRenamed("id", "row")).collect()
    assert sorted(r["row"] for r in got) == list(range(200_000))
    formats = Counter(r["format"] for r in got)
    assert [formats[f] / 200_000 for f in ("grouped", "plain", "spelt")] == pytest.approx([0.1, 0.1, 0.8], abs=0.01)
    assert sum(r["n"] <= 999 for r in got) / 200_000 == pytest.approx(0.5, abs=0.01)
    assert {r["prefix"] for r in got if r["n"] % 10 != 1} == {"a", "ka", "ba", "i", "bi", "tu", "ha", "zi"}
    assert {r["prefix"] for r in got if r["n"] % 10 == 1} >= {"ru", "ku"}
