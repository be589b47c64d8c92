"""Positions and running sums by ranges, against plain Python."""

import pytest

from pyspark.sql import functions as F

from tessella.operators.ranking import with_ranges, with_running


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_positions_and_sums_of_groups(spark, ranges):
    rows = [(k * 7919 % 1009 if k % 50 else None, k, "abc"[k % 3] if k % 11 else None, k % 13) for k in range(600)]
    df = spark.createDataFrame(rows, "a long, b long, g string, w long")
    got = {r["b"]: (r["rank"], r["total"]) for r in with_running(with_running(df, ["a", "b"], ["g"], ranges=ranges), ["a", "b"], ["g"], F.col("w"), "total", ranges).collect()}
    want, places, sums = {}, {}, {}
    for a, b, g, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        places[g], sums[g] = places.get(g, 0) + 1, sums.get(g, 0) + w
        want[b] = (places[g], sums[g])
    assert got == want


def test_ties_strings_and_one_group(spark):
    df = spark.createDataFrame([(w,) for w in "b a c a d b a".split()], "w string")
    got = sorted((r["w"], r["rank"]) for r in with_running(df, ["w"], ranges=3).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 6), ("d", 7)]


def test_empty_table_and_few_rows(spark):
    empty = spark.createDataFrame([], "a long")
    assert with_running(empty, ["a"], ranges=4).collect() == []
    assert [r["rank"] for r in with_running(spark.createDataFrame([(5,)], "a long"), ["a"], ranges=4).collect()] == [1]


def test_ranges_follow_the_order_and_are_even(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("a"))
    found = with_ranges(df.repartition(5), ["a"], 8).groupBy("range").agg(F.min("a").alias("a"), F.max("a").alias("b"), F.count("*").alias("n")).orderBy("range").collect()
    assert len(found) == 8 and max(r["n"] for r in found) < 5000
    assert all(x["b"] < y["a"] for x, y in zip(found, found[1:]))
