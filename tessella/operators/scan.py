"""Scans over recurrences: what a long ordered stream does to a small state, found in parallel.

A stretch of the stream is a function: for each state before it, the state after it. Functions compose. So stretches
are worked out apart, composed ``FAN`` at a time level by level, and the states before all stretches come back down
the same levels: no task ever holds more than ``FAN`` functions, however long the stream is.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.runtime import cut, ship_code

FAN = 64


def starting_states(functions: DataFrame, key: list[str], first: Column, composed: Callable[[DataFrame], DataFrame], walked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, seq and state before each stretch of each key's stream, which begins in the state ``first``.

    ``functions`` holds the key, ``seq`` (bigint from 0, gapless) and ``fn`` of every stretch. ``composed`` replaces the
    array ``fns`` of (seq, fn), in order, by the one ``fn`` that does what they do in turn; ``walked`` replaces ``fns`` and
    ``begin`` by ``states``, an array of (seq, state) before each of them. Keys may be null.
    """
    last = functions.agg(F.max("seq")).first()[0]
    fns = F.array_sort(F.collect_list(F.struct("seq", "fn")), lambda a, b: (a["seq"] - b["seq"]).cast("int")).alias("fns")
    grouped = functions.groupBy(*key, F.floor(F.col("seq") / FAN).cast("bigint").alias("_up")).agg(fns)
    if last is not None and last >= FAN:
        grouped = cut(grouped, "scan-groups")
        whole = cut(composed(grouped).select(*key, F.col("_up").alias("seq"), "fn"), "scan-functions")
        above = starting_states(whole, key, first, composed, walked)
        above = above.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*key, "seq"])], F.col("state").alias("begin"))
        grouped = grouped.join(above, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*key, "_up"])]).select(*key, "_up", "fns", "begin")
    else:
        grouped = grouped.withColumn("begin", first)
    return cut(walked(grouped).select(*key, F.inline("states")), "scan-states")


def counting_states(functions: DataFrame, key: list[str]) -> DataFrame:
    """``starting_states`` of functions over states 0 to n that also count: ``fn`` is (next: the state after, for each
    state before; counts: what it adds), the state (state, count), and streams begin in (0, 0)."""

    def after(state: Column, fn: Column) -> Column:
        at = state["state"] + 1
        return F.struct(F.element_at(fn["next"], at).alias("state"), (state["count"] + F.element_at(fn["counts"], at)).alias("count"))

    def composed(grouped: DataFrame) -> DataFrame:
        f = F.col("fns")[0]["fn"]
        begin = F.zip_with(f["next"], f["counts"], lambda s, c: F.struct(s.alias("state"), c.alias("count")))
        whole = F.aggregate(F.slice("fns", 2, F.size("fns")), begin, lambda acc, x: F.transform(acc, lambda s: after(s, x["fn"])))
        split = F.struct(F.transform("whole", lambda s: s["state"]).alias("next"), F.transform("whole", lambda s: s["count"]).alias("counts"))
        return grouped.withColumn("whole", whole).withColumn("fn", split)

    def walked(grouped: DataFrame) -> DataFrame:
        empty = F.struct(F.col("begin").alias("now"), F.expr("cast(array() as array<struct<seq:bigint,state:struct<state:int,count:bigint>>>)").alias("out"))
        step = lambda acc, x: F.struct(after(acc["now"], x["fn"]).alias("now"), F.array_append(acc["out"], F.struct(x["seq"].alias("seq"), acc["now"].alias("state"))).alias("out"))
        return grouped.withColumn("states", F.aggregate("fns", empty, step, lambda acc: acc["out"]))

    return starting_states(functions, key, F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("count")), composed, walked)


def pickled_states(functions: DataFrame, key: list[str], first: object, compose: Callable, apply: Callable) -> DataFrame:
    """``starting_states`` of functions and states that only Python knows, pickled: ``compose`` takes two functions, the
    earlier one first, ``apply`` a function and a state."""
    ship_code(functions.sparkSession)

    def composed(grouped: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for fns in (x.as_py() for x in batch.column("fns")):
                    whole = pickle.loads(fns[0]["fn"])
                    for x in fns[1:]:
                        whole = compose(whole, pickle.loads(x["fn"]))
                    out.append(pickle.dumps(whole))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*key, "_up"]), pa.array(out, pa.binary())], [*key, "_up", "fn"])

        return grouped.mapInArrow(run, T.StructType([*(grouped.schema[c] for c in [*key, "_up"]), T.StructField("fn", T.BinaryType())]))

    def walked(grouped: DataFrame) -> DataFrame:
        kind = T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("state", T.BinaryType())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for fns, begin in ((x.as_py(), y.as_py()) for x, y in zip(batch.column("fns"), batch.column("begin"))):
                    state, rows = pickle.loads(begin), []
                    for x in fns:
                        rows.append({"seq": x["seq"], "state": pickle.dumps(state)})
                        state = apply(pickle.loads(x["fn"]), state)
                    out.append(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(out, pa.list_(pa.struct([("seq", pa.int64()), ("state", pa.binary())])))], [*key, "states"])

        return grouped.mapInArrow(run, T.StructType([*(grouped.schema[c] for c in key), T.StructField("states", kind)]))

    return starting_states(functions, key, F.lit(pickle.dumps(first)), composed, walked)
