"""Length buckets and token-budget batches: greedy recurrences over a whole corpus in order.

A batch closes before the row that would exceed the budget, so what a row does depends on how many tokens the open
batch holds: a state of at most budget + 1 values. Rows are numbered in order and cut into stretches of
``STRETCH``; each stretch becomes a function of that state, ``operators.scan`` finds the state before each of
them, and a second pass numbers the batches. One corpus is as many tasks as it has stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ranking import with_running
from tessella.operators.scan import counting_states
from tessella.runtime import cut, ship_code

STRETCH = 4_096  # rows
_FUNCTION = [T.StructField("seq", T.LongType()), T.StructField("next", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]


def successors(lengths: np.ndarray, budget: int) -> np.ndarray:
    """For a batch that begins at each row, the row before which it closes (the number of rows: it stays open)."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    closes = np.searchsorted(ends, starts + budget, side="right")
    # an empty batch never closes: the first row with tokens goes in, whatever its length
    return np.maximum(closes, np.minimum(np.searchsorted(ends, starts, side="right") + 1, len(lengths)))


def chain_ends(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chain of batches from each row ends, and how many close on the way, by pointer doubling."""
    n = len(after)
    jump, hops = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump, hops
        jump, hops = further, hops + hops[jump]


def transition(lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of tokens that the open batch may hold (budget + 1: too many already), the number
    that it holds after these rows, and how many batches closed."""
    n, ends = len(lengths), np.cumsum(lengths)
    at, hops = chain_ends(successors(lengths, budget))
    held = np.arange(budget + 2)
    first = np.searchsorted(ends, budget - held, side="right")
    first[[0, budget + 1]] = 0
    closed = first < n
    row = np.minimum(first, n - 1)
    total = ends[-1]
    out = np.where(closed, total - (ends - lengths)[at[row]], held + total)
    count = np.where(closed, 1 + hops[row], 0)
    count[0] -= 1  # an empty batch only begins, it does not close
    return np.minimum(out, budget + 1).astype(np.int32), count


def numbered(lengths: np.ndarray, budget: int, held: int, batch: int) -> np.ndarray:
    """The number of each row's batch, if the open one has the number ``batch`` and holds ``held`` tokens."""
    n, ends, after = len(lengths), np.cumsum(lengths), successors(lengths, budget)
    first = 0 if held in (0, budget + 1) else int(np.searchsorted(ends, budget - held, side="right"))
    begins = np.zeros(n, np.int64)
    at = first
    while at < n:
        begins[at] = 1
        at = int(after[at])
    if held == 0 and n:
        begins[0] = 0
    return batch + np.cumsum(begins)


def _lengths(column: pa.Array) -> Iterator[np.ndarray]:
    """Row lengths of each stretch, of an array column of (position, length, row)."""
    flat, offsets = column.flatten().field(1).to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    for a, b in zip(offsets, offsets[1:]):
        yield flat[a - offsets[0] : b - offsets[0]]


def token_budget_batches(rows: DataFrame, key: str, length: str, order: list[str], budget: int, drop_last: bool = False) -> DataFrame:
    """``rows`` with ``batch`` (from 0 within each ``key``), filled greedily in the given order.

    A row over the budget is a batch of its own; rows without tokens never close one. With ``drop_last`` each key's
    open last batch goes, which is what the training loop does. ``order`` names columns, ascending, that tell rows
    apart within a key; lengths are not negative, null counts as 0.
    """
    ship_code(rows.sparkSession)
    placed = with_running(rows, order, [key], name="_pos")
    row = F.struct(F.col("_pos").alias("pos"), F.coalesce(F.col(length).cast("bigint"), F.lit(0)).alias("n"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    stretch = F.floor((F.col("_pos") - 1) / STRETCH).cast("bigint")
    packed = placed.groupBy(F.col(key).alias("_key"), stretch.alias("_seq")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))  # STRETCH rows at most
    packed = cut(packed, "batch-stretches")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [transition(n, budget) for n in _lengths(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["_key", "seq", "next", "counts"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = zip(_lengths(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            found = pa.array([numbered(n, budget, held, closed) for n, held, closed in states], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["_rows", "batches"])

    narrow = packed.select("_key", F.col("_seq").alias("seq"), F.transform("_rows", lambda r: F.struct(r["pos"], r["n"])).alias("lengths"))
    fns = narrow.mapInArrow(functions, T.StructType([packed.schema["_key"], *_FUNCTION])).select("_key", "seq", F.struct("next", "counts").alias("fn"))
    states = counting_states(cut(fns, "batch-functions"), ["_key"]).select(F.col("_key").alias("_k"), "seq", "state.state", "state.count")
    met = packed.join(states, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_seq") == F.col("seq"))).select("_rows", "state", "count")
    out = met.mapInArrow(numbers, T.StructType([packed.schema["_rows"], T.StructField("batches", T.ArrayType(T.LongType()))]))
    out = out.select(F.inline(F.arrays_zip("_rows", "batches"))).select("_rows.row.*", F.col("batches").alias("batch"))
    if drop_last:
        last = out.groupBy(F.col(key).alias("_k")).agg(F.max("batch").alias("_last"))
        out = out.join(last, F.col(key).eqNullSafe(F.col("_k"))).where("batch < _last").drop("_k", "_last")
    return out


def mark_buckets(rows: DataFrame, key: str, length: str, order: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``bucket``: total // buckets + 1 tokens each, closed greedily; the open last one joins the last closed.

    A key has at most 2 * ``buckets`` + 1 buckets, so their first rows are sought one after the other, for all keys at once,
    each by one aggregate over the running sums.
    """
    ended = cut(with_running(rows, order, [key], F.coalesce(F.col(length).cast("bigint"), F.lit(0)), "_end"), "bucket-sums")
    ended = ended.withColumn("_start", F.col("_end") - F.coalesce(F.col(length).cast("bigint"), F.lit(0)))
    own = F.col(key).eqNullSafe(F.col("_k"))
    size = ended.groupBy(F.col(key).alias("_k")).agg((F.floor(F.max("_end") / buckets) + 1).alias("_size"))
    begun = cut(size.select("_k", "_size", F.lit(0).cast("bigint").alias("_from")), "bucket-begins")
    place = F.struct(F.col("_start"), *[F.col(c) for c in order])
    found = None
    while True:
        met = ended.join(begun, own)
        ahead = met.where((F.col("_end") - F.col("_from") > F.col("_size")) & (F.col("_start") > F.col("_from")))
        closed = cut(ahead.groupBy("_k", "_size").agg(F.min(place).alias("_at")), "bucket-begins")
        if closed.isEmpty():
            break
        found = closed if found is None else found.unionAll(closed)
        begun = closed.select("_k", "_size", F.col("_at._start").alias("_from"))
    if found is None:
        return ended.select(*rows.columns, F.lit(0).cast("bigint").alias("bucket"))
    begins = found.groupBy("_k").agg(F.array_sort(F.collect_list("_at")).alias("_begins"))  # 2 * buckets at most
    met = ended.join(begins, own, "left")
    # the begin of the open last bucket does not count: its rows join the last closed one
    counted = F.filter(F.slice("_begins", F.lit(1), F.size("_begins") - 1), lambda b: b <= place)
    return met.select(*rows.columns, F.coalesce(F.when(F.col("_begins").isNotNull(), F.size(counted)), F.lit(0)).cast("bigint").alias("bucket"))


def seeded(seed: int, *columns: str) -> Column:
    """A hash that orders rows anew for every seed, the same on every machine."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def shuffled_batches(rows: DataFrame, key: str, length: str, identity: str, buckets: int, budget: int, seed: int, short_last: bool = False, drop_last: bool = True) -> DataFrame:
    """``rows`` with ``batch`` and ``place`` (the batch's place in the epoch, from 1 in each key), for one epoch's seed.

    Rows are sorted by length (longest first with ``short_last``; ties by ``identity``) and cut into buckets; each bucket is
    shuffled; batches are filled in that order; at last the batches are shuffled. ``identity`` tells rows apart.
    """
    columns = rows.columns
    sorted_ = rows.withColumn("_by", -F.col(length) if short_last else F.col(length))
    marked = mark_buckets(sorted_, key, length, ["_by", identity], buckets).withColumn("_hash", seeded(seed, identity))
    filled = cut(token_budget_batches(marked, key, length, ["bucket", "_hash", identity], budget, drop_last), "shuffled-batches")
    each = filled.select(F.col(key).alias("_k"), F.col("batch").alias("_b")).distinct().withColumn("_h", seeded(seed, "_k", "_b"))
    places = with_running(each, ["_h", "_b"], ["_k"], name="place")
    met = filled.join(places, F.col(key).eqNullSafe(F.col("_k")) & (F.col("batch") == F.col("_b")))
    return met.select(*columns, "bucket", "batch", "place")
