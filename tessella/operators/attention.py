"""Attention over long sequences: online softmax, keys streamed past blocks of queries.

Queries and keys travel as tiles of ``block`` positions. The tiles of a sequence are dealt in turn to ``BLOCKS`` blocks of
queries (more, where one would hold over ``MOST`` queries), and each block meets every tile of keys that it may see, in order,
``MERGE`` tiles at a time. A query keeps one state (the largest score, the sum of exponentials below it and the weighted sum of
values), which takes in one partial result after the other. So a key travels to as many blocks as there are, whatever the
length of the sequence, no partial result travels, and no task holds more than a block's queries and ``MERGE`` tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import cut, ship_code

BLOCK, MERGE, BLOCKS = 64, 32, 16
MOST, AT_ONCE = 32_768, 128  # queries of a block; queries that meet keys at once


def partial(q: np.ndarray, q_at: np.ndarray, k: np.ndarray, k_at: np.ndarray, heads: int, bias: Callable[[np.ndarray], np.ndarray], causal: bool) -> tuple[np.ndarray, ...]:
    """Largest score, sum and weighted sum of each query and head over one run of keys; -inf, 0 and zeros if it sees none."""
    n, d = len(q), q.shape[1] // heads
    split = lambda x: x.reshape(len(x), heads, d).transpose(1, 0, 2)
    away = k_at[None, :] - q_at[:, None]
    score = split(q) @ split(k).transpose(0, 2, 1)
    score /= np.sqrt(d)
    score += bias(away)
    if causal and k_at.max() > q_at.min():
        score[:, away > 0] = -np.inf
    top = score.max(2)
    score -= np.where(np.isfinite(top), top, 0.0)[:, :, None]
    weight = np.exp(score, out=score)
    return top.T, weight.sum(2).T, (weight @ split(k)).transpose(1, 0, 2).reshape(n, heads, d)


class _Block:
    """The queries of one block, by position, and what each has of the keys so far."""

    def __init__(self, q: np.ndarray, q_at: np.ndarray, heads: int, bias: Callable[[np.ndarray], np.ndarray], causal: bool):
        self.q, self.q_at, self.heads, self.bias, self.causal = q, q_at, heads, bias, causal
        self.top = np.full((len(q), heads), -np.inf)
        self.sum = np.zeros((len(q), heads))
        self.out = np.zeros((len(q), heads, q.shape[1] // heads))

    def meet(self, k: np.ndarray, k_at: np.ndarray) -> None:
        """Takes in the keys of a run of tiles."""
        first = int(np.searchsorted(self.q_at, k_at.min())) if self.causal else 0
        for a in range(first, len(self.q), AT_ONCE):
            at = slice(a, a + AT_ONCE)
            seen = k_at <= self.q_at[at].max() if self.causal else slice(None)
            top, sum_, out = partial(self.q[at], self.q_at[at], k[seen], k_at[seen], self.heads, self.bias, self.causal)
            both = np.maximum(self.top[at], top)
            base = np.where(np.isfinite(both), both, 0.0)
            old, new = np.exp(self.top[at] - base), np.exp(top - base)
            self.sum[at] = self.sum[at] * old + sum_ * new
            self.out[at] = self.out[at] * old[:, :, None] + out * new[:, :, None]
            self.top[at] = both

    def rows(self) -> tuple[np.ndarray, ...]:
        """Position, head, lse (NaN: none) and out of each query and head."""
        some = self.sum > 0
        sum_ = np.where(some, self.sum, 1.0)
        lse = np.where(some, self.top + np.log(sum_), np.nan)
        return np.repeat(self.q_at, self.heads), np.tile(np.arange(self.heads), len(self.q)), lse.ravel(), (self.out / sum_[:, :, None]).reshape(-1, self.out.shape[2])


def attend(tokens: DataFrame, heads: int, bias: Callable[[np.ndarray], np.ndarray], causal: bool = True, block: int = BLOCK) -> DataFrame:
    """seq, pos, head, lse and out of every token: its attention over the tokens of its sequence.

    ``tokens`` has seq, pos (from 0, gapless), v (the vector, a query, key and value at once, cut into ``heads``) and hidden (not
    to be seen). ``bias`` is added to a score, from the distance of key and query. A token that sees none gets zeros and no lse.
    """
    spark = tokens.sparkSession
    ship_code(spark)
    merge = MERGE
    row = F.struct(F.col("pos").cast("bigint").alias("pos"), "hidden", "v")
    tiles = tokens.groupBy("seq", F.floor(F.col("pos") / block).cast("bigint").alias("tile")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    tiles = cut(tiles.select("seq", "tile", "rows.pos", "rows.hidden", "rows.v"), "attention-tiles")
    count = F.max("tile") + 1
    blocks = F.greatest(F.least(F.lit(BLOCKS), count), F.ceil(count * block / MOST)).cast("bigint")
    ends = cut(tiles.groupBy("seq").agg(blocks.alias("blocks"), count.alias("tiles")), "attention-sequences").withColumnRenamed("seq", "_seq")
    placed = tiles.join(ends, F.col("seq").eqNullSafe(F.col("_seq")))
    one = F.lit(1).cast("bigint")
    # a tile is seen by those blocks that have one as late as it: with causal, of the last ``blocks`` tiles not by all
    reach = F.least(F.col("blocks"), F.col("tiles") - F.col("tile")) if causal else F.col("blocks")
    owner = F.transform(F.sequence(F.lit(0).cast("bigint"), reach - one), lambda j: F.struct(((F.col("tile") + j) % F.col("blocks")).alias("block"), F.lit(1).alias("kind")))
    own = F.array(F.struct((F.col("tile") % F.col("blocks")).alias("block"), F.lit(0).alias("kind")))
    dealt = placed.select("seq", F.inline(F.concat(own, owner)), "tile", "pos", "hidden", "v")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "seq", "block").sortWithinPartitions("seq", "block", "kind", "tile")

    def flat(column: pa.Array, i: int) -> np.ndarray:
        values = column.slice(i, 1).flatten()
        return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if pa.types.is_list(values.type) else values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, queries, keys, waiting = None, None, [], [], 0

        def met() -> None:
            """The keys that wait, hidden ones aside, meet the block."""
            nonlocal held, waiting
            if held is None:
                held = _Block(np.concatenate([v for v, _ in queries]), np.concatenate([p for _, p in queries]), heads, bias, causal)
                queries.clear()
            if keys:
                held.meet(np.concatenate([v for v, _ in keys]), np.concatenate([p for _, p in keys]))
                keys.clear()
            waiting = 0

        def done() -> Iterator[pa.RecordBatch]:
            met()
            pos, head, lse, out = held.rows()
            for a in range(0, len(pos), 4096 * heads):
                part = slice(a, a + 4096 * heads)
                n, wide = len(pos[part]), out.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(0, n * wide + 1, wide, dtype=np.int32), pa.array(out[part].ravel()))
                yield pa.RecordBatch.from_arrays([seq.take(pa.array(np.zeros(n, np.int64))), pa.array(pos[part]), pa.array(head[part]), pa.array(lse[part], from_pandas=True), lists], ["seq", "pos", "head", "lse", "out"])

        for batch in batches:
            of = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                own = (of["seq"][i].as_py(), of["block"][i].as_py())
                if own != at:
                    if at is not None:
                        yield from done()
                    at, held, seq = own, None, of["seq"].slice(i, 1)
                v, pos = flat(of["v"], i), flat(of["pos"], i)
                if not of["kind"][i].as_py():
                    queries.append((v, pos))
                    continue
                shown = ~flat(of["hidden"], i).astype(bool)
                if shown.any():
                    keys.append((v[shown], pos[shown]))
                waiting += 1
                if waiting == merge:
                    met()
        if at is not None:
            yield from done()

    kind = tiles.schema["seq"].dataType.simpleString()
    return dealt.mapInArrow(run, f"seq {kind}, pos bigint, head bigint, lse double, out array<double>")
