"""Hard-negative mining over k-means inverted lists.

Every row is stored in the list of its nearest centroid, and a list knows its radius, the largest distance of
a row from the centroid. By the Cauchy-Schwarz inequality an anchor's score with any row of a list lies within
|anchor| * radius of its score with the centroid. An anchor visits lists best bound first, some ranks of its
own order in each wave: it skips lists whose bounds lie outside its windows of wanted scores, and ends when
every unseen list's bound is strictly below its k-th score. So results are exact, whatever the centroids.

Anchors and lists travel packed, and meet by list: each list's rows are scored against many anchors at once. Both sides
of every join grow with the table, so the joins sort and merge: none is broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, map_batches, table

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative scores from LOW to HIGH percent of the positive
SCALE = 256.0
LISTS = 1_024  # at most; half the square root of the number of rows if that is less
SAMPLE = 8_192  # vectors, at most about twice this, that the centroids are fitted on; every row is stored
ROUNDS = 8
FIRST_WAVE, WAVE_GROWTH = 8, 8
ROWS_AT_ONCE = 1_024  # of one list in one packed row
ROWS_IN_TASK = 32_768  # dealt to one task that packs lists
ANCHORS_AT_ONCE = 512
HELD = 500_000  # found rows that a task holds before it keeps only the best of them
SEED = 20_013
_ALL = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, shift: int = 7, labels: int = 10) -> tuple[DataFrame, int]:
    """(vec_id, label, embedding) of the rows that take part, with labels moved by one where ``shift`` divides the id.

    Rows without id, label or vector or with null or non-finite components take no part, nor do vectors of
    another length than the most common one (ties: the shorter), with which they have no inner product.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0
    return rows.where(F.size("embedding") == dim), dim


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as whole numbers: floor(SCALE * x)."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact: in double precision as far as that holds whole numbers, else in Python's."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in anchors], object).reshape(anchors.shape) @ np.array([[int(v) for v in r] for r in rows], object).reshape(rows.shape).T
    return np.clip(exact, _ALL[0] + 1, _ALL[1]).astype(np.int64)  # beyond 64 bits: the largest there is


def centroids(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k-means by Lloyd's rounds from rows drawn at random; a centroid without rows stays where it is."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest word of each row; distances of a few rows at a time are held at once."""
    squares = (words**2).sum(1)
    near = [(squares - 2 * x[at : at + ROWS_AT_ONCE] @ words.T).argmin(1) for at in range(0, len(x), ROWS_AT_ONCE)]
    return np.concatenate(near) if near else np.empty(0, np.int64)


class Lists:
    """Centroids and radii, at most LISTS of them."""

    def __init__(self, words: np.ndarray, radii: np.ndarray):
        self.words, self.radii = words, radii

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score of each anchor with any row of each list, with room for rounding."""
        middle = anchors @ self.words.T
        reach = np.sqrt((anchors**2).sum(1))[:, None] * self.radii
        room = 1 + 1e-9 * (np.abs(middle) + reach)
        return middle - reach - room, middle + reach + room


def build_lists(rows: DataFrame, dim: int) -> tuple[DataFrame, Lists | None]:
    """All rows packed by list (list, n, ids, labels, vectors), as a table, and the lists' bounds."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return rows, None
    share = min(1.0, 1.2 * SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(2 * SAMPLE).select("vec_id", "embedding").collect() or rows.limit(1).select("vec_id", "embedding").collect()
    drawn.sort()
    sample = np.floor(SCALE * np.array([r[1] for r in drawn]).reshape(len(drawn), dim))
    words = spark.sparkContext.broadcast(centroids(sample, max(1, min(LISTS, int(n**0.5 / 2)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sent() -> Iterator[pa.RecordBatch]:
            ids, labels, x, of, far = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((ids, of))
            for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                for at in range(0, len(part), ROWS_AT_ONCE):
                    p = part[at : at + ROWS_AT_ONCE]
                    row = [[int(of[p[0]])], [len(p)], [float(far[p].max())], [ids[p].tobytes()], [labels[p].tobytes()], [x[p].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], ["list", "n", "far", "ids", "labels", "vectors"])

        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            if batch.num_rows:
                x = whole(batch.column(2), dim)
                of = nearest(x, words.value)
                far = np.sqrt(((x - words.value[of]) ** 2).sum(1))
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), x, of, far))
            if sum(len(h[0]) for h in held) >= ROWS_IN_TASK:
                yield from sent()
        if held:
            yield from sent()

    dealt = rows.repartition(-(-n // ROWS_IN_TASK))
    packed = cut(map_batches(dealt, run, "list int, n int, far double, ids binary, labels binary, vectors binary"), "negatives-lists")
    radii = np.full(len(words.value), -np.inf)
    for r in packed.groupBy("list").agg(F.max("far").alias("far")).collect():  # LISTS rows at most
        radii[r["list"]] = r["far"]
    some = radii > -np.inf
    numbers = np.flatnonzero(some)
    renamed = F.element_at(F.create_map(*[F.lit(int(v)) for k in range(len(numbers)) for v in (numbers[k], k)]), F.col("list")).cast("int")
    return packed.select(renamed.alias("list"), "n", "ids", "labels", "vectors"), Lists(words.value[some], radii[some])


_WINDOWS = "array<struct<positive:long,low:long,high:long,kth:long>>"
_ANCHOR = f"anchor_id long, label long, embedding array<double>, windows {_WINDOWS}"


def _asked(state: DataFrame, lists, dim: int, first: int, last: int) -> DataFrame:
    """What each anchor visits at ranks ``first`` to ``last`` of its order, packed by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ANCHORS_AT_ONCE):
                batch = whole_batch.slice(at, ANCHORS_AT_ONCE)
                ids, labels, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), whole(batch.column(2), dim)
                low, high = lists.value.bounds(x)
                order = np.argsort(-high, axis=1, kind="stable")[:, first:last]
                rows = np.arange(len(ids))[:, None]
                low, high = low[rows, order], high[rows, order]
                w = _windows(batch.column(3))
                of = w[:, 0]
                open_ = np.zeros(order.shape, bool)
                wanted = (high[of] >= np.maximum(w[:, 2], w[:, 4])[:, None]) & (low[of] <= w[:, 3][:, None])
                np.logical_or.at(open_, of, wanted)
                anchor, place = np.nonzero(open_)
                number = order[anchor, place]
                by = np.argsort(number, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(number[by])) + 1):
                    if len(part):
                        a = anchor[part]
                        mine = w[np.isin(of, a)].copy()
                        mine[:, 0] = np.searchsorted(a, mine[:, 0])
                        row = [[int(number[part[0]])], [ids[a].tobytes()], [labels[a].tobytes()], [x[a].tobytes()], [mine.tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.int32(), *[pa.binary()] * 4])], ["list", "a_ids", "a_labels", "a_vectors", "windows"])

    return map_batches(state, run, "list int, a_ids binary, a_labels binary, a_vectors binary, windows binary")


def _windows(column: pa.Array) -> np.ndarray:
    """Rows of (place of the anchor, positive, low, high, kth)."""
    parts = column.flatten()
    of = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return np.stack([of, *[parts.field(k).to_numpy(zero_copy_only=False) for k in range(4)]], 1).astype(np.int64)


def best_of(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((vec_id, -score, group))
    sorted_ = group[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else order
    within = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[within < k]


def visit(anchor_ids, anchor_labels, anchors, windows, ids, labels, rows, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(anchor_id, positive, vec_id, score): for each window of each anchor, the k best rows of this part of a list."""
    s = scores(anchors, rows)
    right = (anchor_labels[:, None] == labels) == same
    right &= anchor_ids[:, None] != ids
    out: list[tuple] = []
    for w in np.split(windows, range(ANCHORS_AT_ONCE, len(windows), ANCHORS_AT_ONCE)):
        of = w[:, 0]
        own = s[of]
        fits = right[of] & (own >= np.maximum(w[:, 2], w[:, 4])[:, None]) & (own <= w[:, 3][:, None])
        if fits.shape[1] > k:  # what is below the k-th fitting score goes before the sort; ties stay
            masked = np.where(fits, own, _ALL[0])
            fits &= own >= np.partition(masked, -k, axis=1)[:, -k][:, None]
        g, c = np.nonzero(fits)
        best = best_of(g, own[g, c], ids[c], k)
        g, c = g[best], c[best]
        out.append((anchor_ids[of[g]], w[g, 1], ids[c], own[g, c]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _found(asked: DataFrame, packed: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """What the visits of one wave find: anchor_id, positive, vec_id, score, some more than the k best of each."""
    names = ["anchor_id", "positive", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def best() -> tuple[np.ndarray, ...]:
            anchor, positive, vec_id, score = (np.concatenate(c) for c in zip(*held))
            _, group = np.unique(np.stack([anchor, positive]), axis=1, return_inverse=True)
            kept = best_of(group.ravel(), score, vec_id, k)
            return anchor[kept], positive[kept], vec_id[kept], score[kept]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
                whole_ = [np.frombuffer(b, np.int64) for b in (row[0], row[1], row[4], row[5])]
                a, x = (np.frombuffer(b, np.float64).reshape(-1, dim) if dim else np.empty((len(n), 0)) for b, n in ((row[2], whole_[0]), (row[6], whole_[2])))
                held.append(visit(whole_[0], whole_[1], a, np.frombuffer(row[3], np.int64).reshape(-1, 5), whole_[2], whole_[3], x, k, same))
                count += len(held[-1][0])
                if count > HELD:
                    kept = best()
                    if len(kept[0]) > HELD // 2:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, kept)), names)
                        kept = tuple(c[:0] for c in kept)
                    held, count = [kept], len(kept[0])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, best())), names)

    met = asked.join(packed.hint("merge"), "list").select("a_ids", "a_labels", "a_vectors", "windows", "ids", "labels", "vectors")
    return map_batches(met, run, "anchor_id long, positive long, vec_id long, score long")


def search(anchors: DataFrame, packed: DataFrame, lists: Lists, dim: int, k: int, same: bool) -> DataFrame:
    """anchor_id, positive, vec_id, score and rank: the ``k`` best rows of each window of each anchor, of the
    anchor's label (``same``) or of another. ``anchors`` has the columns of ``_ANCHOR``."""
    held = anchors.sparkSession.sparkContext.broadcast(lists)
    count = len(lists.radii)
    best = F.row_number().over(Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "vec_id"))
    state, found, first, last = anchors, None, 0, FIRST_WAVE
    while first < count:
        new = _found(_asked(state, held, dim, first, last), packed, dim, k, same)
        new = new if found is None else new.unionAll(found.drop("rank"))
        found = cut(new.withColumn("rank", best).where(F.col("rank") <= k), "negatives-found")
        first, last = last, last * WAVE_GROWTH
        if first < count:
            kth = found.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("positive", "score"))).alias("kth"))  # an entry for each window
            told = lambda w: F.coalesce(F.element_at("kth", w["positive"]), w["kth"])
            state = anchors.join(kth.hint("merge"), "anchor_id", "left").select("anchor_id", "label", "embedding", F.transform("windows", lambda w: F.struct(w["positive"], w["low"], w["high"], F.when(F.col("kth").isNull(), w["kth"]).otherwise(told(w)).alias("kth"))).alias("windows"))
    return found


def _window(positive: Column, low: Column, high: Column) -> Column:
    least = F.lit(_ALL[0]).cast("long")
    return F.struct(positive.cast("long").alias("positive"), low.cast("long").alias("low"), high.cast("long").alias("high"), least.alias("kth"))


def mine(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows whose id ``every`` divides: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are the anchor's best rows of its label, negatives the best of other labels that score from ``low`` to
    ``high`` percent of the positive. Rows that ``usable`` leaves out take no part; zero vectors do. Ties go to the
    smaller id. Of rows that repeat an id the anchor is the one of the smallest label and vector; an anchor is no
    candidate of its own id, other rows that repeat are each returned, and positives of one id are one positive, that
    of the highest score. Vectors of any length are whole; other columns are ignored; an empty table, or one without anchors, positives or negatives, gives no rows. Scores beyond 64 bits count as the largest there is.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    packed, lists = build_lists(rows, dim)
    if lists is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chosen = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "embedding")).alias("a"))
    chosen = cut(chosen.select("anchor_id", "a.label", "a.embedding"), "negatives-anchors")
    dealt = chosen.repartition(-(-max(chosen.count(), 1) // ANCHORS_AT_ONCE))
    asked = dealt.withColumn("windows", F.array(_window(F.lit(0), F.lit(_ALL[0]), F.lit(_ALL[1]))))
    found = search(asked, packed, lists, dim, positives, same=True)
    # low * positive <= 100 * negative <= high * positive, for whole numbers
    least = F.expr(f"cast(-floor(cast(-{low} * cast(score as decimal(20,0)) as decimal(30,0)) / 100) as long)")
    most = F.expr(f"cast(floor(cast({high} * cast(score as decimal(20,0)) as decimal(30,0)) / 100) as long)")
    named = found.groupBy("anchor_id", F.col("vec_id").alias("positive")).agg(F.max("score").alias("score"))
    pairs = cut(named.select("anchor_id", "positive", F.col("score").alias("positive_score"), least.alias("low"), most.alias("high")), "negatives-positives")
    windows = pairs.where("low <= high").groupBy("anchor_id").agg(F.collect_list(_window(F.col("positive"), F.col("low"), F.col("high"))).alias("windows"))  # POSITIVES at most
    ranged = cut(chosen.join(windows.hint("merge"), "anchor_id").select("anchor_id", "label", "embedding", "windows"), "negatives-windows")
    hard = search(ranged.repartition(-(-max(ranged.count(), 1) // ANCHORS_AT_ONCE)), packed, lists, dim, negatives, same=False)
    return hard.join(pairs.hint("merge"), ["anchor_id", "positive"]).select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every row of ``embeddings`` whose id 50 divides."""
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM pairs WHERE same) WHERE k <= 5
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS k
  FROM positives p JOIN pairs n USING (anchor_id) WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
) WHERE k <= 3
"""
