"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of several full-dimensional codebooks. Codebooks
start as residual k-means and are refined by turns of beam-search encoding and least squares; every
row is encoded by beam search and stored with its codes and norms. Queries come in blocks of bounded
size: each block's lookup tables score all codes, and the best of every chunk of rows are reranked
exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, map_batches, table

CODEBOOKS, WORDS, BEAM = 16, 256, 4
SAMPLE = 8_192  # vectors, at most about twice this, that the codebooks are fitted on; every row is indexed
ROUNDS = 3
QUERY_BLOCK = 4_096  # queries sent out at once
RERANK = 160  # of each chunk of CHUNK rows and each query
CHUNK = 8_192
SEED = 20_011


@dataclass
class Codebooks:
    words: np.ndarray  # codebooks x words x dimensions, float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (uint8) of each row, by beam search over the codebooks in turn."""
        m, k, _ = self.words.shape
        out = np.empty((len(x), m), np.uint8)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024].astype(np.float32)
            rest, error = part[:, None, :], np.zeros((len(part), 1), np.float32)
            codes = np.zeros((len(part), 1, 0), np.uint8)
            for words in self.words:
                # |r - c|^2 less |r|^2, for every beam and codeword
                gain = error[:, :, None] - 2 * rest @ words.T + (words**2).sum(1)
                b = gain.shape[1]
                flat = gain.reshape(len(part), b * k)
                keep = min(beam, flat.shape[1])
                top = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.argsort(flat, axis=1)
                rows = np.arange(len(part))[:, None]
                error, origin, word = flat[rows, top], top // k, top % k
                rest = rest[rows, origin] - words[word]
                codes = np.concatenate([codes[rows, origin], word[:, :, None].astype(np.uint8)], 2)
            out[a : a + 1024] = codes[np.arange(len(part)), error.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(codes.shape[1]))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword: codebooks x queries x words."""
        return np.einsum("mkd,qd->mqk", self.words, queries.astype(np.float32), optimize=True)


def fit(x: np.ndarray, m: int = CODEBOOKS, k: int = WORDS, rounds: int = ROUNDS, seed: int = SEED) -> Codebooks:
    """Residual k-means, then rounds of beam-search encoding and least squares over all codebooks at once."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, books = x.copy(), []
    for _ in range(m):
        words = rest[rng.choice(len(rest), k, replace=len(rest) < k)].copy()
        for _ in range(6):
            near = ((words**2).sum(1) - 2 * rest @ words.T).argmin(1)
            n = np.bincount(near, minlength=k)
            total = _grouped(near, rest, k)
            words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), k)])
        books.append(words.astype(np.float32))
        rest = rest - books[-1][((books[-1] ** 2).sum(1) - 2 * rest @ books[-1].T).argmin(1)]
    found = Codebooks(np.stack(books))
    for _ in range(rounds):
        codes = found.encode(x).astype(np.int64) + np.arange(m) * k
        normal = np.zeros((m * k, m * k), np.float32)
        right = np.zeros((m * k, x.shape[1]), np.float32)
        for a in range(m):
            right += _grouped(codes[:, a], x, m * k)
            np.add.at(normal.reshape(-1), (codes[:, a, None] * (m * k) + codes).ravel(), np.float32(1))
        # drawn towards the present words, so that rarely used ones stay defined
        normal[np.diag_indices(m * k)] += 0.1
        found = Codebooks(np.linalg.solve(normal, right + 0.1 * found.words.reshape(m * k, -1)).reshape(m, k, -1).astype(np.float32))
    return found


def _grouped(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each group."""
    return np.stack([np.bincount(group, column, n) for column in x.T], 1).astype(np.float32)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their dimension.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do
    vectors of another length than the most common one (ties: the shorter). Rows without an id do not
    either.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0
    return rows.where(F.size("embedding") == dim), dim


def build_index(rows: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """Every row with its codes, the norm of what they stand for and its own norm, as a table."""
    n = rows.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * SAMPLE).select("embedding").collect()
    schema = "vec_id long, embedding array<double>, codes binary, coded_norm float, norm double"
    if not drawn:
        return rows.select("vec_id", "embedding", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("coded_norm"), F.lit(None).cast("double").alias("norm")), None
    drawn.sort()
    books = fit(np.array([r[0] for r in drawn]))
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                codes = held.value.encode(x)
                near = np.linalg.norm(held.value.decode(codes), axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(near), pa.array(np.linalg.norm(x, axis=1))],
                    ["vec_id", "embedding", "codes", "coded_norm", "norm"],
                )

    return cut(map_batches(rows, run, schema), "additive-codes"), books


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(np.broadcast_shapes(queries.shape[:-1], x.shape[:-1]))
    for d in range(queries.shape[-1]):
        out += queries[..., d] * x[..., d]
    return out


class Searcher:
    """The best so far of one block of queries, as chunks of encoded rows come in."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, books: Codebooks, k: int, rerank: int):
        self.ids, self.queries, self.k, self.rerank = ids, queries, k, rerank
        self.tables = books.tables(queries)
        self.best = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, vec_id: np.ndarray, x: np.ndarray, codes: np.ndarray, ratio: np.ndarray) -> None:
        # copies of a vector are scored once and stand for the smallest of their ids
        order = np.argsort(vec_id, kind="stable")
        vec_id, x, codes, ratio = vec_id[order], x[order], codes[order], ratio[order]
        view = np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel()
        _, first, group = np.unique(view, return_index=True, return_inverse=True)
        n = np.bincount(group)
        width = int(min(n.max(), self.k + 1))
        by_group = np.argsort(group, kind="stable")
        within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        members = np.full((len(n), width), -1, np.int64)
        some = within < width
        members[group[by_group][some], within[some]] = vec_id[by_group][some]
        x, codes, ratio = x[first], codes[first], ratio[first]
        for a in range(0, len(self.ids), 256):
            self._block(slice(a, a + 256), members, x, codes, ratio)

    def _block(self, part: slice, members: np.ndarray, x: np.ndarray, codes: np.ndarray, ratio: np.ndarray) -> None:
        table = self.tables[:, part]
        near = table[0][:, codes[:, 0]]
        for m in range(1, codes.shape[1]):
            near += table[m][:, codes[:, m]]
        near *= ratio  # the coded vector, stretched to the stored norm
        r = min(self.rerank, len(x))
        top = np.argpartition(-near, r - 1, axis=1)[:, :r] if r < len(x) else np.broadcast_to(np.arange(r), (len(near), r))
        score = exact(self.queries[part][:, None, :], x[top])
        ids = members[top]
        score = np.broadcast_to(score[:, :, None], ids.shape).copy()
        score[(ids == -1) | (ids == self.ids[part][:, None, None])] = -np.inf
        score = np.concatenate([self.best[part], score.reshape(len(score), -1)], 1)
        ids = np.concatenate([self.found[part], ids.reshape(len(score), -1)], 1)
        pick = np.lexsort((ids, -score), axis=1)[:, : self.k]
        rows = np.arange(len(score))[:, None]
        self.best[part], self.found[part] = score[rows, pick], ids[rows, pick]

    def result(self) -> pa.RecordBatch:
        q, c = np.nonzero(self.best > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, c]), pa.array(self.best[q, c])], ["query_id", "vec_id", "score"])


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, rerank: int = RERANK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest by inner product.

    A query's own id is left out; ties go to the smaller id; rows that repeat are each returned. Each
    block of queries is one pass over the codes, so memory is bounded by the block and chunk sizes and
    the driver holds one block at a time. An empty index or query set gives no rows.
    """
    spark = index.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = -(-queries.count() // query_block)
    found = []
    for b in range(blocks if books is not None else 0):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        rows.sort()
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), books))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, vectors, own = held.value
            searcher, full = None, False
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    c = batch.slice(at, CHUNK)
                    searcher = searcher or Searcher(ids, vectors, own, k, rerank)
                    codes = np.frombuffer(b"".join(c.column(2).to_pylist()), np.uint8).reshape(c.num_rows, -1)
                    coded, norm = c.column(3).to_numpy(), c.column(4).to_numpy()
                    ratio = np.where(coded > 0, norm / np.maximum(coded, 1e-30), 1).astype(np.float32)
                    searcher.add(c.column(0).to_numpy(), _matrix(c.column(1)), codes, ratio)
                    full = True
            if full:
                yield searcher.result()

        part = map_batches(index, run, "query_id long, vec_id long, score double")
        found.append(cut(part, "neighbours-block") if blocks > 1 else part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found[0]
    for part in found[1:]:
        best = best.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20, over the whole table."""
    rows, _ = usable(table(spark, sf_dir, "embeddings"))
    index, books = build_index(rows)
    return search(index, books, rows.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
