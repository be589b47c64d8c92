"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints that link differ in at most ``MOST`` of 64 bits, so of ``MOST`` + 1 stretches of bits they agree in one.
Distinct fingerprints go to a bucket for each stretch, and each bucket is searched on its own: its fingerprints are
sorted by Gray rank, so that neighbours differ little, and the bits that all of a group share are factored out into
a node above it, level by level. A search adds up differences on the way down and leaves a node, with all that
is below it, as soon as there are more than ``MOST``. A bucket too large for one task is cut into pieces, each
pair of which is searched in a task of its own. Of the links found, every task returns as many as its classes need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_chars, cut, map_batches, ship_code, table
from tessella.llm.jaccard import components

SHINGLE = 4
MOST = 4  # differing bits of a link
SEED = 42
BITS = 64
BUCKET = 512  # fingerprints that a bucket should hold on average
CELL = 4_096  # fingerprints of one piece of a bucket
FAN = 16  # children of a node
QUERIES_AT_ONCE = 512
CHARS_AT_ONCE = 4_000_000
SHINGLES_AT_ONCE = 65_536

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits that more than half of the shingles' XXH64 hashes have; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts, k = ends - length, min(size, len(words))
    n, hashed = len(words) - k + 1, xxhash.xxh64_intdigest
    set_ = np.zeros(BITS, np.int64)
    for a in range(0, n, SHINGLES_AT_ONCE):
        b = min(a + SHINGLES_AT_ONCE, n)
        found = [hashed(joined[x:y], SEED) for x, y in zip(starts[a:b].tolist(), ends[a + k - 1 : b + k - 1].tolist())]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * set_ > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chars(batches, 1, CHARS_AT_ONCE):
            found = np.array([fingerprint(t.encode()) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(read, run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order. A node holds the bits that all below it share and that no
    node above it holds (``masks``), and what they are (``patterns``); on the lowest level, the rest of each fingerprint."""

    def __init__(self, prints: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(prints), kind="stable")
        self.fan = fan
        patterns, masks = [prints[self.order]], [np.full(len(prints), ~np.uint64(0))]
        while len(patterns[-1]) > fan:
            below, shared = patterns[-1], masks[-1]
            starts = np.arange(0, len(below), fan)
            first = below[starts]
            differ = np.bitwise_or.reduceat(below ^ np.repeat(first, np.diff(np.append(starts, len(below)))), starts)
            mask = np.bitwise_and.reduceat(shared, starts) & ~differ
            masks[-1] = shared & ~np.repeat(mask, np.diff(np.append(starts, len(below))))
            patterns.append(first)
            masks.append(mask)
        self.patterns, self.masks = patterns[::-1], masks[::-1]  # from the top

    def near(self, queries: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) of every two that differ in at most ``most`` bits, as places in what was given."""
        q = np.repeat(np.arange(len(queries)), len(self.patterns[0]))
        node = np.tile(np.arange(len(self.patterns[0])), len(queries))
        apart = np.zeros(len(q), np.uint8)
        for level, (pattern, mask) in enumerate(zip(self.patterns, self.masks)):
            if level:
                children = np.arange(self.fan)
                node = (node[:, None] * self.fan + children).ravel()
                q, apart = np.repeat(q, self.fan), np.repeat(apart, self.fan)
                there = node < len(pattern)
                q, node, apart = q[there], node[there], apart[there]
            apart = apart + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            open_ = apart <= most
            q, node, apart = q[open_], node[open_], apart[open_]
        return q, self.order[node]


class Classes:
    """Classes of places, and the links that made them."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.of[a] != self.of[b]
        a, b = a[new], b[new]
        _, first = np.unique(np.stack([self.of[a], self.of[b]]), axis=1, return_index=True)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                up[x] = x = up.get(up[x], up[x])
            return x

        for i, j in zip(a[first].tolist(), b[first].tolist()):
            x, y = root(int(self.of[i])), root(int(self.of[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((i, j))
        if up:
            used, at = np.unique(self.of, return_inverse=True)
            self.of = np.array([root(x) for x in used.tolist()])[at]


def links_within(prints: np.ndarray, others: np.ndarray | None = None, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``prints`` (or from ``prints`` to ``others``) that give the same classes as all of them do."""
    index = GrayIndex(prints)
    queries = prints if others is None else others
    all_ = prints if others is None else np.concatenate([prints, others])
    classes, base = Classes(len(all_)), 0 if others is None else len(prints)
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        q, found = index.near(queries[at : at + QUERIES_AT_ONCE], most)
        classes.join(q + at + base, found)
    ends = np.array(classes.links, np.int64).reshape(-1, 2)
    return all_[ends[:, 0]], all_[ends[:, 1]]


def _stretches(most: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``most`` + 1 stretches."""
    edges = [BITS * k // (most + 1) for k in range(most + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that link: enough of them for the classes, not all."""
    spark = prints.sparkSession
    n = prints.count()
    stretches = _stretches(most)
    width = min(max(0, (n // BUCKET).bit_length()), min(w for _, w in stretches))
    key = F.array(*[F.lit(k << 16) + F.shiftright("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for k, (low, _) in enumerate(stretches)])
    dealt = prints.select("fp", F.explode(key).alias("key"))
    large = cut(dealt.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("pieces")).where("pieces > 1"), "simhash-large")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    placed = dealt.join(large, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", piece)
    cells = placed.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    cells = cells.select("fp", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")

    def run(cell: pa.Table) -> pa.Table:
        prints = cell.column("fp").to_numpy().view(np.uint64)
        lo, hi = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
        own = cell.column("own").to_numpy()
        a, b = links_within(prints[own == lo], None if lo == hi else prints[own == hi], most)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    ship_code(spark)
    found = cells.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")
    return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links")


def simhash_classes(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts, and those of white space only, have the fingerprint zero, which links like any other.
    Repeated rows and equal fingerprints are one class. Rows with a null id get the smallest id of their class,
    null if it has none. Texts of any length are whole; other columns are ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs), "simhash-rows")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    roots = components(links(prints.select("fp"), most)).select(F.col("node").alias("fp"), "root")
    classed = cut(prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-classed")
    smallest = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(classed.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their classes at four or fewer differing bits."""
    return simhash_classes(table(spark, sf_dir, "documents"))
