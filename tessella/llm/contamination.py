"""Benchmark decontamination with a generalised suffix automaton over benchmark words.

The automaton of the normalised items is built once for a block of items of bounded size. Training
words are streamed through it, tracking the longest suffix of the words so far that occurs in some
item; where that length reaches a window's length, the window occurs there. Words that cannot take
part (their neighbouring pairs never occur in the benchmark) are skipped beforehand, which loses no
occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_chars, cut, map_batches, table

WINDOW = 10
BLOCK_WORDS = 400_000  # words of the benchmark in one automaton; more items are taken in further blocks
CHARS_AT_ONCE = 8_000_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, letters a-z and code points from 128 on, as UTF-8."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_TO_WORDS).split()


class WordAutomaton:
    """Generalised suffix automaton of items' word sequences, with what occurs at each state."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for k, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        windows: dict[int, dict[int, set]] = {}  # state -> window length -> items
        for k, ids in coded:
            n = min(window, len(ids))
            for state, at in self._states(ids, n):
                windows.setdefault(state, {}).setdefault(n, set()).add(k)
        #: (length, items) of the windows that are suffixes of a state's longest string
        self.hits: list[tuple[tuple[int, frozenset], ...]] = [()] * len(self.go)
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            own = tuple((n, frozenset(k)) for n, k in windows.get(s, {}).items())
            self.hits[s] = own + self.hits[self.link[s]]
        self.shortest = min((min(window, len(ids)) for _, ids in coded), default=0)
        size = max(len(self.vocabulary), 1)
        self.pairs = np.unique(np.array([a * size + b for _, ids in coded for a, b in zip(ids, ids[1:])], np.int64))

    def _states(self, ids: list[int], n: int) -> Iterator[tuple[int, int]]:
        """For each stretch of n words of an item, the state that its string belongs to."""
        s = matched = 0
        for at, c in enumerate(ids):
            s, matched = self._step(s, matched, c)
            if matched >= n:
                while self.length[self.link[s]] >= n:
                    s = self.link[s]
                matched = n
                yield s, at

    def _step(self, s: int, matched: int, c: int) -> tuple[int, int]:
        there = self.go[s].get(c)
        while there is None and s:
            s = self.link[s]
            matched = self.length[s]
            there = self.go[s].get(c)
        return (0, 0) if there is None else (there, matched + 1)

    def _extend(self, last: int, c: int) -> int:
        there = self.go[last].get(c)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, c, there)
        new = self._new({}, 0, self.length[last] + 1)
        p = last
        while p != -1 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.go[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(dict(self.go[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.go[p].get(c) == q:
            self.go[p][c] = copy
            p = self.link[p]
        return copy

    def _new(self, go: dict[int, int], link: int, length: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (start, end exclusive; merged) inside occurring windows, and the items that occur."""
        found: set = set()
        ranges: list[tuple[int, int]] = []
        if not self.shortest or len(words) < self.shortest:
            return ranges, found
        ids = np.fromiter(map(self.vocabulary.get, words, _absent()), np.int64, len(words))
        for start, end in self._runs(ids):
            s = matched = 0
            for at in range(start, end):
                s, matched = self._step(s, matched, int(ids[at]))
                for n, items in self.hits[s]:
                    if n <= matched:
                        found |= items
                        first = at + 1 - n
                        # windows of different lengths may end here, so an earlier start can come later
                        while ranges and ranges[-1][1] >= first:
                            first = min(first, ranges.pop()[0])
                        ranges.append((first, at + 1))
        return ranges, found

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words long enough for a window in which all neighbouring pairs occur in the benchmark."""
        inside = ids >= 0
        if self.shortest > 1:
            code = ids[:-1] * max(len(self.vocabulary), 1) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
            joined = inside[:-1] & inside[1:] & (self.pairs[at] == code) if len(self.pairs) else np.zeros(len(code), bool)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
            for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if end - start + 1 >= self.shortest:
                    yield start, end + 1
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
            yield from zip(edge[::2].tolist(), edge[1::2].tolist())


def _absent() -> Iterator[int]:
    while True:
        yield -1


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time.

    The number of blocks comes from the table's own size, so a benchmark of any size is taken whole. An item of more
    than a quarter of a block is cut into stretches that share ``window`` - 1 words, so that each of its windows is in one.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    most = max(block_words // 4, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                starts = range(0, max(len(words) - window + 1, 1), most)
                parts = [b" ".join(words[a : a + most + window - 1]).decode() for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.int64()), pa.array(parts, pa.string())], ["item_id", "text"])

    long_ = F.octet_length("text") > 2 * most  # fewer bytes hold no more words
    items = cut(items.where(~long_).unionAll(map_batches(items.where(long_), run, "item_id long, text string")), "contamination-items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (6 * block_words)))
    for k in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` plus n_words, ``hit_spans`` (array of [start, end) word ranges) and ``hit_items``.

    Null text has no words; an item without words occurs nowhere; items that share an id count as
    one; null item ids are kept as an item of their own. Repeated documents each get their result;
    an empty table on either side gives no hits. The columns this adds replace columns of the same name.
    One automaton is sent out for each block of the benchmark; a block's pass adds to what the passes
    before it found, so no document is shuffled.
    """
    added = ["n_words", "hit_spans", "hit_items"]
    out = docs.drop(*added)
    own = out.columns
    out = out.select(*[F.col(f"`{c}`") for c in own], F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("hit_spans"), F.array().cast("array<long>").alias("hit_items"))
    spark = docs.sparkSession
    for k, block in enumerate(blocks(benchmark, block_words, window)):
        if k:
            out = cut(out, "contamination-block")  # so that one automaton is in a worker at a time
        automaton = spark.sparkContext.broadcast(WordAutomaton([(i, words_of(t)) for i, t in block], window))
        out = map_batches(out, _pass(automaton, own.index("text"), len(own)), out.schema)
    return out


def _pass(automaton, text_at: int, n_own: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton.value
        for batch in by_chars(batches, text_at, CHARS_AT_ONCE):
            counts, spans, items = [], [], []
            before = zip(batch.column(n_own + 1).to_pylist(), batch.column(n_own + 2).to_pylist())
            for text, (old_spans, old_items) in zip(batch.column(text_at).to_pylist(), before):
                words = words_of(text)
                ranges, found = auto.scan(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in (merge([*((x["start"], x["end"]) for x in old_spans), *ranges]) if old_spans else ranges)])
                items.append(sorted({*old_items, *found}, key=lambda x: (x is None, x or 0)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_own], pa.array(counts, pa.int64()), pa.array(spans, batch.schema.field(n_own + 1).type), pa.array(items, batch.schema.field(n_own + 2).type)],
                schema=batch.schema,
            )

    return run


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def remove_spans(found: DataFrame, most_words: int | None = None, most_share: float | None = None) -> DataFrame:
    """Cuts the hit words (and what stands between words of one span) out of ``text``.

    A document goes entirely if its hits exceed ``most_words`` or ``most_share`` of its words.
    """
    columns = found.columns
    text_at, spans_at, words_at = columns.index("text"), columns.index("hit_spans"), columns.index("n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chars(batches, text_at, CHARS_AT_ONCE):
            texts, keep = [], []
            for text, spans, n in zip(*(batch.column(k).to_pylist() for k in (text_at, spans_at, words_at))):
                hit = sum(s["end"] - s["start"] for s in spans)
                keep.append(not (most_words is not None and hit > most_words or most_share is not None and hit > most_share * max(n, 1)))
                if spans and keep[-1]:
                    data = text.encode()
                    at = [m.span() for m in _WORD.finditer(data)]
                    out, end = [], 0
                    for s in spans:
                        out.append(data[end : at[s["start"]][0]])
                        end = at[s["end"] - 1][1]
                    text = b"".join([*out, data[end:]]).decode()
                texts.append(text)
            new = list(batch.columns)
            new[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(new, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return map_batches(found, run, found.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of benchmark windows, and the items that occur."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    named = F.array_sort(F.transform(F.filter("hit_items", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lengths WHERE len(w) >= n)
), found AS (SELECT p.row_no, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.key = x.key),
words AS (SELECT row_no, count(DISTINCT pos) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS pos FROM found) GROUP BY row_no),
items AS (
  SELECT row_no, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT row_no, item_id FROM found) GROUP BY row_no
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_no) LEFT JOIN items USING (row_no)
"""
