"""Removal of long repeats with enhanced suffix arrays over anchored contexts.

Each window of ``least`` bytes is assigned to one anchor: the ``GRAM``-byte string in it with the
smallest hash. Equal windows have equal anchors at the same place, so only contexts of equal anchors
need comparing, wherever they lie. Contexts that are alone with their anchor's string repeat nothing;
contexts that are the same are folded into one with a count; what remains is compared in an enhanced
suffix array, whose common-prefix intervals are scanned with a stack: those with different left
extensions are the maximal repeats, each with all its occurrences. An anchor with very many different
contexts (the edge of a passage in a large share of all documents) is split into blocks of windows,
each keyed by the bytes that all its windows share, again and again down to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_chars, cut, map_batches, table

LEAST = 400
GRAM = 160
HOT = 256  # different contexts of one key, from which it is split
BLOCKS = (48, 12, 3, 1)  # windows in a block, at each splitting
CHARS_AT_ONCE = 1_500_000
MOST_STARTS = 1_000_000  # windows of one document that are hashed at a time
CHUNK_BYTES = 600_000  # contexts in one suffix array
_AT_BITS = np.uint64(24)

_rng = np.random.default_rng(20_011)
_VALUE = _rng.integers(0, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) | 5 for x in _rng.integers(1 << 40, 1 << 62, 2)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """64-bit hashes of any stretch of a byte array, by prefix sums of a polynomial."""

    powers: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        for k, base in ((which, _BASE[which]), (which + 2, pow(_BASE[which], -1, 1 << 64))):
            if len(self.powers.get(k, ())) < n:
                size = 1 << max(20, (n - 1).bit_length())
                self.powers[k] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))
        self.back = self.powers[which + 2]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUE[which][data] * self.powers[which][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by running minima from both sides of blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchored(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: text number, first window's start, anchor's distance from
    the first and from the last window's start, hash of the anchor's string, hash of the context."""
    w = least - gram + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(texts) or lengths.max() < least:
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    grams, wide = Hashes(data, 0), Hashes(data, 1)
    h = grams.all(gram)
    at = np.arange(len(h), dtype=np.uint64)
    low = _sliding_min(((h >> _AT_BITS) << _AT_BITS) | at, w)
    anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(anchor)]
    inside = np.arange(len(anchor)) + least <= ends[doc]
    change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1]))))
    stop = np.concatenate((change[1:], [len(anchor)])) - 1
    good = inside[change]
    first, last = change[good], stop[good]
    a = anchor[first]
    key = h[a].view(np.int64)
    context = _mix(wide.of(first, last + least) + (a - first).astype(np.uint64)).view(np.int64)
    d = doc[first]
    return d, first - (ends - lengths)[d], a - first, a - last, key, context


def runs(batch_texts: list[bytes], least: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchored`` over texts of any length: very long ones are cut into overlapping stretches."""
    short = [t if len(t) <= MOST_STARTS else b"" for t in batch_texts]
    held, at = 0, 0
    for k, t in enumerate([*short, None]):
        if t is None or held + len(t) > MOST_STARTS:
            found = anchored(short[at:k], least, gram)
            yield found[0] + at, *found[1:]
            at, held = k, 0
        held += len(t or b"")
    for k, t in enumerate(batch_texts):
        if len(t) > MOST_STARTS:
            for s in range(0, len(t) - least + 1, MOST_STARTS):
                found = anchored([t[s : s + MOST_STARTS + least - 1]], least, gram)
                yield found[0] + k, found[1] + s, *found[2:]


class SuffixArray:
    """Suffixes of several byte strings, sorted, with the common-prefix lengths of neighbours.

    Sorting is by prefix doubling until all suffixes are told apart, however long their common prefixes.
    Every string ends in a symbol of its own, so no common prefix runs past an end.
    """

    def __init__(self, strings: list[bytes], least: int):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        n = int(self.starts[-1])
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)
        self.symbols = np.empty(n + 4, np.uint64)
        self.symbols[:n] = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.symbols[self.starts[1:] - 1] = 256 + np.arange(len(strings), dtype=np.uint64)
        self.symbols[n:] = 0
        s = self.symbols
        bits = np.uint64(max(16, (256 + len(strings)).bit_length()))
        k = min(4, 64 // int(bits))
        key = s[:n]
        for j in range(1, k):
            key = (key << bits) | s[j : n + j]
        ranks: list[tuple[int, np.ndarray]] = []
        while True:
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate(([False], key[order][1:] != key[order][:-1])))
            if rank[order[-1]] == n - 1:
                break
            ranks.append((k, rank))
            key = rank.astype(np.int64) * (n + 2)
            key[: n - k] += rank[k:] + 1
            k *= 2
        self.order = order
        self.common = self._common(ranks, n, least, k)

    def _common(self, ranks: list[tuple[int, np.ndarray]], n: int, least: int, told_apart: int) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order; 0 where shorter than ``least``.

        No two suffixes share ``told_apart`` symbols, so each halved step is taken at most once.
        """
        out = np.zeros(n, np.int64)
        at = np.arange(1, n)
        for k, rank in reversed(ranks):  # only neighbours that share enough are worth measuring
            if k <= least:
                at = np.flatnonzero(rank[self.order[1:]] == rank[self.order[:-1]]) + 1
                break
        a, b = self.order[at], self.order[at - 1]
        length = np.zeros(len(at), np.int64)
        for k, rank in reversed(ranks):
            more = np.flatnonzero((a + length < n) & (b + length < n))
            same = rank[a[more] + length[more]] == rank[b[more] + length[more]]
            length[more[same]] += k
        for _ in range(min(told_apart, ranks[0][0] if ranks else told_apart) - 1):
            more = np.flatnonzero((a + length < n) & (b + length < n))
            same = self.symbols[a[more] + length[more]] == self.symbols[b[more] + length[more]]
            length[more[same]] += 1
        out[at] = np.where(length >= least, length, 0)
        return out


def maximal_repeats(strings: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions in the joined strings) of each maximal repeat of ``least`` bytes or more.

    A stack scan over the suffix array yields the intervals of a common prefix; an interval is a
    maximal repeat if its suffixes are preceded by different symbols. All occurrences are given.
    Positions count one closing symbol after each string.
    """
    if not strings:
        return
    sa = SuffixArray(strings, least)
    yield from _scan(sa)


def _scan(sa: SuffixArray) -> Iterator[tuple[int, np.ndarray]]:
    common, order = sa.common, sa.order
    before = np.where(np.isin(order, sa.starts[:-1]), -1 - sa.owner[order], sa.symbols[order - 1].astype(np.int64))
    live = np.flatnonzero(common)
    if not len(live):
        return
    # whether the suffixes at i - 1 and i are preceded by different symbols; counted up to any place
    differ = np.concatenate(([0], np.cumsum(np.concatenate(([False], before[1:] != before[:-1])))))
    gaps = np.flatnonzero(np.diff(live) > 1)
    for a, b in zip(np.concatenate(([0], gaps + 1)).tolist(), np.concatenate((gaps, [len(live) - 1])).tolist()):
        lo, hi = int(live[a]), int(live[b])
        stack: list[tuple[int, int]] = []  # (length, first suffix)
        for i, length in zip(range(lo, hi + 2), [*common[lo : hi + 1].tolist(), 0]):
            first = i - 1
            while stack and stack[-1][0] > length:
                n, first = stack.pop()
                if differ[i] > differ[first + 1]:
                    yield n, order[first:i]
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, first))


def covered(strings: list[bytes], counts: list[int], least: int) -> list[list[tuple[int, int]]]:
    """For each string, the ranges that maximal repeats cover; a string that occurs more than once is covered whole."""
    sa = SuffixArray(strings, least)
    edges = np.zeros(int(sa.starts[-1]) + 1, np.int64)
    for length, at in _scan(sa):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
    inside = np.concatenate(([0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]))
    change = np.flatnonzero(np.diff(inside))
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        k = int(sa.owner[a])
        out[k].append((a - int(sa.starts[k]), b - int(sa.starts[k])))
    return [[(0, len(s))] if n > 1 else x for s, n, x in zip(strings, counts, out)]


_RANGES = "array<struct<a:int,b:int>>"
_ID = ["d", "th"]


def _rows(docs: DataFrame) -> DataFrame:
    """Documents with what identifies a row in joins: its id and a hash of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def _packed(docs: DataFrame) -> DataFrame:
    """d, th, doc_id and the compressed text, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in by_chars(batches, 3, CHARS_AT_ONCE):
            packed = pa.array([z.compress(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["d", "th", "doc_id", "z"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_batches(rows, run, "d long, th long, doc_id long, z binary")


def _anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chars(batches, 2, CHARS_AT_ONCE):
            d, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k, s, hi, lo, key, c in runs([t.encode() for t in batch.column(2).to_pylist()], least, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[k]), pa.array(th[k]), pa.array(s, pa.int32()), pa.array(hi.astype(np.int16)), pa.array(lo.astype(np.int16)), pa.array(key), pa.array(c)],
                    ["d", "th", "s", "hi", "lo", "key", "c"],
                )

    return map_batches(_rows(docs), run, "d long, th long, s int, hi short, lo short, key long, c long")


def _classified(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose key occurs more than once, with ``m``: 1 if all its contexts are the same, else their number.

    ``n``, the count of a row, is summed first for each key and context (in part before the shuffle).
    """
    contexts = rows.groupBy("key", "c").agg(F.sum("n").alias("n"))
    keys = contexts.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1").select("key", "m")
    return rows.join(cut(keys, f"{name}-keys"), "key")


def _compared(contexts: DataFrame, least: int) -> DataFrame:
    """key, c and the covered ranges of each context, keys kept together in suffix arrays of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = covered([x[3] for x in held], [x[2] for x in held], least)
            keep = [k for k, r in enumerate(found) if r]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[k][0] for k in keep], pa.int64()), pa.array([held[k][1] for k in keep], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in found[k]] for k in keep], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                ["key", "c", "ranges"],
            )

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size > CHUNK_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    dealt = contexts.select("key", "c", "n", "bytes").repartition("key").sortWithinPartitions("key", "c")
    return map_batches(dealt, run, f"key long, c long, ranges {_RANGES}")


def _split(hot: DataFrame, block: int, least: int) -> DataFrame:
    """Contexts of hot keys cut into blocks of windows, each keyed by the bytes that all its windows share."""
    schema = "root_key long, root_c long, off int, n long, hi short, lo short, bytes binary, key long, c long"

    def digest(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root_key, root_c, off, n, hi, lo, data, key in zip(*(batch.column(k).to_pylist() for k in range(8))):
                name = key.to_bytes(8, "little", signed=True)
                for j in range(lo // block, hi // block + 1):
                    low, high = max(lo, j * block), min(hi, (j + 1) * block - 1)
                    shared = data[hi - j * block : hi - (j + 1) * block + 1 + least]
                    part = data[hi - high : hi - low + least]
                    tag = j.to_bytes(4, "little") + block.to_bytes(4, "little")
                    out.append((root_key, root_c, off + hi - high, n, high, low, part, digest(name, tag, shared), digest(name, tag, low.to_bytes(4, "little"), part)))
            cols = list(zip(*out)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["root_key", "root_c", "off", "n", "hi", "lo", "bytes", "key", "c"])

    return map_batches(hot.select("root_key", "root_c", "off", "n", "hi", "lo", "bytes", "key"), run, schema)


def _contexts(docs: DataFrame, chosen: DataFrame, least: int) -> DataFrame:
    """The bytes of one occurrence of each chosen context, fetched from its document."""
    wanted = chosen.groupBy(*_ID).agg(F.collect_list(F.struct("key", "c", "n", "s", "hi", "lo", "m")).alias("wanted"))
    joined = _packed(docs).select(*_ID, "z").join(wanted.hint("shuffle_hash"), _ID).select("z", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = z.decompress(packed)
                out += [(w["key"], w["c"], w["n"], w["hi"], w["lo"], w["m"], data[w["s"] : w["s"] + w["hi"] - w["lo"] + least]) for w in wanted]
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "c", "n", "hi", "lo", "m", "bytes"])

    return map_batches(joined, run, "key long, c long, n long, hi short, lo short, m long, bytes binary")


def _spread(found: DataFrame) -> DataFrame:
    return found.select("root_key", "root_c", F.explode("ranges").alias("r")).select("root_key", "root_c", F.col("r.a").alias("a"), F.col("r.b").alias("b"))


def find_repeats(docs: DataFrame, least: int = LEAST, gram: int | None = None, hot: int = HOT) -> DataFrame:
    """d, th and ``spans``: the byte ranges of each row that lie in a string of ``least`` bytes occurring elsewhere too.

    Rows without such bytes have no row here. See ``remove_repeats`` for the defined results.
    """
    gram = gram or max(1, min(GRAM, least * 2 // 5))
    seen = cut(_anchors(docs, least, gram), "repeat-anchors").withColumn("n", F.lit(1).cast("long"))
    several = cut(_classified(seen, "repeat"), "repeat-rows")
    whole = several.where("m = 1").select(*_ID, F.col("s").alias("a"), (F.col("s") + F.col("hi") - F.col("lo") + least).alias("b"))
    mixed = several.where("m > 1")
    first = mixed.groupBy("key", "c").agg(F.sum("n").alias("n"), F.min(F.struct("d", "th", "s")).alias("at"), F.max("hi").alias("hi"), F.max("lo").alias("lo"), F.max("m").alias("m"))
    contexts = cut(_contexts(docs, first.select("key", "c", "n", "at.d", "at.th", "at.s", "hi", "lo", "m"), least), "repeat-contexts")
    found = [_spread(_compared(contexts.where(F.col("m") <= hot), least).select(F.col("key").alias("root_key"), F.col("c").alias("root_c"), "ranges"))]
    rest = contexts.where(F.col("m") > hot).select(F.col("key").alias("root_key"), F.col("c").alias("root_c"), F.lit(0).alias("off"), "n", "hi", "lo", "bytes", "key")
    for block in BLOCKS:
        if rest.isEmpty():
            break
        parts = cut(_split(rest, max(1, min(block, least // 4)), least), "repeat-blocks")
        parts = cut(_classified(parts, "repeat-block"), "repeat-block-rows")
        length = F.col("hi") - F.col("lo") + least
        found.append(parts.where("m = 1").select("root_key", "root_c", F.col("off").alias("a"), (F.col("off") + length).cast("int").alias("b")))
        few = parts.where((F.col("m") > 1) & (F.col("m") <= hot))
        folded = few.groupBy("key", "c").agg(F.sum("n").alias("n"), F.min("bytes").alias("bytes"))
        ranges = cut(_compared(folded, least), "repeat-block-ranges")
        moved = few.select("key", "c", "root_key", "root_c", "off").join(ranges, ["key", "c"])
        found.append(_spread(moved.withColumn("ranges", F.expr("transform(ranges, r -> struct(r.a + off AS a, r.b + off AS b))"))))
        rest = parts.where(F.col("m") > hot).select("root_key", "root_c", "off", "n", "hi", "lo", "bytes", "key")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    ranges = cut(every.groupBy("root_key", "root_c").agg(F.collect_list(F.struct("a", "b")).alias("ranges")).select(F.col("root_key").alias("key"), F.col("root_c").alias("c"), "ranges"), "repeat-ranges")
    hits = mixed.select("key", "c", *_ID, "s").join(ranges, ["key", "c"]).select(*_ID, F.expr("transform(ranges, r -> struct(s + r.a AS a, s + r.b AS b))").alias("spans"))
    alone = whole.select(*_ID, F.array(F.struct("a", "b")).alias("spans"))
    return alone.unionByName(hits).groupBy(*_ID).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the bytes that remain), n_bytes, n_removed and n_spans (maximal removed runs) of every row.

    Null text counts as empty; texts shorter than ``least`` bytes stay whole; every occurrence goes,
    the first as well, in the same document too. Repeated rows repeat each other; rows with a null id
    are kept apart by their text. Other columns are ignored; an empty table gives no rows. Texts of any
    length are taken whole: a task holds one of them, and contexts of bounded size.
    """
    spans = find_repeats(docs, least, gram, hot)
    joined = _packed(docs).join(spans.hint("shuffle_hash"), _ID, "left").select("doc_id", "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                kept, sizes, gone, n = [], [], [], []
                for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    data = z.decompress(packed)
                    cuts = _union([(x["a"], x["b"]) for x in spans or ()])
                    parts, end = [], 0
                    for a, b in cuts:
                        parts.append(data[end:a])
                        end = b
                    kept.append(b"".join([*parts, data[end:]]))
                    sizes.append(len(data))
                    gone.append(len(data) - len(kept[-1]))
                    n.append(len(cuts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return map_batches(joined, run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that lie in a 400-byte string found elsewhere too."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 400 bytes by its MD5; windows are cut from stretches of 1,024 so that none is sought in a long text.
ORACLE = """
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
b AS (SELECT r, p, substr(h, 2 * p + 1, 2 * (1024 + 399)) AS s FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 399, 0), 1024)) AS p FROM t)),
w AS MATERIALIZED (SELECT r, p + i AS p, md5_number(substr(s, 2 * i + 1, 800)) AS k FROM (SELECT r, p, s, unnest(range(least(length(s) // 2 - 399, 1024))) AS i FROM b)),
m AS (SELECT r, p FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) AS often USING (k)),
j AS (SELECT r, p, coalesce(p > lag(p) OVER o + 400, true) AS fresh FROM m WINDOW o AS (PARTITION BY r ORDER BY p)),
n AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS run FROM j),
c AS (SELECT r, run, min(p) AS a, max(p) + 400 AS b FROM n GROUP BY ALL),
g AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM c),
k AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM g JOIN t USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN k USING (r)
"""
