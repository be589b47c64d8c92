"""Exact Jaccard join on word n-grams by vertical partitioning, down to connected classes.

All n-grams have one global order, the least frequent first. To find it, they are dealt by their hashes; each
share counts in how many sets each of its n-grams occurs and drops those that one set alone holds: they come first
in the order and no pair shares them. What is left of each set is put together again; a set with too few shared
n-grams links with nothing. The others' prefixes (sets that link share an n-gram of their prefixes, at places that
leave room for enough overlap) give candidate pairs. For those, the global order is cut into vertical fragments at
fixed frequencies, and the overlaps of each pair are counted fragment by fragment and summed. Equal sets are folded
first; of a group that shares an n-gram each set first meets the group's most central one only, and then
sets of different classes meet, so a group of near copies costs no square and yet no link between
classes is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_chars, cut, map_batches, shuffles_freed, table, unused
from tessella.llm.repeats import Hashes, _mix

SHINGLE = 5
NUM, DEN = 3, 4  # the least similarity, as a fraction
FREQUENT = 20_000  # n-grams dealt by set instead of by n-gram, as one task could not hold their sets; they change no result
SEEN_OFTEN = 5  # documents of one batch that share an n-gram, from which it may be one of them
POSTINGS_AT_ONCE = 1_000_000  # n-grams of sets in one fragment
LEAST_FRAGMENTS = 64
#: Vertical fragments in which overlaps are counted: the global order cut at these frequencies.
EDGES = (3, 4, 6, 10, 20, 60, 300)
PARTS = len(EDGES) + 1
PAIRS_AT_ONCE = 1_000  # pairs of one set from which its list is dealt to several tasks
CHARS_AT_ONCE = 1_000_000
LONG_WORD = 64  # bytes from which a word is hashed cryptographically
NAMES_AT_ONCE = 200_000  # sets that a task remembers, so as not to send copies twice
_OFTEN = 1 << 30  # frequencies from here on are places among the frequent n-grams


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits for each word. Long words get a cryptographic hash: the polynomial of the others is modulo a power of two, and
    takes words for alike that follow certain patterns over hundreds of letters."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    h = Hashes(np.frombuffer(b" ".join(words), np.uint8), 0).of(ends - length, ends)
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(words[k], digest_size=8).digest(), "little")
    return h


def _n_grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbours, in order, from their hashes."""
    n = max(len(words) - size + 1, 0)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k])
    return h


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; all words as one n-gram if they are fewer."""
    words = [t.lower().split() for t in texts]
    hashed = _word_hashes([w for own in words for w in own])
    every, at, out = _n_grams(hashed, size), 0, []
    for n in map(len, words):
        out.append(np.unique(every[at : at + n - size + 1] if n >= size else _n_grams(hashed[at : at + n], n)) if n else np.empty(0, np.uint64))
        at += n
    return out


def prefix_length(n: int) -> int:
    """How many of n n-grams, first in any global order, must hold one that a similar set's prefix holds."""
    return n - -(-NUM * n // DEN) + 1 if n else 0


def _name(tokens: np.ndarray) -> int:
    """Name of a set, 64 bits of a cryptographic hash; equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, node (the set's name) and, on one row of each batch, its often-seen n-grams."""
    kind = pa.list_(pa.struct([("t", pa.int64()), ("c", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_chars(batches, 2, CHARS_AT_ONCE):
            if not batch.num_rows:
                continue
            sets = shingle_sets([t.encode() for t in batch.column(2).to_pylist()])
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= SEEN_OFTEN
            common = [[{"t": t, "c": c} for t, c in zip(tokens[often].view(np.int64).tolist(), counts[often].tolist())], *[None] * (len(sets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(_name, sets)), pa.int64()), pa.array(common, kind)],
                ["doc_id", "th", "n", "node", "common"],
            )

    return map_batches(_texts(docs), run, "doc_id long, th long, n long, node long, common array<struct<t:long,c:long>>")


class Frequent:
    """The n-grams that come last in the order, by their counts."""

    def __init__(self, found: list[tuple[int, int]]):
        tokens = np.array([t for t, _ in found], np.int64).view(np.uint64)
        counts = np.array([c for _, c in found], np.int64)
        by_hash = np.argsort(tokens)
        self.tokens = tokens[by_hash]
        place = np.empty(len(tokens), np.int64)
        place[np.lexsort((tokens, counts))] = np.arange(len(tokens))
        self.place = place[by_hash] + _OFTEN

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Each n-gram's place, 0 if it is not among them."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.place[at], 0)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of fixed-width numbers, first all the lowest bytes and so on: small numbers leave zeros that compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _dealt(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each 64-bit hash, rising with it."""
    return ((x.view(np.uint64) >> np.uint64(33)).astype(np.int64) * parts) >> 31


def _batch(fields: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


_PACKED = [("part", pa.int32()), *[(c, pa.binary()) for c in ("tokens", "owners", "names", "sizes")]]


def _postings(docs: DataFrame, frequent, fragments: int) -> DataFrame:
    """All n-grams of all sets, packed: a row for each batch and fragment. Frequent ones are dealt by n-gram and
    set to as many parts, numbered from -1 down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Frequent = frequent.value
        seen: set[int] = set()
        for batch in by_chars(batches, 2, CHARS_AT_ONCE):
            names, sets = [], []
            for s in shingle_sets([t.encode() for t in batch.column(2).to_pylist()]):
                node = _name(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    names.append(node)
                    sets.append(s)
            if len(seen) > NAMES_AT_ONCE:
                seen.clear()
            if not names:
                continue
            node, size = np.array(names, np.int64), np.array(list(map(len, sets)), np.uint32)
            token, owner = np.concatenate(sets), np.repeat(np.arange(len(names), dtype=np.uint32), size)
            part = np.where(own.of(token) > 0, -1 - _dealt(_mixed(token, node[owner]), fragments), _dealt(token, fragments))
            order = np.lexsort((token, part))
            token, owner, part = token[order], owner[order], part[order]
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rows: list[list] = [part[starts].astype(np.int32).tolist(), [], [], [], []]
            for a, b in zip(starts, [*starts[1:], len(part)]):
                used, at = np.unique(owner[a:b], return_inverse=True)
                steps = np.diff(token[a:b], prepend=np.uint64(0))
                for column, x in zip(rows[1:], (steps, at.astype(np.uint32), node[used], size[used])):
                    column.append(_planes(x))
            yield _batch(_PACKED, rows)

    return map_batches(_texts(docs), run, "part int, tokens binary, owners binary, names binary, sizes binary")


def _mixed(token: np.ndarray, node: np.ndarray) -> np.ndarray:
    h = (token ^ node.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each value of the first column, which comes in order; one value's rows are held."""
    held, now = [], None
    for batch in batches:
        for part, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if held and part != now:
                yield now, held
                held = []
            now = part
            held.append(tuple(row))
    if held:
        yield now, held


def _shared(packed: DataFrame, frequent, fragments: int) -> DataFrame:
    """The n-grams that several sets hold, with their frequencies, packed by sets: a row for each fragment and bucket of sets."""
    fields = [("bucket", pa.int32()), *[(c, pa.binary()) for c in ("tokens", "nodes", "sizes", "often")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            token = np.concatenate([np.cumsum(_unplanes(r[0], "<u8"), dtype=np.uint64) for r in rows])
            owners = [_unplanes(r[1], "<u4") for r in rows]
            node = np.concatenate([_unplanes(r[2], "<i8")[o] for r, o in zip(rows, owners)])
            size = np.concatenate([_unplanes(r[3], "<u4")[o] for r, o in zip(rows, owners)])
            del owners
            order = np.lexsort((node, token))
            token = token[order]  # one after the other, so that only one is held twice
            node = node[order]
            size = size[order]
            del order, rows
            once = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))  # copies from elsewhere go
            token = token[once]
            node = node[once]
            size = size[once]
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            width = np.diff(np.concatenate((starts, [len(token)])))
            often = np.repeat(np.minimum(width, _OFTEN - 1), width) if part >= 0 else frequent.value.of(token)
            kept = np.flatnonzero(often > 1)
            if not len(kept):
                continue
            often, token, node, size = often[kept].astype(np.uint32), token[kept], node[kept], size[kept]
            bucket = _dealt(node, fragments)
            kept = np.argsort(bucket, kind="stable")
            bucket = bucket[kept]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            parts = np.split(kept, starts[1:])
            yield _batch(fields, [bucket[starts].astype(np.int32), *[[_planes(x[k]) for k in parts] for x in (token, node, size, often)]])

    dealt = packed.repartition(fragments, "part").sortWithinPartitions("part")
    return map_batches(dealt, run, "bucket int, tokens binary, nodes binary, sizes binary, often binary")


_KEPT = "node long, n long, central double, prefix array<struct<t:long,pos:int>>, parts array<array<long>>"


def _candidates(shared: DataFrame, fragments: int) -> DataFrame:
    """A row for each set with shared n-grams enough to link: its size, how often its n-grams occur on average (as a
    logarithm), the shared ones in its prefix with their places in the order, and all shared ones by vertical fragment."""
    fields = [("node", pa.int64()), ("n", pa.int64()), ("central", pa.float64()), ("prefix", pa.list_(pa.struct([("t", pa.int64()), ("pos", pa.int32())]))), ("parts", pa.list_(pa.list_(pa.int64())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            token, node, size, often = (np.concatenate([_unplanes(r[k], kind) for r in rows]) for k, kind in enumerate(("<u8", "<i8", "<u4", "<u4")))
            order = np.lexsort((token, often, node))
            token, node, size, often = token[order], node[order], size[order].astype(np.int64), often[order]
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            ends = np.concatenate((starts[1:], [len(node)]))
            enough = DEN * (ends - starts) >= NUM * size[starts]
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
                n = int(size[a])
                alone = n - (b - a)  # n-grams that no other set has: first in the order
                first = token[a : a + max(prefix_length(n) - alone, 0)].view(np.int64).tolist()
                if not first:
                    continue
                lists = np.split(token[a:b].view(np.int64), np.searchsorted(often[a:b], EDGES))
                row = (int(node[a]), n, float(np.log2(often[a:b].astype(np.float64)).sum() / n), [{"t": t, "pos": alone + k} for k, t in enumerate(first)], lists)
                for column, x in zip(out, row):
                    column.append(x)
                if len(out[0]) >= 500:
                    yield _batch(fields, out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _batch(fields, out)

    dealt = shared.repartition(fragments, "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, run, _KEPT)


def _may_link(n1, n2, pos1, pos2):
    """Sizes that allow the similarity, and places of a common n-gram that leave room for the overlap it needs."""
    sizes = DEN * F.least(n1, n2) >= NUM * F.greatest(n1, n2)
    need = F.ceil(NUM * (n1 + n2) / F.lit(float(NUM + DEN)) - F.lit(1e-9))
    return sizes & (F.least(n1 - pos1, n2 - pos2) >= need)


def _pair(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose overlap, summed over the fragments, reaches the similarity.

    A set that is in very many pairs is copied, and its pairs are dealt to the copies.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).cast("int").alias("copies"))
    hot = cut(ends.where("copies > 1"), "jaccard-hot")
    copies = lambda c: F.coalesce(c, F.lit(1))
    lists = sets.select("node", "parts").join(hot, "node", "left").select("node", F.explode(F.sequence(F.lit(0), copies(F.col("copies")) - 1)).alias("copy"), "parts")
    lists = lists.select("node", "copy", F.posexplode("parts").alias("part", "tokens"))
    for end, other in (("a", "b"), ("b", "a")):
        pairs = pairs.join(hot.select(F.col("node").alias(end), F.col("copies").alias(f"copies_{end}")), end, "left").withColumn(f"copy_{end}", F.pmod(F.xxhash64(other), copies(F.col(f"copies_{end}"))).cast("int"))
    asked = pairs.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    left = lists.select(F.col("node").alias("a"), F.col("copy").alias("copy_a"), "part", F.col("tokens").alias("x"))
    right = lists.select(F.col("node").alias("b"), F.col("copy").alias("copy_b"), "part", F.col("tokens").alias("y"))
    partial = asked.join(left, ["a", "copy_a", "part"]).join(right, ["b", "copy_b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("k"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
    return cut(total.where(DEN * F.col("k") >= NUM * (F.col("n_a") + F.col("n_b") - F.col("k"))).select("a", "b"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has a link, by alternating star contractions."""
    edges = links.select(*_pair(F.col("a"), F.col("b"))).where("a <> b").distinct()
    before = None
    while True:
        edges = cut(edges, "star-edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-low")
        edges = cut(both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "star-large")
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = cut(edges.groupBy("b").agg(F.min("a").alias("m")), "star-low")
        moved = edges.join(low, "b").select(F.col("m").alias("x"), "a", "b")
        edges = moved.select(F.col("x").alias("a"), F.col("a").alias("b")).unionAll(low.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and root (name of the class, null without n-grams) of every row, written out."""
    spark = docs.sparkSession
    rows = cut(_sets(docs), "jaccard-sets")
    often = rows.where("common IS NOT NULL").select(F.explode("common").alias("x")).groupBy(F.col("x.t").alias("t")).agg(F.sum("x.c").alias("c"))
    found = [(r["t"], r["c"]) for r in often.orderBy(F.desc("c"), "t").limit(FREQUENT).collect()]
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = rows.drop("common")
    fragments = max(LEAST_FRAGMENTS, -(-total // POSTINGS_AT_ONCE))
    frequent = spark.sparkContext.broadcast(Frequent(found))  # FREQUENT n-grams at most
    with shuffles_freed(spark):
        shared = _shared(_postings(docs, frequent, fragments), frequent, fragments)
        sets = cut(_candidates(shared, fragments), "jaccard-candidates")
    postings = sets.select("node", "n", "central", F.explode("prefix").alias("p")).select("node", "n", "central", "p.t", "p.pos")
    # each set meets the most central one of every n-gram in its prefix
    middle = postings.groupBy("t").agg(F.max(F.struct("central", "node", "n", "pos")).alias("c"), F.count("*").alias("k")).where("k > 1")
    middle = middle.select("t", F.col("c.node").alias("center"), F.col("c.n").alias("n_c"), F.col("c.pos").alias("pos_c"))
    stars = postings.drop("central").join(middle, "t").where(F.col("node") != F.col("center"))
    stars = stars.where(_may_link(F.col("n"), F.col("n_c"), F.col("pos"), F.col("pos_c")))
    pairs = cut(_sized(stars.select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("center").alias("y"), F.col("n_c").alias("n_y"))), "jaccard-pairs")
    links = _verified(sets, pairs)
    roots = cut(components(links), "jaccard-roots")
    # what may still link: sets of different classes that share a prefix n-gram
    classed = cut(postings.drop("central").join(roots, "node", "left").select("t", "node", "n", "pos", F.coalesce("root", "node").alias("root")), "jaccard-classed")
    by_class = classed.groupBy("t", "root").agg(F.count("*").alias("k")).groupBy("t").agg(F.count("*").alias("classes"), F.max(F.struct("k", "root")).alias("main"))
    mixed = cut(by_class.where("classes > 1").select("t", F.col("main.root").alias("main")), "jaccard-mixed")
    right = cut(classed.join(mixed, "t").select("t", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("pos").alias("pos_y"), F.col("root").alias("root_y"), "main"), "jaccard-right")
    left = right.where("root_y <> main").select("t", F.col("y").alias("x"), F.col("n_y").alias("n_x"), F.col("pos_y").alias("pos_x"), F.col("root_y").alias("root_x"))
    allowed = (F.col("root_x") != F.col("root_y")) & _may_link(F.col("n_x"), F.col("n_y"), F.col("pos_x"), F.col("pos_y"))
    rest = _sized(left.join(right.drop("main"), "t").where(allowed)).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more = _verified(sets, cut(rest, "jaccard-rest"))
    roots = cut(components(links.unionAll(more)), "jaccard-final-roots")
    root = F.when(F.col("n") > 0, F.coalesce("root", "node"))
    some, none = rows.where("n > 0").join(roots, "node", "left"), rows.where("n = 0").withColumn("root", F.lit(None).cast("long"))
    return cut(some.select("node", "doc_id", "th", "n", "root").unionByName(none).select("doc_id", "th", F.col("n").alias("n_shingles"), root.alias("root")), "jaccard-placed")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, root (name of the class) and component_id of every row.

    component_id is the smallest doc_id that links reach; root is null where there are no n-grams.
    Links inside a class are not counted: pairs of sets that are in one class already are not compared,
    so there is no number of links and no list of linked pairs.

    Null and empty texts, and those of white space only, have no n-grams and link with nothing: their
    class is their own id. Repeated rows and equal sets are one class. Rows with a null id get the
    smallest id of their class, null if it has none. Texts of any length are whole sets; extra columns
    are ignored; an empty table gives no rows.
    """
    placed = _placed(docs)
    some = placed.where("root IS NOT NULL")
    smallest = cut(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-smallest")
    alone = placed.where("root IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "th", "n_shingles", "root", "component_id"]
    return some.join(smallest, "root").select(*columns).unionAll(alone.select(*columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) less all but one of each class: that of the smallest id, ids before null.

    Of repeated rows one stays; rows without n-grams are in no class and all stay. Columns of any name are
    kept as they are.
    """
    d, th = unused(docs, "id"), unused(docs, "hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    kept = cut(_placed(docs).where("root IS NOT NULL").groupBy("root").agg(first.alias("k")).select(F.coalesce("k.doc_id", F.lit(-1)).alias(d), F.col("k.th").alias(th)).distinct(), "jaccard-kept")
    words = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    named = docs.where(words).withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    one = named.join(kept.hint("shuffle_hash"), [d, th], "left_semi").dropDuplicates([d, th]).select(*docs.columns)
    return one.unionByName(docs.where(~words))


def _sized(pairs: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b, n_a, n_b)."""
    swap = F.col("x") > F.col("y")
    return pairs.select(
        *_pair(F.col("x"), F.col("y")), F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b")
    ).distinct()


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.75 or more on 5-word shingles."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT row_no, array_to_string(w[i:i + 4], ' ') AS key
  FROM (SELECT row_no, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT row_no, count(*) AS n FROM s GROUP BY row_no),
p AS (SELECT a.row_no AS x, b.row_no AS y, count(*) AS k FROM s a JOIN s b ON a.key = b.key AND a.row_no < b.row_no GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.row_no = x JOIN n b ON b.row_no = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT row_no, row_no AS o FROM d UNION SELECT r.row_no, e.y FROM r JOIN e ON r.o = e.x)
SELECT a.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b.doc_id) AS component_id
FROM r JOIN d a USING (row_no) JOIN d b ON b.row_no = r.o LEFT JOIN n ON n.row_no = a.row_no
GROUP BY a.row_no, a.doc_id
"""
