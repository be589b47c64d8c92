"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, under a softmax.

A word's vector is the mean of the vectors of its features (the whole word, its character n-grams
with the word's edges marked and, if asked for, the delexicalised pair that it forms with the word
before it); a bag's vector is the mean over its words. Vectors and softmax are trained together by
stochastic gradient descent in numpy. A bag is a whole document, or a window of words: then a
document scores as its highest window, and training picks that window anew in every round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import by_chars, map_batches

R = np.uint64(0x9E3779B97F4A7C15)
CHARS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Spec:
    """What a model looks at and how it is trained; every bound is here."""

    buckets: int = 1 << 18
    dim: int = 8
    n_grams: tuple[int, ...] = (3, 4, 5)
    fold: bool = True  # A-Z read as a-z
    pairs: bool = False  # also the shape of each word and its predecessor, and whether they are the same
    window: int = 0  # words in a bag; 0: the whole document
    bag_epochs: int = 12
    window_epochs: int = 40
    rate: float = 0.5
    decay: float = 1e-6
    seed: int = 20_011
    sample_per_class: int = 1_500  # labelled training documents, at most, of either class
    sample_bytes: int = 64_000_000  # of the texts of either class, at most, that come to the driver


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_SHAPE = np.zeros(256, np.uint8)  # of a byte: 0 space, 1 lower, 2 upper, 3 digit, 4 other ASCII, 5 beyond ASCII
for _c in range(256):
    _SHAPE[_c] = 0 if _c == 32 else 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c < 128 else 5


def features(texts: list[str], spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every feature and the number of words of each text; words are numbered through."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    if not counts.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    joined = b" " + b" ".join(b" ".join(w) for w in words if w) + b" "
    if spec.fold:
        joined = joined.lower()
    raw = np.frombuffer(joined, np.uint8)
    space = raw == 32
    starts = np.flatnonzero(space)  # the space before each word, and the last
    word_of = np.cumsum(space) - 1
    data = raw.astype(np.uint64) + np.uint64(1)
    n = len(raw)
    with np.errstate(over="ignore"):
        bucket, owner = [], []
        h = data.copy()
        inner = np.zeros(n, np.int32)
        np.cumsum(space, out=inner)
        for k in range(2, min(max(spec.n_grams), n) + 1):
            h = h[: n - k + 1] * R + data[k - 1 :]
            if k in spec.n_grams:
                # no space strictly inside: edges are marked by the space itself
                valid = np.flatnonzero(inner[k - 2 : n - 1] == inner[: n - k + 1]) if k > 2 else np.arange(n - 1)
                bucket.append(_mix(h[valid] + np.uint64(k)))
                owner.append(word_of[valid + 1] - space[valid + 1])
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, R))))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(data * powers[:n])))
        inverse = np.uint64(pow(int(R), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, inverse))))
        whole = (prefix[starts[1:]] - prefix[starts[:-1] + 1]) * back[starts[:-1] + 1]
        bucket.append(_mix(whole + np.uint64(0x51ED)))
        owner.append(np.arange(len(whole)))
        if spec.pairs:
            shape = _SHAPE[raw]
            first = shape[starts[:-1] + 1].astype(np.uint64)
            last = shape[starts[1:] - 1].astype(np.uint64)
            kind = first * np.uint64(8) + last
            before = np.concatenate(([np.uint64(99)], kind[:-1]))
            same = np.concatenate(([False], whole[1:] == whole[:-1]))
            head = np.concatenate(([0], np.cumsum(counts)))[:-1][counts > 0]
            before[head], same[head] = np.uint64(99), False
            bucket.append(_mix(before * np.uint64(1000) + kind + np.uint64(0xA11CE) + same.astype(np.uint64) * np.uint64(10**6)))
            owner.append(np.arange(len(whole)))
    return (np.concatenate(bucket) & np.uint64(spec.buckets - 1)).astype(np.int64), np.concatenate(owner).astype(np.int64), counts


@dataclass
class Model:
    """A trained model, folded for two classes: a feature counts by its vector's log-odds."""

    spec: Spec
    weight: np.ndarray  # float32 for each bucket
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; a text without words has that of an empty bag."""
        bucket, owner, counts = features(texts, self.spec)
        logit = np.full(len(texts), self.bias, np.float64)
        if len(bucket):
            words = int(counts.sum())
            per_word = np.bincount(owner, self.weight[bucket], words) / np.maximum(np.bincount(owner, minlength=words), 1)
            logit += bag_logits(per_word, counts, self.spec.window)[0]
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def bag_logits(per_word: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's log-odds: the mean over its words, or its highest window's; and where that window starts."""
    total = np.concatenate(([0.0], np.cumsum(per_word)))
    ends = np.cumsum(counts)
    starts = ends - counts
    if not window:
        return (total[ends] - total[starts]) / np.maximum(counts, 1), starts
    out, at = np.zeros(len(counts)), starts.copy()
    size = np.minimum(counts, window)
    # a window starts at every word; those that would cross the document's end are pulled back into it
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.minimum(np.arange(len(per_word)), (ends - size)[doc])
    value = (total[begin + size[doc]] - total[begin]) / size[doc]
    some = np.flatnonzero(counts)
    if len(some):
        best = np.maximum.reduceat(value, starts[some])
        out[some] = best
        hit = np.flatnonzero(value == out[doc])
        first = np.full(len(counts), len(per_word), np.int64)
        np.minimum.at(first, doc[hit], hit)
        at[some] = begin[first[some]]
    return out, at


def _bag(bucket: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bag's distinct buckets with their summed weights."""
    b, back = np.unique(bucket, return_inverse=True)
    return b.astype(np.int32), np.bincount(back, weight).astype(np.float32)


class Trainer:
    """Vectors and a two-way softmax, by SGD with per-row step sizes (Adagrad)."""

    def __init__(self, spec: Spec):
        rng = np.random.default_rng(spec.seed)
        self.spec, self.rng = spec, rng
        self.vectors = (rng.standard_normal((spec.buckets, spec.dim)) * 0.05).astype(np.float32)
        self.out = (rng.standard_normal((spec.dim, 2)) * 0.5).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = np.full(spec.buckets, 1e-4, np.float32)

    def epoch(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, batch: int = 32) -> float:
        loss = 0.0
        order = self.rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            rows = np.concatenate([bags[i][0] for i in part])
            weight = np.concatenate([bags[i][1] for i in part])
            bag_of = np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part])
            got = self.vectors[rows] * weight[:, None]
            mean = np.stack([np.bincount(bag_of, got[:, d], len(part)) for d in range(self.spec.dim)], 1).astype(np.float32)
            logits = mean @ self.out + self.bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            y = labels[part]
            loss -= np.log(np.maximum(p[np.arange(len(part)), y], 1e-9)).sum()
            p[np.arange(len(part)), y] -= 1
            back = p @ self.out.T
            self.out -= 0.05 * mean.T @ p / len(part)
            self.bias -= 0.05 * p.mean(0)
            uniq, at = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(at, weight * back[bag_of, d], len(uniq)) for d in range(self.spec.dim)], 1).astype(np.float32)
            self.seen[uniq] += (grad**2).mean(1)
            self.vectors[uniq] -= self.spec.rate * grad / np.sqrt(self.seen[uniq])[:, None] + self.spec.decay * self.vectors[uniq]
        return loss / max(len(bags), 1)

    def folded(self) -> Model:
        return Model(self.spec, (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def train(texts: list[str], labels: list[int], spec: Spec) -> Model:
    """Trains on whole documents first and then, if the spec has windows, on each document's highest window.

    Without examples of both classes there is nothing to learn: the model then says the share of label 1.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Model(spec, np.zeros(spec.buckets, np.float32), float(np.log(share / (1 - share))))
    trainer = Trainer(spec)
    docs, bags = [], []
    for t in texts:
        bucket, owner, counts = features([t], spec)
        n = int(counts[0])
        per = 1 / np.maximum(np.bincount(owner, minlength=max(n, 1)), 1)
        bags.append(_bag(bucket, per[owner] / max(n, 1)) if n else (np.empty(0, np.int32), np.empty(0, np.float32)))
        if spec.window:
            order = np.argsort(owner, kind="stable")
            docs.append((bucket[order].astype(np.int32), np.searchsorted(owner[order], np.arange(n + 1)), n))
    for _ in range(spec.bag_epochs):
        trainer.epoch(bags, y)
    if spec.window:
        bags.clear()
        for _ in range(spec.window_epochs):
            weight, picked, truth = trainer.folded().weight, [], []
            for (bucket, first, n), label in zip(docs, labels):
                if not n:
                    continue
                per_word = np.add.reduceat(weight[bucket], first[:-1]) / np.diff(first)
                at = int(bag_logits(per_word, np.array([n]), spec.window)[1][0])
                size = min(n, spec.window)
                a, b = first[at], first[at + size]
                width = np.diff(first[at : at + size + 1])
                picked.append(_bag(bucket[a:b], np.repeat(1 / width / size, width)))
                truth.append(label)
                if not label and n > size:  # a clean document is clean everywhere
                    at = int(trainer.rng.integers(0, n - size))
                    a, b = first[at], first[at + size]
                    width = np.diff(first[at : at + size + 1])
                    picked.append(_bag(bucket[a:b], np.repeat(1 / width / size, width)))
                    truth.append(0)
            trainer.epoch(picked, np.array(truth, np.int64))
    return trainer.folded()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, spec: Spec) -> tuple[list[str], list[int]]:
    """A bounded, deterministic sample of training texts: per class the documents with the smallest hashes.

    Texts of any length up to ``sample_bytes`` take part, as many in the order of the hashes as those bytes hold. A document is held out if crc32 of its id as text leaves ``held_out`` modulo ``modulus``. Ids are
    chosen first and on narrow rows; only the chosen texts come to the driver. Of repeated or
    conflicting labels the larger counts.
    """
    ids = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = ids.where(fold_of("doc_id", modulus) != held_out)
    fit = docs.where("text IS NOT NULL").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    ids = ids.join(fit, "doc_id").where(F.col("size") <= spec.sample_bytes)
    chosen: dict[int, int] = {}
    for y in (0, 1):
        rows = ids.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(spec.seed), "doc_id"), "doc_id").limit(spec.sample_per_class).collect()
        held = 0
        for r in rows:
            held += r["size"]
            if held <= spec.sample_bytes:
                chosen[r["doc_id"]] = y
    if not chosen:
        return [], []
    got = docs.where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    return [r["text"] for r in got], [chosen[r["doc_id"]] for r in got]


def is_held_out(column: str, modulus: int, held_out: int):
    """Whether an id is in the held-out fold; a null id is not, as it has no label to learn from either."""
    return F.coalesce(fold_of(column, modulus) == held_out, F.lit(False))


def fold_of(column: str, modulus: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: the probability of label 1 for the whole text.

    Null and empty texts get the score of an empty bag; every row is scored, in place, whatever its
    length; an existing column of that name is replaced; an empty table gives no rows.
    """
    out = docs.drop(name)
    text_at = out.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x 4 bytes
    schema = out.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in by_chars(batches, text_at, CHARS_AT_ONCE):
            values = own.scores(["" if x is None else x for x in batch.column(text_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return map_batches(out, run, schema)
