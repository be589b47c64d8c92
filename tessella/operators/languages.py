"""Language detection by rank-ordered profiles of character n-grams, learned from labelled texts.

A profile is the list of a language's most frequent n-grams. A text gets the same list of its own, and each of its
n-grams counts for a language by how near its two ranks are. An n-gram is a number here, its letters' code points in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessella.runtime import ship_code

SIZES = (1, 2, 3)
LISTED = 300  # n-grams of a profile and of a text
BITS = 21  # of a code point; three of them fit in a number, and numbers sort as their n-grams do
MARK = ord("_")  # the edge of a word
STRETCH = 1 << 18  # characters whose n-grams are counted at once
AT_ONCE = 1 << 20  # n-grams, or gains of n-grams by language, held before they go on


def _counted(marked: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words between marks, in their order, and how often each occurs."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    last = max(SIZES) - 1
    for start in range(0, len(marked), STRETCH):
        c = np.frombuffer(marked[start : start + STRETCH + last].encode("utf-32-le"), np.uint32).astype(np.int64)
        letter = c != MARK
        grams = []
        for k in SIZES:
            n = min(STRETCH, len(c) - k + 1)  # windows that begin in this stretch
            if n <= 0:
                continue
            key, held = np.zeros(n, np.int64), np.zeros(n, bool)
            whole = np.ones(n, bool)  # marks stand at the ends only
            for i in range(k):
                key |= c[i : i + n] << BITS * (max(SIZES) - 1 - i)
                held |= letter[i : i + n]
                if 0 < i < k - 1:
                    whole &= letter[i : i + n]
            grams.append(key[held & whole])
        found.append(np.unique(np.concatenate(grams), return_counts=True))
    if len(found) < 2:
        return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int64()))


def ngrams(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """id, langs, and the grams of every text (id, text) with their counts, the most frequent first and ties by the n-gram.

    N-grams are those of its words, with the words' edges marked. Null text has none, and neither has a text without an id.
    Texts may have a ``lang``, which is null where nothing is to be learned; ``langs`` are those of an id's rows. Whole texts
    are dealt by id, in ``parts``; texts of one id, which are one text, follow each other there.
    """
    ship_code(texts.sparkSession)
    lang = F.col("lang") if "lang" in texts.columns else F.lit(None).cast("string")
    marked = F.concat(F.lit("_"), F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "_"), F.lit("_"))
    of = texts.where("id IS NOT NULL").select("id", lang.alias("lang"), F.coalesce(marked, F.lit("")).alias("marked"))
    dealt = of.repartition(*([parts] if parts else []), "id").sortWithinPartitions("id")
    longs = ArrayType(LongType(), False)
    schema = StructType([texts.schema["id"], StructField("langs", ArrayType(StringType(), False)), StructField("grams", longs), StructField("counts", longs)])
    id_type = to_arrow_type(texts.schema["id"].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids, langs, grams, counts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(langs, pa.list_(pa.string())), _lists(grams), _lists(counts)], ["id", "langs", "grams", "counts"])

        rows, held = [], 0
        for own, same in groupby(_rows(batches), key=lambda row: row[0]):
            same = list(same)
            grams, counts = _counted("".join(marked for _, _, marked in same))
            if len(grams):
                order = np.argsort(-counts, kind="stable")
                rows.append((own, [lang for _, lang, _ in same if lang is not None], grams[order], counts[order]))
                held += len(grams)
            if held >= AT_ONCE:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    return dealt.mapInArrow(count, schema)


def profiles(grams: DataFrame, labels: DataFrame | None = None, listed: int = LISTED) -> DataFrame:
    """lang, gram and rank, from the n-grams of texts and their languages: those of ``labels`` (id, lang), else ``langs``."""
    if labels is None:
        learned = grams.select(F.explode("langs").alias("lang"), "grams", "counts")
    else:
        learned = grams.join(labels.where("lang IS NOT NULL"), "id").select("lang", "grams", "counts")
    each = learned.select("lang", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("n"))).alias("gram", "n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", rank).where(F.col("rank") <= listed).select("lang", "gram", "rank")


def detect(grams: DataFrame, known: DataFrame, listed: int = LISTED) -> DataFrame:
    """id, detected (the language) and gain of every text that shares an n-gram with a profile; ties by the language.

    An n-gram gains ``listed`` less the distance of its ranks, which is the out-of-place measure counted from the other end.
    The profiles, ``listed`` n-grams of each language, go to the tasks.
    """
    spark = grams.sparkSession
    ship_code(spark)
    rows = sorted((r["gram"], r["lang"], r["rank"]) for r in known.collect())
    langs = sorted({lang for _, lang, _ in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    listed_grams, first = np.unique(np.array([g for g, _, _ in rows], np.int64), return_index=True)
    ends = np.append(first, len(rows))  # each n-gram's languages and ranks follow each other
    lang_of, rank_of = np.array([number[lang] for _, lang, _ in rows], np.int64), np.array([r for _, _, r in rows], np.int64)
    at_once = max(1, AT_ONCE // max(1, listed * len(langs)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                own = batch.column(1)
                sizes = np.diff(own.offsets.to_numpy())
                keys = own.flatten().to_numpy()
                text = np.repeat(np.arange(len(sizes)), sizes)
                rank = np.arange(1, len(keys) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.minimum(np.searchsorted(listed_grams, keys), len(listed_grams) - 1)
                shared = listed_grams[at] == keys
                at, text, rank = at[shared], text[shared], rank[shared]
                times = ends[at + 1] - ends[at]
                entry = np.arange(times.sum()) + np.repeat(ends[at] - np.cumsum(times) + times, times)
                gain = listed - np.abs(np.repeat(rank, times) - rank_of[entry])
                table = np.bincount(np.repeat(text, times) * len(langs) + lang_of[entry], gain, len(sizes) * len(langs)).reshape(len(sizes), len(langs))
                top = table.argmax(1)  # of equal gains the first language's
                most = table[np.arange(len(sizes)), top].astype(np.int64)
                met = most > 0  # whatever is shared gains
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(met)), pa.array([langs[k] for k in top[met]], pa.string()), pa.array(most[met])], ["id", "detected", "gain"])

    schema = StructType([grams.schema["id"], StructField("detected", StringType()), StructField("gain", LongType())])
    own = grams.select("id", F.slice("grams", 1, listed).alias("grams"))
    return own.mapInArrow(best, schema) if rows else spark.createDataFrame([], schema)
