"""Labels of legal lines over columns that run on across pages, as one long stream each.

What a line is depends on the line before it: whether that is a title or a paragraph, of which article and in which
language. The article's number is any number, so a stretch's function is kept by cases: for each kind and language
before it, what comes out for a number that none of its titles follows (that number may come out again), and what for
each number that one does follow.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ranking import with_running
from tessella.operators.scan import pickled_states
from tessella.runtime import cut, ship_code

STRETCH = 4_096  # lines
KINDS = ("other", "title", "paragraph")
LANGUAGES = (None, "rw", "fe", "en", "fr")


class State(NamedTuple):
    """What a line leaves to the next; ``number`` None stands for the number before the stretch."""

    kind: str = "other"
    lang: str | None = None
    number: int | None = 0


#: {(kind, lang): (state after for any number, {number: state after})}
Function = dict[tuple, tuple[State, dict[int, State]]]


def follow(s: State, x: dict) -> tuple[State, str]:
    """The state after a line and the line's class.

    A title right after a title counts only if its number is the next one. A line of no other class goes on with the
    title or paragraph before it: as a title if it begins with a colon or stands no lower than the line before it, not
    at all if it is bold. An ambiguous title takes a known language over unless it is the first. ``fresh`` lines follow none.
    """
    if x["fresh"]:
        s = State()
    title = x["raw"] and not (s.kind == "title" and (s.number is None or x["num"] != s.number + 1))
    takes = x["lang"] == "fe" and x["num"] != 1 and s.lang in ("fr", "en")
    lang, number = (x["lang"] if x["raw"] and not takes else s.lang), x["num"] or 0
    if x["other"] is None and not title and s.kind != "other":
        lang, number = s.lang, s.number
        title = s.kind == "title" and (x["colon"] or x["up"])
        if not title and not (s.kind == "title" and x["bold"]):
            return State("paragraph", lang, number), "paragraph"
    if title:
        return State("title", lang, number), "title"
    return State("other", lang, number), x["other"] or ("blank" if x["blank"] else "unknown")


def function_of(lines: list[dict]) -> Function:
    cases: dict[tuple, State] = {(k, g, None): State(k, g, None) for k in KINDS for g in LANGUAGES}
    for x in lines:
        if x["raw"] and not x["fresh"]:
            for (k, g, n), s in list(cases.items()):
                # from here on, the number before this one goes another way
                if n is None and s.kind == "title" and s.number is None and (k, g, x["num"] - 1) not in cases:
                    cases[k, g, x["num"] - 1] = s._replace(number=x["num"] - 1)
        after = {s: follow(s, x)[0] for s in set(cases.values())}
        cases = {c: after[s] for c, s in cases.items()}
    out: Function = {(k, g): (cases[k, g, None], {}) for k in KINDS for g in LANGUAGES}
    for (k, g, n), s in cases.items():
        if n is not None:
            out[k, g][1][n] = s
    return out


def apply(f: Function, s: State) -> State:
    every, some = f[s.kind, s.lang]
    found = some.get(s.number, every)
    return found if found.number is not None else found._replace(number=s.number)


def compose(f: Function, g: Function) -> Function:
    """f, then g."""
    out: Function = {}
    for case, (every, some) in f.items():
        cases = {n: apply(g, s) for n, s in some.items()}
        if every.number is None:
            for n, s in g[every.kind, every.lang][1].items():
                cases.setdefault(n, s)
            out[case] = (g[every.kind, every.lang][0], cases)
        else:
            out[case] = (apply(g, every), cases)
    return out


_LINE = ["raw", "num", "lang", "other", "colon", "bold", "blank", "fresh", "up"]


def label_stream(lines: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``key``, ``order``, class, number and lang of every line; each key's lines are one stream in ``order``.

    ``lines`` has the key, the order and ``facts``: (raw, num, lang, other, colon, bold, blank, fresh, y). Gazette and page
    marks are labelled apart: the lines around them follow one another. Key and order together tell lines apart.
    """
    ship_code(lines.sparkSession)
    skipped = F.coalesce(F.col("facts.other").isin("gazette", "page"), F.lit(False))
    lines = cut(lines.select(*key, *order, "facts"), "legal-facts")
    marks = lines.where(skipped).select(*key, *order, F.col("facts.other").alias("class"), F.lit(0).alias("number"), F.lit(None).cast("string").alias("lang"))
    placed = with_running(lines.where(~skipped), order, key, name="_pos")
    seq = F.floor((F.col("_pos") - 1) / STRETCH).cast("bigint")
    packed = placed.groupBy(*key, seq.alias("seq")).agg(F.array_sort(F.collect_list(F.struct("_pos", F.struct(*order).alias("at"), "facts"))).alias("lines"))  # STRETCH lines at most
    packed = cut(packed, "legal-stretches")
    # the height of the line before each stretch's first
    ends = packed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], (F.col("seq") + 1).alias("_next"), F.element_at("lines", -1)["facts"]["y"].alias("above"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    packed = packed.join(ends, [*same, F.col("seq") == F.col("_next")], "left").select(*key, "seq", "lines", "above")

    def read(batch: pa.RecordBatch) -> Iterator[list[dict]]:
        for i in range(batch.num_rows):  # one stretch at a time is Python's
            found, above = batch.column("lines")[i].values.field("facts").to_pylist(), batch.column("above")[i].as_py()
            for x in found:
                x["up"] = above is not None and x["y"] is not None and x["y"] <= above
                above = x["y"]
            yield found

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(function_of(x)) for x in read(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*key, "seq"]), pa.array(found, pa.binary())], [*key, "seq", "fn"])

    fns = packed.mapInArrow(functions, T.StructType([*(packed.schema[c] for c in [*key, "seq"]), T.StructField("fn", T.BinaryType())]))
    states = pickled_states(cut(fns, "legal-functions"), key, State(), compose, apply)
    states = states.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*key, "seq"])], "state")
    label = pa.list_(pa.struct([("class", pa.string()), ("number", pa.int32()), ("lang", pa.string())]))

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(read(batch)):
                s, rows = pickle.loads(batch.column("state")[i].as_py()), []
                for x in found:
                    s, kind = follow(s, x)
                    rows.append({"class": kind, "number": s.number, "lang": s.lang})
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in [*key, "lines"]), pa.array([rows], label)], [*key, "lines", "labels"])

    kind = T.ArrayType(T.StructType([T.StructField("class", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("lang", T.StringType())]))
    met = packed.join(states, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*key, "seq"])])
    met = met.select(*key, "lines", "above", "state").mapInArrow(labels, T.StructType([*(packed.schema[c] for c in [*key, "lines"]), T.StructField("labels", kind)]))
    each = met.select(*key, F.inline(F.arrays_zip("lines", "labels"))).select(*key, "lines.at.*", "labels.*")
    return each.unionByName(marks)
