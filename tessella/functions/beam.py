"""Beam search as one array fold for each sentence, and surface keys of decoded words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HYPOTHESES = "array<struct<neg:double,seq:array<bigint>>>"


def best_options(logits: Column, beam: int) -> Column:
    """The ``beam`` best ids with log probabilities among themselves alone, as (lp, ids) of one id each; ties: smaller id."""
    keyed = F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.cast("bigint").alias("id")))

    def of(top: Column) -> Column:
        shifted = F.aggregate(top, F.lit(0.0), lambda a, t: a + F.exp(top[0]["neg"] - t["neg"]))
        return F.transform(top, lambda t: F.struct((top[0]["neg"] - t["neg"] - F.log(shifted)).alias("lp"), F.array(t["id"]).alias("ids")))

    return once(F.slice(F.array_sort(keyed), 1, beam), of)


def search(options: Callable[[Column], Column], bos: int, eos: int, beam: int, enough: int, longest: int, steps: int) -> Column:
    """(pending, done) after a beam search, both as arrays of (neg: minus the log probability, seq).

    ``options`` gives what may follow a sequence, as an array of (lp, ids); ids of more than one token are
    copies, whose log probability counts once. A hypothesis is done when it ends in ``eos`` or has
    ``longest`` tokens. A sentence stops when ``enough`` are done, none is pending or ``steps`` are made.
    """
    first = F.array(F.struct(F.lit(0.0).alias("neg"), F.array(F.lit(bos).cast("bigint")).alias("seq")))
    start = F.struct(first.cast(HYPOTHESES).alias("pending"), F.array().cast(HYPOTHESES).alias("done"))

    def full(h: Column) -> Column:
        return (F.element_at(h["seq"], -1) == eos) | (F.size(h["seq"]) >= longest)

    def step(state: Column, _: Column) -> Column:
        grown = F.flatten(F.transform(state["pending"], lambda h: F.transform(options(h["seq"]), lambda o: F.struct(F.round(h["neg"] - o["lp"], 9).alias("neg"), F.concat(h["seq"], o["ids"]).alias("seq")))))

        def dealt(e: Column) -> Column:
            kept = F.slice(F.array_sort(F.filter(e, lambda h: ~full(h))), 1, beam)
            return F.struct(kept.alias("pending"), F.concat(state["done"], F.filter(e, full)).alias("done"))

        return F.when(F.size(state["done"]) < enough, once(grown, dealt)).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# The slots of a verb's doubling.
DOUBLED, DOUBLING, VERB = 12, 11, 0


def synthesis_key(word_type: Column, stem_slot: Column, affixes: Column) -> Column:
    """``type:slot-slot-..|index,index,..`` of a word's (slot, idx) affixes and its stem, by slot.

    The stem takes index 0 in its slot unless an affix has that slot; a verb with an affix in the
    doubling's slot gets the slot before it. Ties of slots go by index. Null where there are no affixes.
    """
    has = lambda slot: F.exists(affixes, lambda a: a["slot"] == slot)
    added = lambda when, slot: F.when(when, F.array(F.struct(slot.cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("idx"))))
    none = F.slice(affixes, 1, 0)
    every = F.concat(affixes, F.coalesce(added(~has(stem_slot), stem_slot), none), F.coalesce(added((word_type == VERB) & has(DOUBLED) & ~has(DOUBLING), F.lit(DOUBLING)), none))
    ordered = F.array_sort(every)
    joined = lambda field, sep: F.array_join(F.transform(ordered, lambda a: a[field].cast("string")), sep)
    return F.when(F.size(affixes) > 0, F.concat(word_type.cast("string"), F.lit(":"), joined("slot", "-"), F.lit("|"), joined("idx", ",")))


def stem_text(stem: Column, has_affixes: Column) -> Column:
    """A stem without its class: with affixes the part between the first and second colon, if the first is not
    in front; without, all after the first colon, if anything follows and the stem has over two characters."""
    at = F.instr(stem, ":")
    bare = (at > 0) & (F.length(stem) > 2) & (at < F.length(stem))
    return F.when(has_affixes, F.when(at > 1, F.split(stem, ":")[1]).otherwise(stem)).otherwise(F.when(bare, F.substr(stem, at + 1)).otherwise(stem))
