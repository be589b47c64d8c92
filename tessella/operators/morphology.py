"""Decoding words from four heads (stem, part of speech, affix set, affixes), and a beam search over such words.

The heads vote on the word's type; each head's ids of that type are cut at a fall of probability; an affix set brings its
own affixes, and free affixes fill slots that it allows; stem, part of speech and affix set must stand in the sparse tables
of pairs seen together. The search is a loop over a frontier of hypotheses, all sentences at once, written out in each
round; what follows a state of the frontier is worked out once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.beam import once, synthesis_key
from tessella.functions.scoring import safe_log
from tessella.runtime import cut

OTHER = -1  # the type of words without morphology
NONE = -100.0  # vote of a head that has no id of a type
WEIGHT = 0.08  # of the correlation of affix set and stem
DIGITS = 9


@dataclass(frozen=True)
class Tables:
    """What is known of ids: dictionaries and sparse correlations."""

    types: DataFrame  # head, id, wt: types of ids; ids without a row are of OTHER, affixes without one are none
    affixes: DataFrame  # affix, slot, idx
    own: DataFrame  # afset, nth, affix: affixes of an affix set, in order
    slots: DataFrame  # afset, wt, slot: slots that free affixes may fill beside a set
    pos_stem: DataFrame  # pos, stem
    pos_afset: DataFrame  # pos, afset
    afset_stem: DataFrame  # afset, stem, corr
    stem_slot: Column  # of the column wt


def _ids(head: str, *more: str) -> Column:
    """A head's ids among a group's rows, as (neg: minus the probability, id and what else is named)."""
    return F.collect_list(F.when(F.col("head") == head, F.struct((-F.col("p")).alias("neg"), "id", *more)))


def _kept(ids: Column, fall: float, least: float | None = None) -> Column:
    """Ids of a head, best first, up to the first whose probability falls by ``fall`` or is under ``least``."""

    def until(best: Column) -> Column:
        def stops(x: Column, i: Column) -> Column:
            falls = F.coalesce(x["neg"] - F.get(best, i - 1)["neg"], F.lit(-1.0)) >= fall
            return falls if least is None else falls | (-x["neg"] < least)

        last = F.array_position(F.concat(F.transform(best, stops), F.array(F.lit(True))), F.lit(True)) - 1
        return F.slice(best, F.lit(1), last.cast("int"))

    return once(F.array_sort(ids), until)


def vote(typed: DataFrame, key: list[str], delta: float) -> DataFrame:
    """The rows (key, wt, score) of the types to try, with wt_p: best score first, until one falls by more than ``delta`` below the one before."""
    every = Window.partitionBy(*key)
    ordered = every.orderBy(F.desc("score"), F.col("wt") == OTHER, "wt")
    share = F.exp(F.col("score") - F.max("score").over(every))
    votes = typed.withColumn("e", share).withColumn("falls", F.coalesce(F.lag("score").over(ordered) - F.col("score") > delta, F.lit(False)))
    votes = votes.withColumn("wt_p", F.col("e") / F.sum("e").over(every)).withColumn("stopped", F.max("falls").over(ordered))
    return votes.where("NOT stopped").drop("score", "e", "falls", "stopped")


def _filled(sets: DataFrame, tables: Tables) -> DataFrame:
    """``sets`` (afset, wt, affix_ids) with affixes and n_free: one affix for each slot, the set's own before free ones."""
    slot = lambda: (F.col("slot").cast("bigint").alias("slot"), F.col("idx").cast("bigint").alias("idx"))
    number = F.col("affix").cast("bigint").alias("affix")
    own = tables.own.join(tables.affixes, "affix").groupBy("afset").agg(F.collect_list(F.struct(slot()[0], F.lit(0).alias("free"), F.col("nth").cast("double").alias("rank"), number, slot()[1])).alias("own"))
    slots = tables.slots.groupBy("afset", "wt").agg(F.collect_set(F.col("slot").cast("bigint")).alias("open"))
    none = F.expr("cast(array() as array<struct<slot:bigint,free:int,rank:double,affix:bigint,idx:bigint>>)")
    each = F.transform("affix_ids", lambda x: F.transform(F.filter(x["at"], lambda a: F.array_contains(F.col("open"), a["slot"])), lambda a: F.struct(a["slot"].alias("slot"), F.lit(0).alias("free") + 1, x["neg"].alias("rank"), x["id"].alias("affix"), a["idx"].alias("idx"))))
    free = F.flatten(F.filter(each, lambda x: x.isNotNull())).cast("array<struct<slot:bigint,free:int,rank:double,affix:bigint,idx:bigint>>")
    first = lambda c: F.filter(c, lambda x, i: F.coalesce(F.get(c, i - 1)["slot"] != x["slot"], F.lit(True)))
    out = sets.join(own, "afset", "left").join(slots, ["afset", "wt"], "left")
    out = out.withColumn("taken", once(F.array_sort(F.concat(F.coalesce("own", none), F.coalesce(free, none))), first))
    out = out.withColumn("affixes", F.array_sort(F.transform("taken", lambda x: F.struct(x["slot"].alias("slot"), x["idx"].alias("idx")))))
    return out.withColumn("n_free", F.aggregate("taken", F.lit(0).cast("bigint"), lambda n, x: n + x["free"])).drop("own", "open", "taken", "affix_ids")


def decode_words(heads: DataFrame, tables: Tables, key: list[str], delta: float = 2.0, fall: float = 0.3, affix_fall: float = 0.3, affix_least: float = 0.3) -> DataFrame:
    """Words of each ``key``: wt, stem, pos, afset, affixes (array of (slot, idx) by slot), n_free, prob and synthesis (key).

    ``heads`` has the key, head (stem, pos, afset, affix), id and p, of the ids worth a look. Combinations that one of the
    sparse tables does not have are no words. Probabilities of a type's words sum to the type's. The ids of a key and type are
    one row until words are made of them; where ``heads`` comes dealt by its key and the tables are small, nothing is shuffled.
    """
    word = [*key, "wt"]
    places = tables.affixes.groupBy("affix").agg(F.collect_list(F.struct(F.col("slot").cast("bigint").alias("slot"), F.col("idx").cast("bigint").alias("idx"))).alias("at"))
    typed = heads.join(tables.types, ["head", "id"], "left").where("wt IS NOT NULL OR head <> 'affix'").withColumn("wt", F.coalesce("wt", F.lit(OTHER)))
    typed = typed.join(places.withColumnRenamed("affix", "id").withColumn("head", F.lit("affix")), ["head", "id"], "left")
    best = [F.coalesce(F.max(F.when(F.col("head") == h, F.log("p"))), F.lit(NONE)) for h in ("stem", "pos", "afset")]
    typed = typed.groupBy(*word).agg(
        F.round(sum(best[1:], best[0]), DIGITS).alias("score"), F.bool_or(F.col("head") != "affix").alias("known"), *[_ids(h).alias(f"{h}_ids") for h in ("stem", "pos", "afset")], _ids("affix", "at").alias("affix_ids")
    )
    kept = vote(typed.where("known").drop("known"), key, delta)
    kept = kept.select(*word, "wt_p", *[_kept(F.col(f"{h}_ids"), fall).alias(f"{h}_ids") for h in ("stem", "pos", "afset")], _kept(F.col("affix_ids"), affix_fall, affix_least).alias("affix_ids"))
    sets = kept.withColumn("s", F.explode("afset_ids")).withColumn("afset", F.col("s.id")).withColumn("afset_p", -F.col("s.neg")).drop("s", "afset_ids")
    sets = _filled(sets, tables)
    sets = sets.withColumn("synthesis", F.coalesce(synthesis_key(F.col("wt"), tables.stem_slot, F.col("affixes")), F.lit("")))
    met = sets.withColumn("s", F.explode("stem_ids")).withColumn("stem", F.col("s.id")).withColumn("stem_p", -F.col("s.neg")).drop("s", "stem_ids").join(tables.afset_stem, ["afset", "stem"])
    met = met.withColumn("s", F.explode("pos_ids")).withColumn("pos", F.col("s.id")).withColumn("pos_p", -F.col("s.neg")).drop("s", "pos_ids").join(tables.pos_stem, ["pos", "stem"]).join(tables.pos_afset, ["pos", "afset"], "left_semi")
    met = met.withColumn("raw", F.exp(WEIGHT * F.col("corr") + F.log("stem_p") + F.log("pos_p") + F.log("afset_p")))
    prob = F.round(F.col("raw") / F.sum("raw").over(Window.partitionBy(*word)) * F.col("wt_p"), DIGITS)
    return met.select(*word, "stem", "pos", "afset", "affixes", "n_free", prob.alias("prob"), "synthesis")


def _options(words: DataFrame, key: list[str], eos: int, beam: int) -> DataFrame:
    """One row for each key: ``ends``, (cost, word) of all words that end a hypothesis, and ``goes_on``, (cost, word, stem) of
    those among the others that can be one of the ``beam`` best.

    Costs are compared after a sum and a rounding to ``DIGITS`` digits, then by the words' text, so that words of nearly one
    cost must all stay: a word goes only if ``beam`` others cost less by a whole step of 1e-7.
    """
    end = (F.col("stem") == eos) & (F.col("pos") == eos) & (F.col("afset") == eos)
    words = words.select(*key, "stem", (-safe_log(F.col("prob"))).alias("cost"), F.concat_ws("/", "stem", "pos", "afset", "synthesis").alias("word"), end.alias("end"))
    # words that end come first, as one step; the step after that of the last wanted one stays too
    step = F.when(F.col("end"), F.lit(-1).cast("bigint")).otherwise(F.floor(F.col("cost") * 1e7))
    nth = F.dense_rank().over(Window.partitionBy(*key).orderBy("step"))
    words = words.withColumn("step", step).withColumn("nth", nth).where(F.col("nth") <= beam + 2)
    goes_on = F.collect_list(F.when(~F.col("end"), F.struct("cost", "word", "stem")))
    return words.groupBy(*key).agg(F.collect_list(F.when(F.col("end"), F.struct("cost", "word"))).alias("ends"), goes_on.alias("goes_on"))


def search(sentences: DataFrame, score: Callable[[DataFrame], DataFrame], finish: Callable[[Column, Column], Column], tables: Tables, eos: int, beam: int, enough: int, steps: int, state: Column | None = None, **limits: float) -> DataFrame:
    """sentence, status, n_done, words and cost (negative score) of each sentence's best hypothesis.

    ``score`` gives the heads (sentence, place, head, id, p) of a frontier (sentence, place, words, stems, neg and the columns of
    ``sentences``); ``finish`` the score of a finished hypothesis from its log probability and length. Where scores depend on a
    ``state`` of the frontier's row alone, ``score`` is asked for each state once, as rows of ``state``, and gives the heads of each
    (state, head, id, p). A hypothesis ends with a word whose stem, part of speech and affix set are ``eos``. A sentence stops
    with ``enough`` finished ones; without any after ``steps`` words, its best unfinished one stands for it.
    """
    own = [c for c in sentences.columns if c != "sentence"]
    key = ["sentence", "place"] if state is None else ["state"]
    front = sentences.select("sentence", *own, F.lit(1).alias("place"), F.expr("cast(array() as array<string>)").alias("words"), F.expr("cast(array() as array<bigint>)").alias("stems"), F.lit(0.0).alias("neg"))
    front, done, left, asked, options = cut(front, "morph-front"), None, None, None, None
    for _ in range(steps):
        if state is None:
            options = cut(_options(decode_words(score(front), tables, key, **limits), key, eos, beam), "morph-words")
            at = front
        else:
            at = front.withColumn("state", state)
            new = at.select("state").where("state IS NOT NULL").distinct()
            new = cut(new if asked is None else new.join(asked, "state", "left_anti"), "morph-states")
            if asked is None or not new.isEmpty():
                found = cut(_options(decode_words(score(new), tables, key, **limits), key, eos, beam), "morph-words")
                options, asked = (found, new) if asked is None else (options.unionAll(found), asked.unionAll(new))
        cost = lambda x: F.round(F.col("neg") + x["cost"], DIGITS)
        # of a hypothesis' words no more than ``beam`` can go on, so that only these meet their sentence's others
        goes_on = F.slice(F.array_sort(F.transform("goes_on", lambda x: F.struct(cost(x).alias("neg"), x["word"].alias("word"), x["stem"].alias("stem")))), 1, beam)
        ends = F.transform("ends", lambda x: F.struct(cost(x).alias("neg"), x["word"].alias("word")))
        grown = cut(at.join(options, key).select("sentence", *own, "words", "stems", ends.alias("ends"), goes_on.alias("goes_on")), "morph-grown")
        ended = grown.where(F.size("ends") > 0).select("sentence", *own, "words", F.explode("ends").alias("x")).select("sentence", *own, F.array_append("words", F.col("x.word")).alias("words"), F.col("x.neg").alias("neg"))
        ended = ended.withColumn("neg", F.round(-finish(-F.col("neg"), F.size("words")), DIGITS)).select("sentence", "words", "neg")
        done = cut(ended if done is None else done.unionAll(ended), "morph-done")
        place = F.row_number().over(Window.partitionBy("sentence").orderBy("neg", "words"))
        open_ = grown.select("sentence", *own, "words", "stems", "goes_on").repartition("sentence").withColumn("x", F.explode("goes_on"))
        open_ = open_.select("sentence", *own, F.array_append("words", F.col("x.word")).alias("words"), F.array_append("stems", F.col("x.stem")).alias("stems"), F.col("x.neg").alias("neg")).withColumn("place", place).where(F.col("place") <= beam)
        full = done.groupBy("sentence").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("sentence")
        # what a stopped sentence leaves unfinished, and what a sentence without any word to go on with had, count no more
        front = cut(open_.join(full, "sentence", "left_anti").select(front.columns), "morph-front")
        left = front
        if front.isEmpty():
            break
    every = done.select("sentence", F.lit(0).alias("open"), "neg", "words").unionAll(left.select("sentence", F.lit(1), "neg", "words"))
    best = every.groupBy("sentence").agg(F.min(F.struct("open", "neg", "words")).alias("b"), F.count_if(F.col("open") == 0).alias("n_done"))
    status = F.when(F.col("b").isNull(), "none").when(F.col("b.open") == 0, "complete").otherwise("pending")
    return sentences.select("sentence").join(best, "sentence", "left").select("sentence", status.alias("status"), F.coalesce("n_done", F.lit(0)).cast("bigint").alias("n_done"), F.array_join("b.words", " ").alias("words"), F.col("b.neg").alias("cost"))
